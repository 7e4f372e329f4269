"""Best-fit packing: a configuration program over the histogram of lengths, solved by multiplicative weights with knapsack pricing, then rounded."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.tokens import identifiers
from pageloom.session import materialize, settle, tables_so_far

CAPACITY = 2048
END = 0  # the identifier after each document
ROUNDS = 150  # of multiplicative weights at most; ROUNDS * CAPACITY bounds the number of configurations
PART = 0.2  # of a length's pieces that a round covers at most
STEP = 0.1  # how fast the price of a length follows its coverage
SLACK = 0.02  # configurations whose worth is nearer to the best than this share a round
CONVEX = 0.05  # longer pieces are priced higher by length to this power at first: they are harder to place

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long, ids binary"
PLAN = "length int, rank long, first long, times int, base int"


def _cut(ends: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of a document: all full but the first, which takes what is over."""
    start = 0
    while start < ends:
        length = (ends - start) % capacity or capacity
        yield start, length
        start += length


def _pieces(capacity: int, path: str | None, with_ids: bool):
    """Task: documents come in, their pieces go out, each numbered among the task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, part, seen = identifiers(path).packed, TaskContext.get().partitionId(), Counter()
        end = END.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = packed(text.as_py() or "") + end
                for piece, (start, length) in enumerate(_cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    out.append((doc_id, piece, start, length, zlib.crc32(own), part, seen[length], own if with_ids else None))
                    seen[length] += 1
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"])

    return run


def priced(worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: for every capacity the best total worth, and the length to take first (0: leave one free).

    ``worth[l]`` is that of a piece of length l (not above 0: not to be taken).
    """
    size = len(worth)
    best, take = np.zeros(size), np.zeros(size, np.int64)
    for c in range(1, size):
        sums = best[c - 1 :: -1] + worth[1 : c + 1]
        k = int(sums.argmax())
        if sums[k] > best[c - 1] and worth[k + 1] > 0:
            best[c], take[c] = sums[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, take


def filled(lengths: np.ndarray, take: np.ndarray) -> np.ndarray:
    """The best configuration that holds each length: rows of lengths in falling order, zeros behind them."""
    capacity = len(take) - 1
    taken = np.maximum.accumulate(np.where(take > 0, np.arange(capacity + 1), 0))  # nearest capacity below at which one is taken
    columns, left = [lengths], taken[capacity - lengths]
    while left.any():
        columns.append(take[left])
        left = taken[left - columns[-1]]
    return -np.sort(-np.stack(columns, axis=1), axis=1)


def fractional(counts: np.ndarray, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """How often each configuration is to be used so that every length is covered, with few in all; fractions as they come.

    ``counts[l]`` pieces have length l, below the capacity ``len(counts) - 1``. A round prices the lengths that are not covered yet,
    finds for each the best configuration that holds it (one dynamic program serves all), and uses those whose worth is
    near the best one's, by volume, so far that no length gets more than ``PART`` of its pieces. Then the weights of lengths that
    got more than others fall, and those of the others rise.
    """
    capacity = len(counts) - 1
    lengths = np.flatnonzero(counts)
    volume = counts[lengths] * lengths / capacity
    weights, covered, found = (lengths / capacity) ** CONVEX, np.zeros(len(lengths)), Counter()
    per_piece = np.zeros(capacity + 1)
    per_piece[lengths] = 1 / (PART * counts[lengths])
    for _ in range(rounds):
        lacking = covered < 1
        if not lacking.any():
            break
        worth = np.zeros(capacity + 1)
        worth[lengths] = np.where(lacking, lengths * weights, 0.0)
        best, take = priced(worth)
        value = worth[lengths] + best[capacity - lengths]
        used = np.where(lacking & (value >= (1 - SLACK) * value.max()), PART * volume, 0.0)
        configurations = filled(lengths, take)
        shares = []
        for _ in range(2):  # the second time within the bound
            held = np.zeros(capacity + 1)
            np.add.at(held, configurations, used[:, None])
            held[0] = 0
            shares.append(held * per_piece)
            if len(shares) == 1:
                used = used / np.maximum(1, shares[0][configurations].max(axis=1))
        got = shares[1][lengths]
        covered += PART * got
        weights = weights * np.exp(-STEP * (got - got[lacking].mean()))
        weights /= weights.mean()
        for row, amount in zip(configurations[used > 0], used[used > 0].tolist(), strict=True):
            found[tuple(row[row > 0].tolist())] += amount
    return dict(found)


def _limited(pattern: tuple[int, ...], wish: int, left: np.ndarray) -> int:
    for length, times in Counter(pattern).items():
        wish = min(wish, int(left[length]) // times)
    return wish


def rounded(solution: dict[tuple[int, ...], float], counts: np.ndarray, least: float) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole numbers of each configuration, none beyond what there is, and the counts that are left over.

    Whole parts come first, in falling order; then each configuration whose fraction is at least ``least`` once more.
    """
    left = counts.copy()
    uses: Counter = Counter()
    order = sorted(solution.items(), key=lambda x: (-x[1], x[0]))
    for wishes in ([(p, int(x)) for p, x in order], sorted(((p, 1) for p, x in order if x % 1 >= least), key=lambda w: (-(solution[w[0]] % 1), w[0]))):
        for pattern, wish in wishes:
            times = _limited(pattern, wish, left) if wish else 0
            if times:
                uses[pattern] += times
                for length, n in Counter(pattern).items():
                    left[length] -= times * n
    return list(uses.items()), left


def best_fit(bins: list[tuple[tuple[int, ...], int]], left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Puts the pieces that are left, longest first, into the fullest bin that holds them, or a new one; equal bins move together."""
    capacity = len(left) - 1
    open_bins: dict[int, list[list]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        if times:
            free = capacity - sum(pattern)
            if free:
                open_bins.setdefault(free, []).append([pattern, times])
            else:
                done.append((pattern, times))

    for pattern, times in bins:
        put(pattern, times)
    for length in range(capacity, 0, -1):
        rest = int(left[length])
        for free in sorted(f for f in open_bins if f >= length):
            each = free // length
            stack = open_bins.pop(free)
            while stack and rest:
                pattern, times = stack.pop()
                full = min(times, rest // each)
                put((*pattern, *[length] * each), full)
                rest -= full * each
                if full < times:
                    if rest:  # the last of them take one bin
                        put((*pattern, *[length] * rest), 1)
                        full, rest = full + 1, 0
                    if full < times:
                        stack.append([pattern, times - full])
            if stack:
                open_bins.setdefault(free, []).extend(stack)
            if not rest:
                break
        each = capacity // length
        put((length,) * each, rest // each)
        put((length,) * (rest % each), 1 if rest % each else 0)
    return done + [(p, n) for group in open_bins.values() for p, n in group]


def planned(counts: np.ndarray, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences take each: the rounded solution, completed by best fit.

    Fractions may be rounded up from several thresholds on; the plan with the fewest sequences counts, of equal ones that with
    the most from the program. Full pieces are sequences of their own.
    """
    capacity = len(counts) - 1
    open_counts = counts.copy()
    open_counts[capacity] = 0
    solution = fractional(open_counts, rounds)
    plans = []
    for least in (1.0, 0.5, 0.0):
        bins, left = rounded(solution, open_counts, least)
        plan = best_fit(bins, left)
        plans.append((sum(n for _, n in plan), -sum(n for _, n in bins), plan))
    full = [((capacity,), int(counts[capacity]))] if counts[capacity] else []
    return sorted(full + min(plans, key=lambda p: p[:2])[2], key=lambda x: (-x[1], x[0]))


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``PLAN`` rows: from ``rank`` on, the pieces of a length go to the sequences from ``first`` on, ``times`` into each, at ``base`` and behind it."""
    taken: Counter = Counter()
    out, first = [], 0
    for pattern, times in plan:
        base = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            out.append((length, taken[length], first, each, base))
            taken[length] += times * each
            base += length * each
        first += times
    return out


def _planner(capacity: int, rounds: int):
    """Task: the histogram of lengths comes in, at most ``capacity`` rows; the plan's slots go out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            counts[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        rows = slots(planned(counts, rounds))
        if rows:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             names=["length", "rank", "first", "times", "base"])

    return run


def _assigned(plan: pa.Table, capacity: int):
    """Task: pieces with their rank among those of their length come in, and get the sequence and the place that the plan has for that rank."""
    plan = plan.sort_by([("length", "ascending"), ("rank", "ascending")])
    length, rank, first, times, base = (plan[n].to_numpy() for n in ("length", "rank", "first", "times", "base"))
    begins = np.searchsorted(length, np.arange(capacity + 2))  # where the slots of each length begin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, place = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            slot = np.empty(len(own), np.int64)
            for size in np.unique(own):
                at = np.flatnonzero(own == size)
                slot[at] = begins[size] + np.searchsorted(rank[begins[size] : begins[size + 1]], place[at], "right") - 1
            over = place - rank[slot]
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(first[slot] + over // times[slot]), pa.array(base[slot] + over % times[slot] * own.astype(np.int64))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset)``: every piece of every document and its place in a sequence.

    A document is its identifiers and an end identifier; longer ones than ``capacity`` are cut into full pieces behind a first one
    that takes what is over. ``ids`` holds a piece's identifiers as packed little-endian numbers with ``with_ids``, else null.
    Null and empty texts are documents of the end identifier alone; repeated rows and null ids are documents of their
    own; texts are encoded whole; other columns play no part; an empty table gives an empty result.

    Only the histogram meets in one task, and the plan, at most ``rounds * capacity`` configurations whatever the number of documents, goes
    to the others. A piece's rank among those of its length is its number in the task that cut it, which its row keeps,
    and the pieces of the tasks before.
    """
    spark = docs.sparkSession
    mark = tables_so_far(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = materialize(texts.mapInArrow(_pieces(capacity, vocabulary, with_ids), PIECES), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(by_part.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "pieces-before")
    counts = offsets.groupBy("length").agg(F.sum("n").alias("n")).coalesce(1)
    plan = counts.mapInArrow(_planner(capacity, rounds), PLAN).toArrow()
    ranked = pieces.join(offsets.drop("n"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    out = ranked.mapInArrow(_assigned(plan, capacity), "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary, sequence_id long, offset long")
    return settle(out, "packed", mark)
