"""Hard negatives by an inverted multi-index: cells of two half-space codebooks, visited by a heap in order of their bounds."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import materialize, settle, small, tables_so_far

CODES = 32  # of a half-space codebook: its square is the number of cells
SAMPLE = 20_000  # rows that the codebooks are fitted on; every row is indexed
FITTING = 8  # rounds of it
TILE = 4096  # rows of a shelf (the cells of one first code) that a task holds
REQUESTS = 16_384  # requests that meet a tile in one task
FIRST, GROWTH = 1024, 16  # rows that an anchor may read in its first round, and how many times more by the end of each further one
STRIP = 128  # requests that are compared with a tile in one step
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score between which a negative's lies
LEAST, MOST = -(2**63), 2**63 - 1
MOST_COMPONENT = 1.7976931348623157e308 / 256  # beyond it 256 times a component is infinite

Directory = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by vector length: codes, radii, codes, radii, rows per cell


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null, and no component null or not finite, times 256 either."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST_COMPONENT))
    return F.coalesce(embedding.isNotNull() & finite, F.lit(False))


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), size)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256) + 0.0  # no negative zeros
        ends = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths(), np.int64)))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["row", "vec_id", "label", "vec"])


def prepared(vectors: DataFrame) -> DataFrame:
    """``(row, vec_id, label, vec)`` of the rows that take part: labels as mined, components as whole numbers in doubles."""
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    good = known.where(F.col("label").isNotNull() & usable(F.col("vec")))
    rows = good.select(F.monotonically_increasing_id().alias("row"), "vec_id", label.alias("label"), "vec")
    return materialize(rows.mapInArrow(_whole, "row long, vec_id long, label long, vec array<double>"), "mined-vectors")


def codebook(points: np.ndarray, codes: int, rounds: int = FITTING) -> np.ndarray:
    """Centres of at most ``codes`` groups of points; the same points in the same order give the same centres."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.random.default_rng(13).permutation(len(distinct))[:codes]]
    for _ in range(rounds):
        code = nearest(points, centres)[0]
        held = np.unique(code)
        centres = np.stack([points[code == k].mean(axis=0) for k in held])
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of every point, and how far it is (worked out from the difference, so that it can serve as a radius)."""
    with np.errstate(over="ignore", invalid="ignore"):
        score = points @ centres.T - (centres**2).sum(axis=1) / 2
        code = np.nan_to_num(score, nan=-np.inf).argmax(axis=1)
        return code, np.nan_to_num(np.linalg.norm(points - centres[code], axis=1), nan=np.inf)


def _halves(vec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (vec.shape[1] + 1) // 2
    return vec[:, :cut], vec[:, cut:]


def _fitted(codes: int):
    """Task: the sample comes in; a row for each centre of each half of each length goes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, list[list[float]]] = {}
        for batch in batches:
            for v in batch.column(0).to_pylist():
                by_size.setdefault(len(v), []).append(v)
        out = []
        for size, rows in sorted(by_size.items()):
            for half, points in enumerate(_halves(np.array(sorted(rows), np.float64).reshape(len(rows), size))):
                out += [{"size": size, "half": half, "code": k, "centre": c.tolist()} for k, c in enumerate(codebook(points, codes))]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("size", pa.int32()), ("half", pa.int32()), ("code", pa.int32()), ("centre", pa.list_(pa.float64()))]))

    return run


def codebooks(rows: DataFrame, codes: int, sample: int) -> dict[tuple[int, int], np.ndarray]:
    """Centres by (vector length, half), fitted in one task on ``sample`` rows picked by hash; at most 2 * ``codes`` vectors a length come back."""
    picked = rows.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(sample).coalesce(1)
    found: dict[tuple[int, int], list] = {}
    for r in sorted(picked.mapInArrow(_fitted(codes), "size int, half int, code int, centre array<double>").collect(), key=lambda r: r["code"]):
        found.setdefault((r["size"], r["half"]), []).append(r["centre"])
    return {k: np.array(v, np.float64).reshape(len(v), (k[0] + 1) // 2 if k[1] == 0 else k[0] // 2) for k, v in found.items()}


def _coded(books: dict[tuple[int, int], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sizes = np.asarray(lists.value_lengths(), np.int32)
            code, far = np.zeros((2, len(sizes)), np.int32), np.zeros((2, len(sizes)))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for half, points in enumerate(_halves(_matrix(lists.take(pa.array(at)), int(size)))):
                    code[half, at], far[half, at] = nearest(points, books.get((int(size), half), np.zeros((1, points.shape[1]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), *map(pa.array, code), *map(pa.array, far)],
                                             names=["row", "vec_id", "label", "vec", "size", "code1", "code2", "far1", "far2"])

    return run


def indexed(rows: DataFrame, codes: int, sample: int) -> tuple[DataFrame, Directory]:
    """Every row with its two codes, and the directory: centres, the radius of each code, and the rows of each cell.

    The directory has at most ``codes`` squared numbers for a vector length, whatever the number of rows.
    """
    books = codebooks(rows, codes, sample)
    index = materialize(rows.mapInArrow(_coded(books), "row long, vec_id long, label long, vec array<double>, size int, code1 int, code2 int, far1 double, far2 double"), "mined-index")
    cells = index.groupBy("size", "code1", "code2").agg(F.count("*").alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2")).collect()
    directory: Directory = {}
    for size in sorted({r["size"] for r in cells}):
        c1, c2 = (books.get((size, half), np.zeros((1, (size + 1 - half) // 2))) for half in (0, 1))
        r1, r2, n = np.zeros(len(c1)), np.zeros(len(c2)), np.zeros((len(c1), len(c2)), np.int64)
        for r in cells:
            if r["size"] == size:
                i, j = r["code1"], r["code2"]
                r1[i], r2[j], n[i, j] = max(r1[i], r["far1"]), max(r2[j], r["far2"]), r["n"]
        directory[size] = (c1, r1, c2, r2, n)
    return index, directory


def half_bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of half a vector with any half vector of each code, rounding errors included."""
    with np.errstate(over="ignore", invalid="ignore"):
        middle, norm = centres @ q, np.linalg.norm(q)
        slack = norm * radii + 1e-9 * norm * (np.linalg.norm(centres, axis=1) + radii) + 0.01
        return np.nan_to_num(middle - slack, nan=-np.inf), np.nan_to_num(middle + slack, nan=np.inf)


def multi_sequence(upper1: np.ndarray, upper2: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Cells (sum of their halves' bounds, first code, second code) in falling order of the sum, by a heap over the two sorted halves."""
    order1, order2 = np.argsort(-upper1, kind="stable"), np.argsort(-upper2, kind="stable")
    u, v = upper1[order1].tolist(), upper2[order2].tolist()
    heap = [(-(u[0] + v[0]), 0, 0)] if u and v else []
    while heap:
        score, a, b = heappop(heap)
        yield -score, int(order1[a]), int(order2[b])
        if b + 1 < len(v):
            heappush(heap, (-(u[a] + v[b + 1]), a, b + 1))
        if b == 0 and a + 1 < len(u):
            heappush(heap, (-(u[a + 1] + v[0]), a + 1, 0))


def visits(q: np.ndarray, parts: tuple, popped: int, lows: list[int], highs: list[int], budget: int) -> tuple[dict[int, list[int]], int]:
    """Cells to visit next, by first code, and how many the heap has given by then; no more cells means certified.

    The first ``popped`` cells are done. Cells that cannot hold a score between a window's low and its high are passed
    over; once the bound is below every low, none that follows can.
    """
    c1, r1, c2, r2, n = parts
    cut = (len(q) + 1) // 2
    (low1, up1), (low2, up2) = half_bounds(q[:cut], c1, r1), half_bounds(q[cut:], c2, r2)
    found: dict[int, list[int]] = {}
    lowest, highest, read, at = min(lows), max(highs), 0, 0
    for bound, i, j in multi_sequence(up1, up2):
        if bound < lowest or (found and read >= budget):  # a round that is not the last visits one cell at least
            break
        at += 1
        read += int(n[i, j])
        if at > popped and n[i, j] and low1[i] + low2[j] <= highest:
            found.setdefault(i, []).append(j)
    return found, max(at, popped)


PLANNED = "shelf int, row long, vec_id long, label long, vec array<double>, popped int, lows array<long>, highs array<long>, codes array<int>"


def _planned(directory: Directory, budget: int):
    """Task: anchors come in; a row for each shelf that an anchor has cells to visit on goes out, and one (shelf -1) with its progress."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("shelf", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("vec", pa.list_(pa.float64())),
                           ("popped", pa.int32()), ("lows", pa.list_(pa.int64())), ("highs", pa.list_(pa.int64())), ("codes", pa.list_(pa.int32()))])
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(start, 256).to_pylist():
                    found, popped = visits(np.array(r["vec"], np.float64), directory[len(r["vec"])], r["popped"], r["lows"], r["highs"], budget)
                    out.append({**r, "shelf": -1, "popped": popped, "codes": []})
                    out += [{**r, "shelf": shelf, "popped": popped, "codes": codes} for shelf, codes in found.items()]
                yield pa.RecordBatch.from_pylist(out, kinds)

    return run


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as int64: by matrix product where no sum can leave the whole doubles, else in whole
    numbers of any size; what a long cannot hold becomes the nearest long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    with np.errstate(over="ignore"):
        largest = np.abs(a).max() * np.abs(b).max() * a.shape[1]
    if largest < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = [[[int(x) for x in v] for v in m] for m in (a, b)]
    return np.array([[max(LEAST, min(MOST, sum(x * y for x, y in zip(u, v, strict=True)))) for v in whole[1]] for u in whole[0]], np.int64)


def _best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each line of ``scores`` the first ``k`` allowed columns: higher scores first, then smaller ids, null ones last."""
    if allowed.shape[1] > k:
        held = np.where(allowed, scores, LEAST)
        allowed = allowed & (scores >= np.partition(held, -k, axis=1)[:, -k][:, None])
    i, j = np.nonzero(allowed)
    order = np.lexsort((rows[j], ids[j], unnamed[j], ~scores[i, j], i))  # ~x falls as x grows, and never overflows
    i, j = i[order], j[order]
    first = np.searchsorted(i, i, "left")
    keep = np.arange(len(i)) - first < k
    return i[keep], j[keep]


FOUND = "anchor long, window int, score long, found_id long, found_row long"


def _visited(k: int, same: bool):
    """Task: tiles of a shelf with the requests for it, one tile at a time; the first ``k`` rows of the tile for each window go out."""

    def answer(group: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = group["kind"].to_numpy()
        tile, asked = group.slice(0, int((kind == 0).sum())).combine_chunks(), group.slice(int((kind == 0).sum())).combine_chunks()
        if not tile.num_rows or not asked.num_rows:
            return
        size = group["size"][0].as_py()
        vecs, code, label, rows = _matrix(tile["vec"].chunk(0), size), tile["code"].to_numpy(), tile["label"].to_numpy(), tile["row"].to_numpy()
        unnamed, ids = np.asarray(tile["vec_id"].is_null()), tile["vec_id"].fill_null(0).to_numpy()
        for start in range(0, asked.num_rows, STRIP):
            part = asked.slice(start, STRIP).combine_chunks()
            wanted = np.zeros((part.num_rows, int(code.max()) + 1), bool)
            for line, codes in enumerate(part["codes"].to_pylist()):
                wanted[line, [c for c in codes if c < wanted.shape[1]]] = True
            at = np.flatnonzero(wanted.any(axis=0)[code])
            if not len(at):
                continue
            scores = inner_products(_matrix(part["vec"].chunk(0), size), vecs[at])
            alike = part["label"].to_numpy()[:, None] == label[at][None, :]
            allowed = wanted[:, code[at]] & (alike if same else ~alike) & (part["row"].to_numpy()[:, None] != rows[at][None, :])
            lows, highs = part["lows"].to_pylist(), part["highs"].to_pylist()
            most = max(map(len, lows))
            low = np.array([x + [MOST] * (most - len(x)) for x in lows], np.int64)  # a window that is not there holds nothing
            high = np.array([x + [LEAST] * (most - len(x)) for x in highs], np.int64)
            for w in range(most):
                i, j = _best(scores, allowed & (scores >= low[:, w, None]) & (scores <= high[:, w, None]), ids[at], unnamed[at], rows[at], k)
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part["row"].to_numpy()[i]), pa.array(np.full(len(i), w, np.int32)), pa.array(scores[i, j]),
                         pa.array(ids[at][j], mask=unnamed[at][j]), pa.array(rows[at][j])], names=["anchor", "window", "score", "found_id", "found_row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["size", "shelf", "tile", "block"], None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            keys = np.stack([held[n].to_numpy() for n in names], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts[:-1]], cuts, strict=True) if len(cuts) else ():
                yield from answer(held.slice(int(a), int(b - a)))
            held = held.slice(int(cuts[-1])) if len(cuts) else held
        if held is not None:
            yield from answer(held)

    return run


def _met(index: DataFrame, requests: DataFrame, k: int, same: bool, tile: int, block: int) -> DataFrame:
    """Answers of every shelf to the requests for it.

    Shelves are cut into tiles by hash, and their requests into blocks; each pair of a tile and a block is a task's work of
    its own, however full a shelf or however wanted. Two tables of a row per shelf say into how many.
    """
    shelf = ["size", "shelf"]
    rows = index.withColumnRenamed("code1", "shelf")
    tiles = rows.groupBy(*shelf).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    asked = requests.withColumn("size", F.size("vec"))
    blocks = asked.groupBy(*shelf).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    plan = small(tiles.join(blocks, shelf))  # codes rows per vector length, whatever the number of vectors
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(plan, shelf).withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int")).withColumn("block", every("blocks"))
    right = asked.join(plan, shelf).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).withColumn("tile", every("tiles"))
    columns = [*shelf, "tile", "block"]
    both = left.select(*columns, F.lit(0).alias("kind"), F.col("code2").alias("code"), "row", "vec_id", "label", "vec").unionByName(
        right.select(*columns, F.lit(1).alias("kind"), "row", "vec_id", "label", "vec", "lows", "highs", "codes"), allowMissingColumns=True)
    return both.repartition(*columns).sortWithinPartitions(*columns, "kind").mapInArrow(_visited(k, same), FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.col("found_id").asc_nulls_last(), "found_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_in_windows(index: DataFrame, directory: Directory, anchors: DataFrame, k: int, same: bool, tile: int, block: int, first: int, growth: int) -> DataFrame:
    """The first ``k`` rows of each window of every anchor, of its label (``same``) or of others: ``(anchor, window, score, found_id, found_row, rank)``.

    Round by round anchors visit the cells that their heap gives next, each round ``growth`` times as many rows as the one before it; a window that
    has ``k`` rows raises its low to the last one's score. An anchor is done when the next cell's bound is below all its
    lows, so nothing better can be anywhere. A round is a written table; one bit of it comes to the driver.
    """
    progress = anchors.withColumn("popped", F.lit(0)).select("row", "vec_id", "label", "vec", "popped", "lows", "highs")
    found, budget = None, first
    while True:
        plan = materialize(progress.mapInArrow(_planned(directory, budget), PLANNED), "mined-plan")
        requests = plan.where("shelf >= 0")
        if requests.isEmpty():
            break
        answers = _met(index, requests, k, same, tile, block)
        found = materialize(_first(answers if found is None else found.drop("rank").unionByName(answers), k), "mined-found")
        full = found.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))
        kept = plan.where("shelf < 0").drop("shelf", "codes").join(full, F.col("row") == F.col("anchor"), "left")
        lows = F.transform("lows", lambda low, w: F.greatest(low, F.try_element_at("reached", w.cast("int"))))
        progress = kept.withColumn("lows", lows).drop("anchor", "reached")
        budget *= growth
    return found if found is not None else anchors.sparkSession.createDataFrame([], f"{FOUND}, rank int")


def hard_negatives(vectors: DataFrame, anchors: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, codes: int = CODES,
                   sample: int = SAMPLE, tile: int = TILE, block: int = REQUESTS, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: hard negatives of every anchor and positive.

    ``anchors`` is a condition on (vec_id, label); without it, ids divisible by 100. Rows with a null label, a null vector or a null or
    non-finite component (times 256 too) take no part; vectors of different lengths are never compared; null ids are
    never anchors and come last in ties; each of several rows with one id is a row of its own. Where vectors and labels
    are equal, only the first ``max(positives + 1, negatives)`` can come first anywhere, so further copies are not indexed.
    The search is exact whatever the codebooks. An empty table, or one without anchors, gives an empty result.
    """
    mark = tables_so_far(vectors.sparkSession)
    rows = prepared(vectors)
    copies = Window.partitionBy("vec", "label").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    distinct = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= max(positives + 1, negatives)).drop("copy")
    index, directory = indexed(distinct, codes, sample)
    asking = rows.where(F.col("vec_id") % 100 == 0 if anchors is None else anchors)
    all_scores = asking.withColumn("lows", F.array(F.lit(LEAST))).withColumn("highs", F.array(F.lit(MOST)))
    sizes = (tile, block, first, growth)
    near = nearest_in_windows(index, directory, all_scores, positives, True, *sizes)
    score = F.col("score").cast("decimal(38,0)")
    low, high = F.ceil(score * LOW / 100).cast("decimal(38,0)"), F.floor(score * HIGH / 100).cast("decimal(38,0)")
    bounds = near.select("anchor", "rank", F.when(low <= high, low.cast("long")).otherwise(MOST).alias("low"), F.when(low <= high, high.cast("long")).otherwise(LEAST).alias("high"))
    windows = bounds.groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))  # a handful: the positives of one anchor
    held = materialize(asking.join(windows, F.col("row") == F.col("anchor")).select("row", "vec_id", "label", "vec", F.col("w.low").alias("lows"), F.col("w.high").alias("highs")), "mined-windows")
    hard = nearest_in_windows(index, directory, held, negatives, False, *sizes)
    pairs = near.select("anchor", (F.col("rank") - 1).alias("window"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.withColumnRenamed("score", "negative_score").join(pairs, ["anchor", "window"]).join(asking.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return settle(out.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", "negative_score"), "mined", mark)
