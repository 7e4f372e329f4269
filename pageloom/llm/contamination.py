"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.columns import flat, mixed_bits, pieces, word_bounds, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_CHARS = 4_000_000  # characters of test items that one pass over the documents looks for

PLACES = np.random.default_rng(20240202).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # multiplier of a word by its place in a shingle


def shingle_hashes(words: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words that lie in one row, and those rows."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += words[k : k + n] * PLACES[k]
    whole = row[:n] == row[width - 1 :]
    return mixed_bits(total[whole]), row[:n][whole]


def shingles(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)}


class Items:
    """Test items ready for search: per shingle width, sketches (least hashes) that lead to items, and their shingles.

    Items are partitioned by size: those of 2^k to 2^(k+1) - 1 distinct shingles share a sketch size. An item that is
    contained at ``threshold`` misses at most (1 - threshold) of its shingles, so with one more least hash than the largest
    item of the partition may miss, a document that contains it has one of them: the search loses nothing.
    """

    def __init__(self, rows: list[tuple[int, str | None]], width: int, threshold: float):
        self.threshold, self.parts = threshold, {}
        for item, text in rows:
            words = (text or "").encode().lower().split()
            if not words:
                continue
            own = min(width, len(words))
            wanted = sorted(shingles(words, own))
            raw, offsets = flat(pa.array([b.decode() for b in wanted]))
            begin, end = word_bounds(raw, offsets)
            row = np.searchsorted(offsets, begin, "right") - 1
            hashes = np.sort(shingle_hashes(word_hashes(raw, begin, end), row, own)[0])
            largest = (1 << len(wanted).bit_length()) - 1
            part = self.parts.setdefault(own, ([], [], []))
            sketch = hashes[: int((1 - threshold) * largest + 1e-9) + 1]
            part[0].append(sketch)
            part[1].append(np.full(len(sketch), len(part[2])))
            part[2].append((item, frozenset(wanted)))
        for own, (hashes, to, items) in self.parts.items():
            hashes, to = np.concatenate(hashes), np.concatenate(to)
            order = np.argsort(hashes, kind="stable")
            sieve = np.zeros(1 << 16, bool)
            sieve[hashes >> np.uint64(48)] = True
            self.parts[own] = (hashes[order], to[order], items, sieve)

    def found(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, its shingles, those in the row) of every item contained in a row of the column."""
        raw_all, offsets_all = flat(column)
        for first, last in pieces(offsets_all):
            offsets = offsets_all[first : last + 1] - offsets_all[first]
            raw = raw_all[offsets_all[first] : offsets_all[last]]
            begin, end = word_bounds(raw, offsets)
            row = np.searchsorted(offsets, begin, "right") - 1
            words = word_hashes(raw, begin, end)
            for width, (sketch, to, items, sieve) in self.parts.items():
                hashes, rows = shingle_hashes(words, row, width)
                passed = sieve[hashes >> np.uint64(48)]
                hashes, rows = hashes[passed], rows[passed]
                low, high = np.searchsorted(sketch, hashes, "left"), np.searchsorted(sketch, hashes, "right")
                pairs = {(int(rows[i]), int(to[k])) for i in np.flatnonzero(high > low) for k in range(low[i], high[i])}
                texts: dict[int, set[bytes]] = {}
                for r, k in sorted(pairs):
                    if r not in texts:
                        texts = {r: shingles(raw[offsets[r] : offsets[r + 1]].tobytes().lower().split(), width)}
                    item, wanted = items[k]
                    shared = len(wanted & texts[r])
                    if shared >= self.threshold * len(wanted) - 1e-9:
                        yield first + r, item, len(wanted), shared


def _blocks(items: DataFrame, width: int, threshold: float, block_chars: int) -> Iterator[Items]:
    """The items in blocks of about ``block_chars`` characters, so that what a task holds does not grow with their number."""
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // block_chars))
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        yield Items([(r[0], r[1]) for r in rows], width, threshold)


def contained_items(docs: DataFrame, items: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD,
                    block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared, containment)``: items of which a document holds enough distinct shingles.

    Words are runs of anything but ASCII blanks, A-Z as a-z; an item of fewer words than a shingle is one shingle of all its
    words. Items and documents that are null or blank match nothing. Rows that repeat an id or a text give a result each.
    Documents are never shuffled; the pass is repeated for each block of items.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def search(block: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(block.found(batch.column(1)))
                row, item, size, shared = (np.array(x, np.int64) for x in (zip(*hits, strict=True) if hits else [[]] * 4))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *map(pa.array, (item, size, shared))],
                                                 names=["doc_id", "item_id", "n_shingles", "n_shared"])

        return source.mapInArrow(run, "doc_id long, item_id long, n_shingles long, n_shared long")

    found = reduce(DataFrame.union, [search(b) for b in _blocks(items, width, threshold, block_chars)])
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def clean_documents(docs: DataFrame, items: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD,
                    block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that contain no item, with all their columns, without a shuffle."""

    def without(kept: DataFrame, block: Items) -> DataFrame:
        place = kept.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                stays[[hit[0] for hit in block.found(batch.column(place))]] = False
                yield pa.RecordBatch.from_arrays([pc.filter(c, pa.array(stays)) for c in batch.columns], schema=batch.schema)

        return kept.mapInArrow(run, kept.schema)

    return reduce(without, _blocks(items, width, threshold, block_chars), docs)
