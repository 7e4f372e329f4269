"""What the operators share: text columns as flat byte arrays inside tasks, and reading of the given tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"  # the words of every contract: runs of anything but ASCII blanks
PIECE = 4 << 20  # bytes of text that one vectorised step takes (a longer text is a step of its own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column in one array, and where each row begins and ends (n + 1 offsets); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    begin = int(offsets[0]) if len(offsets) else 0
    return raw[begin : int(offsets[-1]) if len(offsets) else 0], offsets - begin


def pieces(offsets: np.ndarray, most: int = PIECE):
    """Runs of rows (first, after the last) whose texts together stay near ``most`` bytes."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word; a word never reaches over the end of its row."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


LETTERS = np.random.default_rng(20240201).integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # multiplier of a byte by its place
LOWER = np.arange(256, dtype=np.uint64)
LOWER[ord("A") : ord("Z") + 1] += 32


def mixed_bits(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, A-Z as a-z, all words of the array at once."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = end - begin
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    value = (LOWER[raw[place + np.repeat(begin, size)]] + np.uint64(1)) * LETTERS[place & 1023]
    return mixed_bits(np.add.reduceat(value, at) + size.astype(np.uint64))
