"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by exact tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.session import materialize

SHINGLE = 3
SEED = 42
RADIUS = 2
TILE = 4096  # fingerprints that a tile aims at
STRIP = 256  # rows of a tile that are compared in one step
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """Fingerprint as an unsigned number: bit set where more than half of the shingles' hashes have it; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_digest
    if len(words) < width:
        hashes = digest(joined, SEED)
    else:
        hashes = b"".join([digest(joined[s : e - 1], SEED) for s, e in zip([0, *ends], ends[width - 1 :], strict=False)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(rows), HASHES_AT_ONCE):
        ones += np.unpackbits(rows[k : k + HASHES_AT_ONCE], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``, one row per document, the fingerprint as a signed long. Null and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.fromiter((fingerprint(t, width) for t in batch.column(1).cast(pa.large_binary()).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _stars(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Joins the classes of the linked rows: the smallest row number of a class becomes its label."""
    while True:
        low = np.minimum(labels[left], labels[right])
        if (low == labels[left]).all() and (low == labels[right]).all():
            return
        np.minimum.at(labels, labels[left], low)
        np.minimum.at(labels, labels[right], low)
        labels[:] = labels[labels]


def linked(marks: np.ndarray, split: int | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside a tile (``split`` is None) or between two (rows before and after ``split``), as a star per class.

    Rows of a side are sorted by population count, so that a strip is compared only with rows within the radius of it.
    """
    ones = np.bitwise_count(marks).astype(np.int16)
    labels = np.arange(len(marks))
    stop, base = (len(marks), 0) if split is None else (split, split)
    for k in range(0, stop, STRIP):
        end = min(k + STRIP, stop)
        first = base + int(np.searchsorted(ones[base:], ones[k] - radius, "left"))
        last = base + int(np.searchsorted(ones[base:], ones[end - 1] + radius, "right"))
        if split is None:
            first = max(first, k)
        near = np.bitwise_count(marks[k:end, None] ^ marks[None, first:last]) <= radius
        i, j = np.nonzero(near)
        i, j = i + k, j + first
        if len(i):
            _stars(labels, i, j)
    out = np.flatnonzero(labels != np.arange(len(marks)))
    return marks[out], marks[labels[out]]


def _compare(radius: int):
    """Task: rows sorted by tile pair and side come in; links of each tile pair go out. Holds one tile pair at a time."""

    def groups(batches: Iterator[pa.RecordBatch]):
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if held:
                rows = np.concatenate([*held, rows])
            cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            if len(cut):
                yield rows[: cut[-1]], np.concatenate(([0], cut))
                held = [rows[cut[-1] :]]
            else:
                held = [rows]
        if held:
            yield held[0], np.array([0, len(held[0])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in groups(batches):
            marks, side = np.ascontiguousarray(rows[:, 5]).view(np.uint64), rows[:, 4]
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            two = two[(np.bitwise_count(marks[two] ^ marks[two + 1]) <= radius)]
            a, b = [marks[two + 1]], [marks[two]]
            for k in np.flatnonzero(sizes > 2):
                s, e = bounds[k], bounds[k + 1]
                split = None if rows[s, 2] == rows[s, 3] else int(np.searchsorted(side[s:e], 1))
                x, y = linked(marks[s:e], split, radius)
                a.append(x)
                b.append(y)
            out = [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(out, names=["a", "b"])

    return run


def links(marks: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints (column ``fp``) that connect all within ``radius`` bits of each other.

    Fingerprints are dealt out by ``radius + 1`` runs of bits, of which any two within the radius share one unchanged. What
    shares a run is compared exactly, by exclusive-or and bit counts, in tiles. Where more than ``tile`` share one, they are
    cut into tiles by population count (and by hash where a count has too many); each pair of tiles is a task's work of
    its own, and pairs of tiles whose population counts differ beyond the radius are skipped. No link is lost, no task
    holds more than two tiles, and of each pair of tiles only a star per linked class is emitted.
    """
    width = [64 // (radius + 1) + (k < 64 % (radius + 1)) for k in range(radius + 1)]
    shifts = [sum(width[:k]) for k in range(radius + 1)]
    runs = F.array(*[F.struct(F.lit(k).alias("run"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias("value"))
                     for k, (s, w) in enumerate(zip(shifts, width, strict=True))])
    dealt = marks.select("fp", F.inline(runs)).withColumn("ones", F.bit_count("fp").cast("int"))
    crowded = dealt.groupBy("run", "value").count().where(F.col("count") > tile).drop("count")
    cells = dealt.join(crowded, ["run", "value"], "left_semi").groupBy("run", "value", "ones").agg(
        F.ceil(F.count("*") / tile).cast("int").alias("cuts"))
    tiles = cells.groupBy("run", "value").agg(F.map_from_entries(F.collect_list(F.struct("ones", "cuts"))).alias("cuts"))  # 65 entries at most
    placed = dealt.join(tiles, ["run", "value"], "left")
    wide, alone = F.lit(1 << 32), F.lit(-1).cast("long")
    own = F.col("ones") * wide + F.pmod(F.xxhash64("fp"), F.element_at("cuts", F.col("ones")))
    near = F.flatten(F.transform(F.filter(F.map_keys("cuts"), lambda o: F.abs(o - F.col("ones")) <= radius), lambda o: F.transform(
        F.sequence(F.lit(0), F.element_at("cuts", o) - 1), lambda c: o * wide + c)))
    pair = placed.select("run", "value", "ones", "fp", F.when(F.col("cuts").isNotNull(), own).otherwise(alone).alias("own"), F.explode(
        F.when(F.col("cuts").isNotNull(), near).otherwise(F.array(alone))).alias("other"))
    rows = pair.select("run", "value", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"),
                       (F.col("own") > F.col("other")).cast("int").alias("side"), "fp", "ones")
    key = ["run", "value", "t1", "t2"]
    sorted_rows = rows.repartition(*key).sortWithinPartitions(*key, "side", "ones").drop("ones")
    return sorted_rows.mapInArrow(_compare(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest doc_id that can be reached over links, for each document.

    Equal fingerprints are one node, so thousands of copies cost one comparison. Blank and null texts have fingerprint 0
    and are linked like any other. Rows that repeat a doc_id each get a result; a null doc_id is never a component_id
    unless no linked row has an id, when component_id is null. Long texts are read whole, in steps; other columns, whatever their
    names, play no part. An empty table gives an empty result.
    """
    marks = materialize(fingerprints(docs, width), "fingerprints")
    first = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = _least_of_components(first, radius).withColumnRenamed("least", "component_id")
    return marks.join(labels, "fp").select("doc_id", "fp", "component_id")


def _least_of_components(first: DataFrame, radius: int) -> DataFrame:
    """``(fp, least)``: the least value of its component for each fingerprint, from ``(fp, least)`` of the fingerprints themselves."""
    from pageloom.llm.graph import components

    found = components(links(first.select("fp"), radius), "a", "b").withColumnRenamed("node", "fp")
    members = materialize(found.join(first, "fp"), "linked")
    smallest = members.groupBy("component").agg(F.min("least").alias("of_all"))
    joined = members.join(smallest, "component").select(F.col("fp").alias("linked_fp"), "of_all")
    return first.join(joined, first["fp"] == joined["linked_fp"], "left").select("fp", F.coalesce("of_all", "least").alias("least"))


def one_of_each(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """One document of each component, that with the smallest id; columns as they came.

    Rows are told apart by a number that is written beside them with their fingerprint, so different texts under one id, or
    under none, are decided for themselves: no id goes before a null one, and of rows alike in id the first written
    stays. Blank and null texts are one component; long texts are read whole; an empty table gives an empty result.
    """
    number, mark = "_row", "_mark"
    while number in docs.columns or mark in docs.columns:
        number, mark = f"{number}_", f"{mark}_"

    names = [*docs.columns, mark]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(batch.columns) - 1).cast(pa.large_binary())
            marks = np.fromiter((fingerprint(t, width) for t in texts.to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks.view(np.int64))], names=names)

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"{mark} long"])
    marked = docs.select(*docs.columns, F.col("text").cast("string").alias(mark)).mapInArrow(run, kinds)
    rows = materialize(marked.withColumn(number, F.monotonically_increasing_id()), "marked")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").cast("long").alias("id"), F.col(number).alias("row"))
    first = materialize(rows.groupBy(F.col(mark).alias("fp")).agg(F.min(place).alias("least")), "first-of-marks")
    kept = _least_of_components(first, radius).select(F.col("least.row").alias(number)).distinct()
    return rows.join(kept, number, "left_semi").select(docs.columns)
