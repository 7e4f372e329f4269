"""Exact vector search with bounds: unit vectors in partitions with a centre and a radius, of which only those are read that can hold a hit.

Cosine order is distance order of unit vectors. A vector of a partition is no nearer to the query than the centre's distance
less the radius, so a partition whose nearest possible vector is farther than the k-th hit so far is skipped whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import materialize, salts

CELLS = 64  # partitions
SAMPLE = 20_000  # vectors that centres are fitted on; every vector is in the index
FITTING = 6  # rounds of it
NONE = -1  # the partition of rows without a direction: null, zero, or of another length than the centres
ROUNDING = 1e-9  # that bounds are widened by


@dataclass
class VectorIndex:
    """``rows``: the corpus with ``unit`` for ``embedding`` and ``cell``, a table with a folder per cell; a centre, a radius and a count per cell."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    counts: np.ndarray


def _units(lists: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors of the lists that have ``size`` finite components and a direction."""
    lengths = np.asarray(lists.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == size) if size else np.zeros(0, np.int64)
    values = lists.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), size) if len(rows) else np.zeros((0, size))
    good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
    rows, values = rows[good], values[good]
    values = values / np.abs(values).max(axis=1, keepdims=True, initial=0) if len(rows) else values  # squares neither overflow nor vanish
    return rows, values / np.linalg.norm(values, axis=1, keepdims=True)


def _fitted(cells: int):
    """Task: the sample comes in; the centres of at most ``cells`` groups of it go out, of the most frequent length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [b.column(0) for b in batches if b.num_rows]
        if not lists:
            return
        every = pa.concat_arrays(lists)
        lengths = np.asarray(every.value_lengths())
        size = int(np.bincount(lengths).argmax())
        units = np.unique(_units(every, size)[1], axis=0)
        if not len(units):
            return
        centres = units[np.random.default_rng(7).permutation(len(units))[:cells]]
        for _ in range(FITTING):
            near = (units @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
            centres = np.stack([units[near == k].mean(axis=0) for k in np.unique(near)])
        yield pa.RecordBatch.from_arrays([pa.array(list(centres), pa.list_(pa.float64()))], names=["centre"])

    return run


def _placed(centres: np.ndarray, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, units = _units(batch.column(at), centres.shape[1])
            cell, far = np.full(batch.num_rows, NONE, np.int32), np.zeros(batch.num_rows)
            unit: list[Any] = [None] * batch.num_rows
            if len(rows):
                near = (units @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
                cell[rows], far[rows] = near, np.linalg.norm(units - centres[near], axis=1)
                for k, u in zip(rows.tolist(), units, strict=True):
                    unit[k] = u
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            names = [n for k, n in enumerate(batch.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(unit, pa.list_(pa.float64())), pa.array(far), pa.array(cell)], names=[*names, "unit", "far", "cell"])

    return run


def build_index(corpus: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> VectorIndex:
    """Index of a corpus with an ``embedding`` column, written once; searches read from it.

    Centres are fitted in one task on a bounded sample, picked by hash; the quality of the fit decides how much is skipped, never
    what is found. Beyond the centres, a number per cell comes to the driver.
    """
    picked = corpus.where("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null)").select(
        F.col("embedding").cast("array<double>").alias("embedding")).orderBy(F.xxhash64("embedding"), "embedding").limit(sample).coalesce(1)
    found = picked.mapInArrow(_fitted(cells), "centre array<double>").collect()
    centres = np.array([r["centre"] for r in found]) if found else np.zeros((1, 0))
    rest = [f for f in corpus.schema.fields if f.name != "embedding"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["unit array<double>", "far double", "cell int"])
    placed = corpus.mapInArrow(_placed(centres, corpus.columns.index("embedding")), schema)
    # By range, so that a cell lies in a few files and a full one in several.
    rows = materialize(placed.repartitionByRange("cell", F.xxhash64(*[f.name for f in rest])), "vector-index", by="cell")
    radii, counts = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in rows.where(F.col("cell") != NONE).groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
        radii[r["cell"]], counts[r["cell"]] = r["far"], r["n"]
    return VectorIndex(rows.drop("far"), centres, radii, counts)


def most_similar(index_centres: np.ndarray, radii: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Greatest cosine that a vector of each cell can have with each query (rows) of length 1."""
    near = np.maximum(0.0, np.linalg.norm(queries[:, None, :] - index_centres[None, :, :], axis=2) - radii - ROUNDING)
    return 1.0 - near**2 / 2 + ROUNDING


def _scored(query: np.ndarray, k: int, at: int):
    """Task: rows come in; per Arrow batch, the rows that can be among its first ``k`` go out with their similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = batch.column(at)
            known = np.flatnonzero(np.asarray(units.is_valid()))
            score = np.full(batch.num_rows, np.nan)
            if len(known):
                score[known] = units.take(pa.array(known)).flatten().to_numpy(zero_copy_only=False).reshape(len(known), len(query)) @ query
            order = np.argsort(-np.where(np.isnan(score), -np.inf, score), kind="stable")
            last = score[order[min(k, len(order)) - 1]]
            keep = np.flatnonzero((score >= last) | np.isnan(last))
            part = batch.take(pa.array(keep))
            columns = [c for i, c in enumerate(part.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score[keep], mask=np.isnan(score[keep]))],
                                             names=[n for i, n in enumerate(part.schema.names) if i != at] + ["similarity"])

    return run


def _order() -> list[Column]:
    return [F.col("similarity").desc_nulls_last(), F.col("id")]


def search(index: VectorIndex, query: list[float], k: int, where: dict[str, Any] | None = None) -> tuple[DataFrame, list[int]]:
    """The ``k`` rows most similar to a query, filtered on columns, ties by ``id``; and the cells that were read.

    Cells are read from the nearest on until they hold ``k`` rows; then, in one more pass, all others whose bound reaches the
    k-th similarity. A row without a direction has no similarity and comes last, as all do for a query without one.
    """
    vector = np.array(query, np.float64)
    length = np.linalg.norm(vector)
    rows = index.rows
    for column, value in (where or {}).items():
        rows = rows.filter(F.col(column) == F.lit(value))
    kept = [f for f in rows.schema.fields if f.name != "unit"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["similarity double"])
    at = rows.columns.index("unit")

    def best(cells: list[int]) -> DataFrame:
        return rows.where(F.col("cell").isin(cells)).mapInArrow(_scored(vector / length, k, at), schema).orderBy(*_order()).limit(k)

    everything = [NONE, *range(len(index.counts))]
    if not length or index.centres.shape[1] != len(vector):
        none = rows.select(*[f.name for f in kept], F.lit(None).cast("double").alias("similarity")).orderBy(*_order()).limit(k)
        return none.drop("cell"), everything
    bound = most_similar(index.centres, index.radii, (vector / length)[None, :])[0]
    order = np.argsort(-bound, kind="stable")
    enough = int(np.searchsorted(np.cumsum(index.counts[order]), k)) + 1
    first = [int(c) for c in order[:enough]]
    found = materialize(best(first), "nearest-cells")
    reached = found.agg(F.count("similarity").alias("n"), F.min("similarity").alias("least")).first()
    least = reached["least"] if reached["n"] == k else -np.inf
    more = [int(c) for c in order[enough:] if bound[c] >= least] + ([NONE] if reached["n"] < k else [])
    out = found.unionByName(best(more)).orderBy(*_order()).limit(k) if more else found.orderBy(*_order())
    return out.drop("cell"), sorted(first + more)


def _nearest(centres: np.ndarray, radii: np.ndarray, k: int):
    """Task: the queries of a report, then a part of its rows, cell by cell; the first ``k`` rows of the part for each query go out.

    A cell is passed over where no query's bound reaches the query's k-th similarity so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, queries, bounds = None, [], np.zeros((0, centres.shape[1])), np.zeros((0, len(centres)))
        best: list[tuple[np.ndarray, np.ndarray]] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            for query, (scores, rows) in zip(ids, best, strict=True):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array([query] * len(rows), pa.int64()), pa.array([key[0]] * len(rows), pa.string()), pa.array(rows),
                                                      pa.array(scores, mask=np.isnan(scores))], names=["query_id", "report_id", "id", "similarity"])

        for batch in batches:
            names = ["report_id", "part", "kind", "cell"]
            keys = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
            start = 0
            while start < len(keys):
                stop = start
                while stop < len(keys) and keys[stop] == keys[start]:
                    stop += 1
                now, kind, cell = keys[start][:2], keys[start][2], keys[start][3]
                run_of = batch.slice(start, stop - start)
                start = stop
                if now != key:
                    yield from flushed()
                    key, ids, best = now, [], []
                    queries = np.zeros((0, centres.shape[1]))
                vectors, known = run_of.column("unit"), np.asarray(run_of.column("unit").is_valid())
                matrix = np.full((len(known), centres.shape[1]), np.nan)
                if known.any():
                    matrix[known] = vectors.take(pa.array(np.flatnonzero(known))).flatten().to_numpy(zero_copy_only=False).reshape(-1, centres.shape[1])
                if kind == 0:
                    ids += run_of.column("id").to_pylist()
                    queries = np.concatenate((queries, matrix))
                    best += [(np.zeros(0), np.zeros(0, np.int64))] * len(known)
                    bounds = most_similar(centres, radii, queries)
                    continue
                row_ids = run_of.column("id").to_numpy()
                least = np.array([s[-1] if len(s) == k else -np.inf for s, _ in best])
                can = np.ones(len(ids), bool) if cell == NONE else ~(bounds[:, cell] < least)
                scores = np.where(known & np.isfinite(queries[can]).all(axis=1, keepdims=True), np.nan_to_num(queries[can]) @ np.nan_to_num(matrix).T, np.nan)
                for q, line in zip(np.flatnonzero(can).tolist(), scores, strict=True):
                    every, rows = np.concatenate((best[q][0], line)), np.concatenate((best[q][1], row_ids))
                    order = np.lexsort((rows, -np.where(np.isnan(every), -np.inf, every)))[:k]
                    best[q] = every[order], rows[order]
        if key is not None:
            yield from flushed()

    return run


def search_batch(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, report_id, id, similarity, pos)``: the first ``k`` rows for each of many queries, each within its own report.

    ``queries``: ``query_id, report_id, query``. A report's rows are dealt over parts by hash, to each of which its queries go; a part holds
    ``k`` rows per query, and compares an Arrow batch of rows with all queries that its cell can matter to at once.
    """
    size, spark = index.centres.shape[1], index.rows.sparkSession
    parts = salts(spark)
    asked = queries.select("query_id", "report_id", F.col("query").cast("array<double>").alias("embedding"))
    unit = asked.mapInArrow(_placed(index.centres, 2), "query_id long, report_id string, unit array<double>, far double, cell int")
    given = unit.select("report_id", F.explode(F.array(*[F.lit(p) for p in range(parts)])).alias("part"), F.lit(0).alias("kind"), F.lit(NONE).alias("cell"),
                        F.col("query_id").alias("id"), "unit")
    rows = index.rows.join(queries.select("report_id").distinct(), "report_id", "left_semi").select(
        "report_id", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "cell", F.col("id").cast("long").alias("id"), "unit")
    key = ["report_id", "part"]
    dealt = given.unionByName(rows).repartition(*key).sortWithinPartitions(*key, "kind", "cell")
    near = dealt.mapInArrow(_nearest(index.centres if size else np.zeros((1, 0)), index.radii, k), "query_id long, report_id string, id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(*_order())
    return near.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def match_documents(corpus: DataFrame, query: list[float], k: int, where: dict[str, Any] | None = None) -> DataFrame:
    """``search`` in a corpus that has no index yet."""
    return search(build_index(corpus), query, k, where)[0]


def match_batch(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``search_batch`` in a corpus that has no index yet."""
    return search_batch(build_index(corpus), queries, k)
