"""Embedding near-duplicates: random projections decoded to points of the E8 lattice, neighbouring cells probed, cosines verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.graph import components
from pageloom.session import materialize

LEAST_COSINE = 0.9
TABLES = 6
PROBES = 2  # neighbouring cells that a vector looks into, in each table
SCALE = 0.6  # of the lattice, for unit vectors: at cosine 0.9 exactly, these four find 98.8 % of pairs, closer ones more
TILE = 4096
STRIP = 512
SEED = 8


def roots() -> np.ndarray:
    """The 240 shortest points of E8: the steps from a cell to its neighbours."""
    whole = [[a * (k == i) + b * (k == j) for k in range(8)] for i, j in combinations(range(8), 2) for a, b in product((1, -1), repeat=2)]
    half = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*whole, *half], float)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points whose sum is even."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decoded(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the nearer of the even integer point and the even point moved by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _names(points: np.ndarray, table: int, dimension: int) -> np.ndarray:
    """A 64-bit name of each cell of a table."""
    odd = np.random.default_rng((SEED, 1, table, dimension)).integers(1, 2**62, 8, dtype=np.int64) * 2 + 1
    h = ((2 * points).astype(np.int64) * odd).sum(1).view(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def cells(unit: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """Names of the cells of each row: (rows, tables, 1 + probes), the own cell first, then the nearest neighbours."""
    steps, dimension = roots(), unit.shape[1]
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    for t in range(tables):
        x = unit @ (np.random.default_rng((SEED, 0, t, dimension)).normal(size=(dimension, 8)) / np.sqrt(8)) / scale
        home = decoded(x)
        out[:, t, 0] = _names(home, t, dimension)
        if probes:
            nearest = np.argpartition(-((x - home) @ steps.T), probes - 1, axis=1)[:, :probes]
            for k in range(probes):
                out[:, t, k + 1] = _names(home + steps[nearest[:, k]], t, dimension)
    return out


def _units(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _placed(tables: int, probes: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths())
            codes = np.empty((batch.num_rows, tables * (1 + probes)), np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                codes[rows] = cells(_units(lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)),
                                    tables, probes, scale).reshape(len(rows), -1)
            flat = pa.array(codes.ravel())
            offsets = pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(offsets, flat)],
                                             names=["node", "embedding", "members", "codes"])

    return run


def _first_meeting(a: np.ndarray, b: np.ndarray, table: int, cell: np.ndarray) -> np.ndarray:
    """Whether this cell of this table is the first place where the rows of codes a and b meet, so that a link counts once."""
    here = np.ones(len(a), bool)
    for t in range(table + 1):
        at_a = (a[:, t, :1] == b[:, t, :]).any(1)  # b looks into a's own cell
        at_b = (b[:, t, :1] == a[:, t, :]).any(1)
        if t < table:
            here &= ~(at_a | at_b)
        else:
            here &= np.where(at_a & at_b, np.minimum(a[:, t, 0], b[:, t, 0]) == cell, True)
    return here


def _verified(least: float, tables: int, probes: int):
    """Task: the rows of one cell (or pair of tiles of it) at a time; counts of links and a star per linked class come out."""

    def meet(group: dict) -> Iterator[tuple]:
        unit, home, side = _units(group["vector"]), group["probe"] == 0, group["side"]
        codes, weight = group["codes"].reshape(len(unit), tables, 1 + probes), group["members"].astype(np.float64)
        table, cell, node = int(group["key"][0]), group["key"][1], group["node"]
        alone = group["key"][2] == group["key"][3]
        order = np.argsort(~home, kind="stable")  # own cells first: two rows that only look in here do not meet here
        owners = int(home.sum())
        counts, labels = np.zeros(len(unit)), np.arange(len(unit))
        for k in range(0, owners, STRIP):
            rows = order[k : min(k + STRIP, owners)]
            close = unit[rows] @ unit[order].T >= least
            i, j = np.nonzero(close)
            later = (j > i + k) & (node[rows[i]] != node[order[j]])
            if not alone:
                later &= side[rows[i]] != side[order[j]]
            i, j = rows[i[later]], order[j[later]]
            first = _first_meeting(codes[i], codes[j], table, cell)
            i, j = i[first], j[first]
            if len(i):
                counts += np.bincount(i, weight[j], len(unit)) + np.bincount(j, weight[i], len(unit))
                while True:
                    low = np.minimum(labels[i], labels[j])
                    if (low == labels[i]).all() and (low == labels[j]).all():
                        break
                    np.minimum.at(labels, labels[i], low)
                    np.minimum.at(labels, labels[j], low)
                    labels = labels[labels]
        found = np.flatnonzero(counts)
        return node[found], counts[found].astype(np.int64), node[labels[found]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        names = ["table", "cell", "t1", "t2"]

        def groups():
            nonlocal held
            for batch in batches:
                if not batch.num_rows:
                    continue
                t = pa.Table.from_batches([batch])
                held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
                keys = np.stack([held[n].to_numpy() for n in names], 1)
                cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
                if len(cut):
                    yield from parts(held, keys, np.concatenate(([0], cut)))
                    held = held.slice(int(cut[-1]))
            if held is not None:
                keys = np.stack([held[n].to_numpy() for n in names], 1)
                yield from parts(held, keys, np.array([0, held.num_rows]))

        def parts(rows, keys, bounds):
            sizes = np.diff(bounds)
            for k in np.flatnonzero(sizes > 1):
                part = rows.slice(int(bounds[k]), int(sizes[k])).combine_chunks()
                probe = part["probe"].to_numpy()
                if (probe == 0).any():
                    yield {"key": keys[bounds[k]], "probe": probe, "side": part["side"].to_numpy(), "node": part["node"].to_numpy(),
                           "members": part["members"].to_numpy(),
                           "vector": part["embedding"].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(int(sizes[k]), -1),
                           "codes": part["codes"].chunk(0).flatten().to_numpy(zero_copy_only=False)}

        for group in groups():
            node, n, root = meet(group)
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), pa.array(root)], names=["node", "n", "root"])

    return run


def similar_vectors(vectors: DataFrame, least: float = LEAST_COSINE, tables: int = TABLES, probes: int = PROBES,
                    scale: float = SCALE, tile: int = TILE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every vector: how many others it is linked to, and its component.

    Equal vectors are one node that carries their number. A node is dealt to its cell in each table and to the nearest
    neighbouring cells; nodes that meet where one of them lives are compared in double precision. A cell with more than
    ``tile`` rows is cut into tiles by hash, and each pair of tiles is a task's work of its own: nothing is capped. Tasks
    send out counts per node and a star per linked class, no pairs; a link that several tables find counts where they
    find it first. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. A null vec_id is never a component_id unless all ids of its component are null.
    """
    ids = vectors.select(F.col("vec_id").cast("long"), "embedding")
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = ids.where(F.coalesce(usable, F.lit(False)))
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("members"))
    nodes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    kind = nodes.schema["embedding"].dataType.simpleString()
    placed = nodes.select("node", "embedding", "members").mapInArrow(
        _placed(tables, probes, scale), f"node long, embedding {kind}, members long, codes array<long>")
    slots = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(p).alias("probe"), F.col("codes")[t * (1 + probes) + p].alias("cell"))
                      for t in range(tables) for p in range(1 + probes)])
    codes = materialize(placed.select("node", "members", "embedding", "codes"), "codes")
    narrow = codes.select(F.inline(slots))
    crowded = narrow.groupBy("table", "cell").count().where(F.col("count") > tile).select(
        "table", "cell", F.ceil(F.col("count") / tile).cast("long").alias("cuts"))
    rows = codes.select("node", "members", "embedding", "codes", F.inline(slots)).join(crowded, ["table", "cell"], "left")
    cuts = F.coalesce("cuts", F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64("node"), cuts)
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), cuts - 1)))
    pairs = dealt.select("table", "cell", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"),
                         (F.col("own") > F.col("other")).cast("int").alias("side"), "probe", "node", "members", "embedding", "codes")
    key = ["table", "cell", "t1", "t2"]
    met = materialize(pairs.repartition(*key).sortWithinPartitions(*key).mapInArrow(
        _verified(least, tables, probes), "node long, n long, root long"), "links")
    parts = components(met.select("node", "root").distinct(), "node", "root")
    members = nodes.select("node", "first_id").join(parts, "node")
    smallest = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = members.join(smallest, "component").select("node", "component_id")
    counts = met.groupBy("node").agg(F.sum("n").alias("n"))
    labels = nodes.join(counts, "node", "left").join(linked, "node", "left").select(
        "embedding", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
    joined = good.join(labels, "embedding").select("vec_id", "n_links", "component_id")
    alone = ids.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
