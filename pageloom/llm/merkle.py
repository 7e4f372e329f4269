"""Merkle manifest of a dataset, by time-forward processing: digests travel up through a queue ordered by node label, proofs travel back down."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import materialize, settle, tables_so_far

LEVELS = 12  # of a tree that a band covers: a task holds the messages of one block of 2 ** LEVELS nodes at a time
TAMPERED = 7  # rows whose crc32 it divides are tampered with
LEFT, RIGHT, NONE = "L", "R", "-"  # where a node's sibling stands, in a path

MESSAGE = "tree string, n long, place long, digest string, doc_id long, tampered string, name string"
DELIVERED = f"{MESSAGE}, path string, subroot string, root string"


def _h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def sized(value: Column) -> Column:
    """A field as a leaf takes it: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[sized(c) for c in (doc_id, source, lang, n_chars, text)]).cast("binary"), 256)


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(0))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``n``, the leaves of a row's tree, and ``place``, its number among them in ``order``, from 0.

    A tree may hold nearly all rows: rows are dealt out by range, each sorted range is numbered where it lies, and the
    offsets of the ranges are running sums over one row per range of a tree.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranges = materialize(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)), "merkle-order")
    spans = ranges.groupBy("tree", "range").agg(F.min("at").alias("begin"), F.count("*").alias("rows"))
    of_tree = Window.partitionBy("tree")
    before = F.sum("rows").over(of_tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = spans.select("tree", "range", "begin", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(of_tree).alias("n"))
    return ranges.join(offsets, ["tree", "range"]).withColumn("place", F.col("before") + F.col("at") - F.col("begin")).drop("at", "range", "begin", "before")


def forward(leaves: list[tuple[int, str]], n: int, base: int, top: int) -> dict[tuple[int, int], str]:
    """Digest of every node of a block from those of its lowest level, in order of label (level, place).

    The queue holds messages (label of the receiver, place of the sender, digest). The smallest label is next, all its
    messages are there by then, and what it works out goes to its parent, whose label is larger.
    """
    known: dict[tuple[int, int], str] = {}
    queue: list[tuple[int, int, int, str]] = []
    for place, digest in leaves:
        known[base, place] = digest
        if base < top:
            queue.append((base + 1, place >> 1, place, digest))
    heapify(queue)
    while queue:
        level, place, _, digest = heappop(queue)
        parts = [digest]
        while queue and queue[0][:2] == (level, place):
            parts.append(heappop(queue)[3])
        known[level, place] = own = _h(*parts)
        if level < top:
            heappush(queue, (level + 1, place >> 1, place, own))
    return known


def backward(known: dict[tuple[int, int], str], base: int, top: int, place: int, path: str) -> dict[int, str]:
    """Path of every node of a block's lowest level, from the path of its highest node, in falling order of label.

    A path has for each level upward a letter, where the sibling stands, and the sibling's digest.
    """
    paths: dict[int, str] = {}
    queue = [(-top, -place, path)]
    while queue:
        level, place, path = heappop(queue)
        level, place = -level, -place
        if level == base:
            paths[place] = path
            continue
        left, right = (level - 1, 2 * place), (level - 1, 2 * place + 1)
        if right in known:
            heappush(queue, (-left[0], -left[1], f"{RIGHT}{known[right]}{path}"))
            heappush(queue, (-right[0], -right[1], f"{LEFT}{known[left]}{path}"))
        else:
            heappush(queue, (-left[0], -left[1], NONE + path))
    return paths


def siblings(path: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(path):
        step = 1 if path[at] == NONE else 65
        yield path[at], path[at + 1 : at + step]
        at += step


def folded(digest: str, path: str) -> str:
    """The root that a leaf's digest and its path lead to."""
    for side, other in siblings(path):
        digest = _h(other, digest) if side == LEFT else _h(digest, other)
    return digest


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one block after the other; rows come sorted by tree and block, and a block has at most 2 ** LEVELS and one."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["tree"], row["block"]) != key:
                if held:
                    yield held
                held, key = [], (row["tree"], row["block"])
            held.append(row)
    if held:
        yield held


def _bounds(n: int, band: int, levels: int) -> tuple[int, int]:
    height = (n - 1).bit_length()
    return min(band * levels, height), min((band + 1) * levels, height)


def _batches(rows: Iterator[dict], schema: pa.Schema, at_once: int = 4096) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    for row in rows:
        out.append(row)
        if len(out) == at_once:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _up(band: int, levels: int):
    """Task: messages of a band's lowest level come in, block by block; the messages that blocks send on go out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent():
            for rows in _blocks(batches):
                n = rows[0]["n"]
                base, top = _bounds(n, band, levels)
                known = forward([(r["place"], r["digest"]) for r in rows], n, base, top)
                place = rows[0]["place"] >> (top - base)
                yield {"tree": rows[0]["tree"], "n": n, "place": place, "digest": known[top, place]}

        yield from _batches(sent(), _arrow(MESSAGE))

    return run


def _down(band: int, levels: int):
    """Task: a band's messages, and for each block the path of its highest node; every message comes out with its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def delivered():
            for head, *rows in _blocks(batches):  # the path stands first: its place is -1
                base, top = _bounds(rows[0]["n"], band, levels)
                known = forward([(r["place"], r["digest"]) for r in rows], rows[0]["n"], base, top)
                place = rows[0]["place"] >> (top - base)
                paths = backward(known, base, top, place, head["path"])
                subroot = head["subroot"]
                for r in rows:
                    yield {k: r[k] for k in ("tree", "n", "place", "digest", "doc_id", "tampered", "name")} | {
                        "path": paths[r["place"]], "subroot": subroot, "root": head["root"]}

        yield from _batches(delivered(), _arrow(DELIVERED))

    return run


def _band(messages: DataFrame, band: int, levels: int) -> DataFrame:
    """The messages of the trees that reach into a band, with their blocks."""
    rows = messages.where(_height(F.col("n")) > band * levels) if band else messages
    return rows.withColumn("block", F.shiftright("place", levels))


def sweep_forward(leaves: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The queue's messages by band of levels, each a written table, and the root of every tree.

    The queue is external: tasks keep the messages of one block in a heap, and what leaves a band waits in a table until
    the next band takes it, so a tree of any size takes its height / ``levels`` rounds. One number comes to the driver.
    """
    most = leaves.agg(F.max("n")).first()[0] or 1
    queue, roots = [leaves], []
    for band in range(max(1, -((most - 1).bit_length() // -levels))):
        rows = _band(queue[band], band, levels).select("tree", "n", "block", "place", "digest")
        queue.append(materialize(_dealt(rows).mapInArrow(_up(band, levels), MESSAGE), f"merkle-queue-{band + 1}"))
        roots.append(queue[-1].where(_height(F.col("n")).between(band * levels + 1 if band else 0, (band + 1) * levels)))
    return queue[:-1], reduce(DataFrame.union, roots)


def sweep_backward(queue: list[DataFrame], seeds: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Every leaf with its path, from the paths of the roots: ``seeds`` has (tree, path, subroot, root)."""
    rows = None
    for band in reversed(range(len(queue))):
        messages = _band(queue[band], band, levels)
        tops = messages.where((F.col("place") == 0) & (_height(F.col("n")) <= (band + 1) * levels)).select("tree", "block").join(seeds, "tree")
        above = [] if rows is None else [rows.select("tree", F.col("place").alias("block"), "path", "subroot", "root")]
        heads = reduce(DataFrame.unionByName, [tops, *above]).withColumn("place", F.lit(-1).cast("long"))
        rows = _dealt(messages.unionByName(heads, allowMissingColumns=True)).mapInArrow(_down(band, levels), DELIVERED)
        if band:
            rows = materialize(rows, f"merkle-paths-{band}")
    return rows


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leaf, tampered, path = (batch.column(name).to_pylist() for name in ("leaf", "tampered", "path"))
        roots = [folded(t or d, p) for d, t, p in zip(leaf, tampered, path, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], names=[*batch.schema.names, "folded_root"])


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``(doc_id, leaf, tampered, subroot, root, path)`` of every document: its digest, its proof, and a digest to try the proof with.

    Leaves of a language ascend by doc_id (null first; equal ids by digest) under its subroot, subroots by language (null
    first, UTF-8 bytewise) under the root; a lone last node of a level is hashed alone. ``path`` names the siblings from
    the leaf to the root (a letter for the side, then 64 digits; ``-`` where there is none). ``tampered`` is null where a
    document is not tampered with. Null, empty and long texts are leaves like others, repeated rows leaves each; other
    columns of the input play no part; an empty table gives an empty manifest. Rows are ordered by range, so a language
    with nearly all rows is many tasks' work, and text is read once.
    """
    mark = tables_so_far(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")],
                        F.col("n_chars").cast("long").alias("n_chars"))
    hit = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0)
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    hashed = named.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), "doc_id", leaf_digest(*columns).alias("digest"),
                          F.when(hit, leaf_digest(*columns[:3], more, columns[4])).alias("tampered"))
    leaves = materialize(hashed.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    placed = _placed(leaves.withColumn("name", F.lit(None).cast("string")), ["doc_id", "digest", "row"]).drop("row")
    queue, subroots = sweep_forward(placed, levels)
    of_langs = _placed(subroots.select(F.lit("").alias("tree"), "digest", "doc_id", "tampered", F.col("tree").alias("name")), ["name"])
    upper, root = sweep_forward(of_langs, levels)
    seeds = root.select("tree", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    langs = materialize(sweep_backward(upper, seeds, levels).select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "merkle-langs")
    proven = sweep_backward(queue, langs, levels).select("doc_id", F.col("digest").alias("leaf"), "tampered", "subroot", "root", "path")
    return settle(proven, "merkle-manifest", mark)


def verified(proven: DataFrame) -> DataFrame:
    """Adds to a manifest ``proof_sha256``, ``folded_root`` (from the tampered digest, where there is one) and ``verified``."""
    folds = proven.mapInArrow(_folded, f"{', '.join(f'{c} {t}' for c, t in proven.dtypes)}, folded_root string")
    proof = F.sha2(F.regexp_replace("path", f"[{LEFT}{RIGHT}{NONE}]", "").cast("binary"), 256)
    return folds.withColumn("proof_sha256", proof).withColumn("verified", F.col("folded_root") == F.col("root"))
