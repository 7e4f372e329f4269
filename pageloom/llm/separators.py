"""Token counts by separator scan: end-of-document identifiers searched for in flat token files that have no index."""

from __future__ import annotations

import base64
import posixpath
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.session import materialize, shared_folder

BLOCK = 4 << 20  # bytes of a file that one step reads
TEXTS_AT_ONCE = 4 << 20  # characters that are tokenised before they are written
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value: how this vocabulary splits text
BLANKS = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"  # white space as that pattern sees it
LONG_RUN = 10_000  # of white space, from which on a run is cut out before the pattern, whose search ends on its stack at about a million
SEPARATOR = 50256  # free in this vocabulary, so no text has it


LONG_RUNS = re.compile(f"{BLANKS}{{{LONG_RUN},}}")


def encoder(ranks: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def encoded(coder, text: str) -> list[int]:
    """Identifiers of a text, however long its runs of white space.

    The pattern takes of a run all but the last blank as one piece, or the whole run at the end of the text, and pieces are
    encoded for themselves. So long runs are cut out as these pieces, and the text between them is split by the pattern.
    """
    out, at = [], 0
    if len(text) >= LONG_RUN:
        for run in LONG_RUNS.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += coder.encode_ordinary(text[at : run.start()])
            out += coder._encode_single_piece(text[run.start() : end])
            at = end
    return out + coder.encode_ordinary(text[at:])


def _opened(uri: str):
    """File system and path of a URI: any store that Arrow reads."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def write_token_files(docs: DataFrame, folder: str, ranks: str = RANKS, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """Tokenises documents into flat files, an identifier of ``width`` bytes after the other, a separator after each document.

    Returns ``(file, place, doc_id)``, written once: which document is the how-manieth of which file. Each task writes a
    file under a name of its own, and only files named in the table that Spark committed count: what a lost or repeated
    task leaves behind is in no row. Null and empty texts are documents of no tokens. A text is tokenised whole.
    """
    kind = {2: np.uint16, 4: np.uint32}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks)
        name, place, out = f"{uuid.uuid4().hex}.bin", 0, None
        store, path = _opened(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(posixpath.join(path, name))
            for text in batch.column(1):
                ids = encoded(coder, text.as_py() or "")
                ids.append(separator)
                out.write(np.array(ids, kind).tobytes())
            rows = np.arange(place, place + batch.num_rows)
            place += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(rows), batch.column(0)], names=["file", "place", "doc_id"])
        if out is not None:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file string, place long, doc_id long")
    return materialize(rows, "token-files")


def _scanned(folder: str, separator: int, width: int):
    """Task: blocks come in, and for each go out where it has separators (identifiers counted from the file's begin)."""
    kind = {2: np.uint16, 4: np.uint32}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _opened(folder)
        for batch in batches:
            for file, block, begin, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(posixpath.join(path, file)) as source:
                    ids = np.frombuffer(source.read_at(size, begin), kind)
                found = np.flatnonzero(ids == separator) + begin // width
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([(begin + len(ids) * width) // width], pa.int64()),
                                                  pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))], names=["file", "block", "stop", "found"])

    return run


def file_sizes(files: DataFrame, folder: str) -> DataFrame:
    """``(file, bytes)`` of named files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _opened(folder)
        for batch in batches:
            names = batch.column(0).to_pylist()
            sizes = [store.get_file_info(posixpath.join(path, n)).size for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["file", "bytes"])

    return files.select("file").mapInArrow(run, "file string, bytes long")


def document_lengths(files: DataFrame, folder: str, separator: int = SEPARATOR, width: int = 2, block: int = BLOCK) -> DataFrame:
    """``(file, place, start, n_tokens, closed)``: every document of flat token files, found by its separator.

    Files are cut into blocks that any task may read alone. A block reports where its separators are; a prefix scan over
    the blocks of a file (how many separators came before, and where the last one was) numbers the documents and gives the
    first of each block its begin, however many blocks it reaches over. What follows the last separator is a document
    that is not ``closed``; two separators in a row enclose a document of no tokens. A file that is no whole number of
    identifiers is an error; an empty file has no documents.
    """
    if block % width:
        raise ValueError("a block must hold whole identifiers")
    sizes = file_sizes(files, folder)
    checked = sizes.withColumn("bytes", F.when(F.col("bytes") % width == 0, F.col("bytes")).otherwise(
        F.raise_error(F.concat(F.lit("not a whole number of identifiers: "), "file"))))
    starts = checked.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(block).cast("long"))).alias("begin"))
    blocks = starts.select("file", (F.col("begin") / block).cast("long").alias("block"), "begin", F.least(F.lit(block).cast("long"), F.col("bytes") - F.col("begin")).alias("size"))
    spread = blocks.repartition("file", "block")
    scanned = materialize(spread.mapInArrow(_scanned(folder, separator, width), "file string, block long, stop long, found array<long>"), "separators")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summary = scanned.select("file", "block", "stop", F.size("found").alias("n"), F.try_element_at("found", F.lit(-1)).alias("last"))
    carried = summary.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("place"),
                             (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("begin"))
    ends = scanned.where(F.size("found") > 0).join(carried, ["file", "block"])
    at = ends.select("file", F.col("place").alias("first"), "begin", "found", F.posexplode("found").alias("k", "stop"))
    start = F.when(F.col("k") == 0, F.col("begin")).otherwise(F.try_element_at("found", F.col("k")) + 1)
    closed = at.select("file", (F.col("first") + F.col("k")).alias("place"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    tails = summary.groupBy("file").agg(F.sum("n").alias("place"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("stop").alias("stop"))
    opened = tails.where("stop > start").select("file", "place", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(opened)


def token_counts(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``(doc_id, n_tokens)`` of every document, counted in token files written for it; rows that repeat give a result each."""
    spark: SparkSession = docs.sparkSession
    folder = shared_folder(spark, "tokens")
    index = write_token_files(docs, folder, ranks)
    counted = document_lengths(index.select("file").distinct(), folder)
    return index.join(counted, ["file", "place"]).select("doc_id", "n_tokens")
