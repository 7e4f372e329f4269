"""Sinks: result tables and report documents."""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.session import materialize, shared_folder


BUCKETS = 64


def write_reports(reports: DataFrame, path: str, partition_by: str | None = None) -> None:
    """A whole snapshot of report rows as parquet; ``merge_reports`` keeps those that are there."""
    writer = reports.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def merge_reports(reports: DataFrame, path: str, version: list[str], buckets: int = BUCKETS) -> None:
    """Puts rows into the report table at ``path``: of the rows of a report, there or new, the one of the latest ``version`` stays.

    The table has a folder per bucket of report ids. Only the buckets of the new rows are read and replaced, all others
    stay as they are, and so do the other reports of a bucket. Writing the same rows again changes nothing; rows that are
    older than what is there change nothing either. Of equal versions the first by all other columns stays, so order plays no part.
    Columns that one side lacks are null there. The merged rows are written aside before a bucket is replaced.
    """
    spark = reports.sparkSession
    fresh = materialize(reports.withColumn("bucket", F.pmod(F.xxhash64("report_id"), F.lit(buckets)).cast("int")), "new-reports")
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    known = stored(spark, path)
    rows = fresh if known is None else known.where(F.col("bucket").isin(touched)).unionByName(fresh, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in ("report_id", "bucket", *version)]
    latest = rows.groupBy("bucket", "report_id").agg(F.max(F.struct(*version, *rest)).alias("r"))
    merged = materialize(latest.select("report_id", *[F.col(f"r.{c}").alias(c) for c in (*version, *rest)], "bucket"), "merged-reports")
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_parts(parts: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Documents of any size from their parts, in order: ranges of (bucket, report, part, key), sorted inside each file.

    Reports are dealt to a fixed number of folders by hash. A report that spans several tasks has several files, whose names
    sort in document order.
    """
    order = ["bucket", "report_id", "part", "key"]
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("report_id"), F.lit(buckets)).cast("int"))
    dealt.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(path)


COPIED = 4 << 20  # bytes of a document that are held at a time


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI: any store that Arrow reads."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def _stacked(folder: str):
    """Task: a sorted range of parts goes into one file; out go the stretches of that file that each report has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        name, at, begin, report, first, out = f"{uuid.uuid4().hex}.part", 0, 0, None, None, None
        rows: list[tuple] = []
        for batch in batches:
            for now, part, key, text in zip(*(batch.column(n).to_pylist() for n in ("report_id", "part", "key", "text")), strict=True):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(posixpath.join(path, name))
                if now != report:
                    if report is not None:
                        rows.append((report, *first, name, begin, at - begin))
                    report, first, begin = now, (part, key), at
                piece = (text or "").encode()
                out.write(piece)
                at += len(piece)
        if out is not None:
            rows.append((report, *first, name, begin, at - begin))
            out.close()
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             names=["report_id", "part", "key", "file", "begin", "size"])

    return run


def _stitched(pieces: str, documents: str, suffix: str):
    """Task: the stretches of one report after the other, in order; each report's are copied into one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, source_path = opened(pieces)
        target, target_path = opened(documents)
        attempt, report, out, digest, done = uuid.uuid4().hex[:12], None, None, None, 0
        rows: list[tuple] = []

        def close() -> None:
            if out is not None:
                out.close()
                rows.append((report, name, done, digest.hexdigest()))

        for batch in batches:
            for now, file, begin, size in zip(*(batch.column(n).to_pylist() for n in ("report_id", "file", "begin", "size")), strict=True):
                if now != report:
                    close()
                    report, digest, done = now, hashlib.md5(), 0
                    hashed = hashlib.sha256(now.encode()).hexdigest()
                    name = posixpath.join(hashed[:2], f"{hashed[:32]}-{attempt}{suffix}")
                    target.create_dir(posixpath.join(target_path, hashed[:2]), recursive=True)
                    out = target.open_output_stream(posixpath.join(target_path, name))
                with source.open_input_file(posixpath.join(source_path, file)) as given:
                    for at in range(begin, begin + size, COPIED):
                        held = given.read_at(min(COPIED, begin + size - at), at)
                        digest.update(held)
                        out.write(held)
                        done += len(held)
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["report_id", "file", "bytes", "digest"])

    return run


def write_documents(parts: DataFrame, path: str, suffix: str = ".json") -> DataFrame:
    """One file per report under ``path``, from the parts of all documents; returns the index ``(report_id, file, bytes, digest)``.

    ``parts``: ``report_id, part, key, text``, a document's text in order of part and key. Parts are dealt out by range, so a report of any size is
    written by many tasks, each into one file of its own; a table of the stretches, written once, says which file holds what, and
    a second pass copies them together, a few megabytes at a time. Files of lost or repeated tasks are in no table. The index is
    written beside the documents and names the file of each; a document of an earlier write stays until its caller removes it.
    """
    spark = parts.sparkSession
    order = ["report_id", "part", "key"]
    pieces = shared_folder(spark, "document-pieces")
    dealt = parts.select(*order[:1], F.col("part").cast("int").alias("part"), "key", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    stretches = materialize(dealt.mapInArrow(_stacked(pieces), "report_id string, part int, key string, file string, begin long, size long"), "stretches")
    copied = stretches.repartition("report_id").sortWithinPartitions(*order).mapInArrow(
        _stitched(pieces, path, suffix), "report_id string, file string, bytes long, digest string")
    index = f"{path.rstrip('/')}/_index-{uuid.uuid4().hex}"
    copied.write.mode("error").parquet(index)
    return spark.read.schema(copied.schema).parquet(index)


def write_steps(steps: DataFrame, path: str, checkpoint: str):
    """Streaming sink of the current step rows; runs over what is available and stops."""
    return (
        steps.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
