"""Running a stream over what is there, into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.operators.limits import RATE_SCHEMA, micros, rate_limit, rate_state
from pageloom.session import forget, materialize, shared_folder, tables_so_far


def file_stream(spark: SparkSession, folder: str, schema, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the parquet files of a folder, with an explicit schema."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Processes everything available, then stops; returns the emitted rows with the batch that emitted them.

    A batch overwrites its own folder, so a batch repeated after a failure leaves one copy.
    """
    spark = stream.sparkSession
    base = shared_folder(spark, name)

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/_batch={epoch}")

    query = (
        stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    if not query.recentProgress:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{base}/rows").parquet(f"{base}/rows")


def limited_to_table(requests: DataFrame, limit: int, window_ms: int, name: str = "limits", lateness_ms: int = 0) -> DataFrame:
    """The fixed-window limiter over a stream of ``(key, request_id, ts)``, run over what is there; verdicts with their batch.

    Each micro-batch goes through the batch operator with the counters that the batch before it left, so a key may hold a
    whole batch: its rows are split over tasks, none of which holds more than a segment. Counters are a table per
    batch, written after the verdicts; a batch that is repeated reads the same counters and overwrites its own. A counter
    goes when its window ended ``lateness_ms`` before the latest request.
    """
    spark = requests.sparkSession
    base = shared_folder(spark, name)
    schema = T.StructType([*T._parse_datatype_string(RATE_SCHEMA).fields, T.StructField("_batch", T.IntegerType())])

    def save(batch: DataFrame, epoch: int) -> None:
        mark = tables_so_far(spark)
        asked = materialize(batch.select("key", "request_id", "ts"), "requests")
        held = spark.read.parquet(f"{base}/counters/{epoch - 1}") if epoch else spark.createDataFrame([], "key string, window_start_us long, count long")
        rate_limit(asked, limit, window_ms, held).write.mode("overwrite").parquet(f"{base}/rows/_batch={epoch}")
        fresh = rate_state(spark.read.parquet(f"{base}/rows/_batch={epoch}"))
        latest = asked.agg(F.max(micros(F.col("ts")))).first()[0]
        kept = held.unionByName(fresh).groupBy("key").agg(F.max(F.struct("window_start_us", "count")).alias("c")).select("key", "c.*")
        if latest is not None:
            kept = kept.where(F.col("window_start_us") + F.lit((window_ms + lateness_ms) * 1000) >= latest)
        kept.write.mode("overwrite").parquet(f"{base}/counters/{epoch}")
        forget(spark, mark)

    query = requests.writeStream.foreachBatch(save).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not query.recentProgress:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{base}/rows").parquet(f"{base}/rows")


def latest_emitted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """State after the last batch, from the rows an update-mode stream emitted."""
    rest = [c for c in rows.columns if c not in keys and c != "_batch"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
