"""Session settings, small-table broadcasting and reliable intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "pageloom") -> SparkSession:
    """Session used by tests and the bench; a cluster brings its own and only needs the UTC time zone."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only in local mode, where it may be unset, a temporary folder takes its place, and goes when the process ends.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder:
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="pageloom-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


_WRITTEN: dict[str, list[str]] = {}


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Several consumers then read a narrow columnar table (with column pruning) instead of repeating the scan of the
    page bodies, and a lost executor costs a re-read, not a recomputation. ``drop_tables`` removes what was written. With ``by``, the last
    column, the table has a folder per value, and a filter on it reads no others.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    (df.write.partitionBy(by) if by else df.write).mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder, for files that tasks write themselves; ``drop_tables`` removes what is there."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_tables(spark: SparkSession) -> None:
    """Removes the tables that this application wrote with ``materialize``, once their readers are done."""
    _remove(spark, _WRITTEN.pop(spark.sparkContext.applicationId, []))


def tables_so_far(spark: SparkSession) -> int:
    """How many tables this application has written: a mark for ``settle``."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def settle(df: DataFrame, name: str, mark: int) -> DataFrame:
    """Writes ``df`` as ``materialize`` does and removes every table written since ``mark``: only steps towards ``df`` may lie there."""
    out = materialize(df, name)
    forget(df.sparkSession, mark, -1)
    return out


def forget(spark: SparkSession, mark: int, upto: int | None = None) -> None:
    """Removes the tables written since ``mark`` whose readers are done."""
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    steps = written[mark:upto]
    del written[mark:upto]
    _remove(spark, steps)


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint, for tables of a fixed size only (the rubric, the guidance table, word lists)."""
    return F.broadcast(df)


def salts(spark: SparkSession) -> int:
    """Tasks that one key of a salted join is spread over: a quarter of the shuffle partitions, 4 to 64."""
    return min(64, max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, spread_by: str) -> DataFrame:
    """Join of a big left side that may be skewed on ``keys`` with a right side of few rows per key.

    The right side is repeated once per salt and the left side picks its salt from ``spread_by``, so a key with a third
    of all rows is split over ``salts`` tasks. The salt comes from the row itself, so a recomputed task repeats it.
    The copies are a product with a table of salts, whose size Spark counts before it broadcasts; those of an ``explode`` count
    as the right side alone, and many more rows than the size check allows would go through the driver.
    For inner, left, left_semi and left_anti joins.
    """
    spark = left.sparkSession
    count = salts(spark)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(count)).cast("int"))
    copies = right.crossJoin(small(spark.range(count).select(F.col("id").cast("int").alias("_salt"))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
