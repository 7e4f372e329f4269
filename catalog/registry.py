"""Registry of queries: a name, the Spark function, and (where there is one) the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom import workload
from pageloom.operators import audit, scoring, vectors
from pageloom.operators.facts import page_facts
from pageloom.session import drop_tables, materialize

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = datetime(2024, 2, 1)

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


_TABLES: dict[tuple, Any] = {}
CRAWL = ("pages", "documents")


def _version(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> int:
    """Changes when a file of the tables changes: one number from their paths, sizes and times."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
        [f"{sf_dir}/{t}.parquet" for t in tables]).select("path", "length", "modificationTime")
    return files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()[0]


def once(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], build: Callable[[], Any]) -> Any:
    """What several queries read, written once per application and state of its input tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _version(spark, sf_dir, tables))
    if key not in _TABLES:
        _TABLES[key] = build()
    return _TABLES[key]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts table of a folder: every audit query after the first reads it."""
    return once(spark, sf_dir, "page-facts", CRAWL, lambda: materialize(page_facts(workload.crawl(spark, sf_dir, dealt=True)), "page-facts"))


def aux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-site inputs, an ordinary input table of the audit; derived from the crawl here, so written once as well."""
    return once(spark, sf_dir, "site-aux", CRAWL, lambda: materialize(workload.site_aux(spark, sf_dir), "site-aux"))


def vector_index(spark: SparkSession, sf_dir: str) -> vectors.VectorIndex:
    """The index of a folder's embeddings: searches after the first read it."""
    corpus = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS id", "'label-' || CAST(label AS STRING) AS report_id", "embedding")
    return once(spark, sf_dir, "vector-index", ("embeddings",), lambda: vectors.build_index(corpus))


def forget_facts(spark: SparkSession) -> None:
    """Removes the tables, so that the next audit query starts from the input again (the bench does this before each query)."""
    _TABLES.clear()
    drop_tables(spark)


def results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check results written out, for queries that read them more than once."""
    return materialize(results(spark, sf_dir), "check-results")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.check_results(facts(spark, sf_dir), aux(spark, sf_dir), AS_OF)


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.page_failures(facts(spark, sf_dir), aux(spark, sf_dir))


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.dimension_scores(results(spark, sf_dir))
