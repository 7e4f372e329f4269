"""From failures per check to failures per page; everything here reads all failures, none from lists cut for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.operators.audit import failing_paths
from pageloom.operators.scoring import severity_rank
from pageloom.plans.rubric import SEVERITIES
from pageloom.session import salted_join

BUCKETS = [name for name, _ in SEVERITIES] + ["clean"]


def normalized_failing(failing: Column, legacy: bool = False) -> Column:
    """Evidence lists of older reports hold bare paths; give them the record shape."""
    if not legacy:
        return failing
    return F.transform(failing, lambda p: F.struct(p.alias("path"), F.lit(None).cast("string").alias("reason")))


def failure_rows(results: DataFrame, failures: DataFrame) -> DataFrame:
    """One row per report, check and failing path, with its reason, first page and what the rubric says of the check.

    Checks that are N/A or were judged by a verdict have no failing pages.
    """
    judged = results.filter(F.col("ratio").isNotNull() & ~F.col("semantic")).select(
        "report_id", "check_id", "label", "dimension", "severity", "ordinal", "ratio")
    return salted_join(failing_paths(failures), judged, ["report_id", "check_id"], "inner", "path")


def page_matrix(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Every audited path with its failing checks (an empty list if clean); failures of unknown paths drop out.

    The join key is (report, path), so a hot report spreads over all tasks; a path has 58 failures at most.
    """
    per_path = rows.groupBy("report_id", "path").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "check_id", "label", "dimension", "severity", "reason"))).alias(
            "failures"))
    empty = F.array().cast(per_path.schema["failures"].dataType)
    return pages.join(per_path, ["report_id", "path"], "left").withColumn("failures", F.coalesce("failures", empty))


def page_severity(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Failures and worst severity of every audited path, 'clean' without any: one aggregate, no lists."""
    worst = rows.groupBy("report_id", "path").agg(
        F.count("*").cast("int").alias("n_failures"), F.max(severity_rank(F.col("severity"))).alias("worst"))
    bucket = F.when(F.col("worst").isNull(), "clean")
    for name, rank in SEVERITIES:
        bucket = bucket.when(F.col("worst") == rank, name)
    return pages.join(worst, ["report_id", "path"], "left").select(
        "report_id", "path", F.coalesce("n_failures", F.lit(0)).alias("n_failures"), bucket.otherwise("info").alias("severity"))


def severity_histogram(severities: DataFrame) -> DataFrame:
    """Pages per bucket and report; each page counts once."""
    return severities.groupBy("report_id").agg(
        *[F.count_if(F.col("severity") == b).cast("int").alias(b) for b in BUCKETS])


def total_issues(histogram: DataFrame, issues: DataFrame) -> DataFrame:
    """Pages with issues as counted by the audit, else the pages outside the clean bucket."""
    summed = sum((F.col(b) for b in BUCKETS[:-1]), F.lit(0))
    return histogram.join(issues, "report_id", "left").select(
        "report_id", F.coalesce("pages_with_issues", summed).cast("int").alias("total_issues"))


def affected_pages(rows: DataFrame) -> DataFrame:
    """Failing paths per finding that has any."""
    return rows.filter(F.col("ratio") < 1).groupBy("report_id", "check_id").agg(F.count("*").cast("int").alias("affected"))
