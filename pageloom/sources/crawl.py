"""Sources: crawled pages, per-site fetch results, stored result documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.text import matches
from pageloom.functions.urls import host_of
from pageloom.plans.schema import PAGES, RESULT


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Crawled pages with an explicit schema; ``fmt`` is parquet or json."""
    reader = spark.read.schema(PAGES)
    if fmt == "json":
        return reader.option("mode", "PERMISSIVE").json(path)
    return reader.format(fmt).load(path)


def pages_from_html(table: DataFrame) -> DataFrame:
    """Adapter for a bare ``(page_id, url, html)`` table: the report is the host, the title comes from the markup."""
    null = F.lit(None).cast("string")
    return table.select(
        host_of(F.col("url")).alias("report_id"),
        F.col("page_id").alias("page_ord"),
        F.col("url").alias("source_url"),
        F.lit(None).cast("int").alias("status_code"),
        F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"),
        null.alias("description"),
        null.alias("language"),
        null.alias("markdown"),
        null.alias("html"),
        F.col("html").alias("raw_html"),
        F.regexp_extract_all("html", F.lit(r"(?i)<a[^>]+href=[\"']([^\"']+)[\"']"), F.lit(1)).alias("links"),
    )


def robots_text(status: Column, body: Column) -> Column:
    """The body counts only on a 200; anything else means no robots file, which allows everything."""
    return F.when(status == 200, F.coalesce(body, F.lit(""))).otherwise("")


def sitemap_found(status: Column, robots: Column) -> Column:
    """A 200 for the sitemap, or a Sitemap line in robots; NULL when the fetch was not attempted."""
    return F.when(status.isNotNull(), (status == 200) | matches(robots, r"(?i)(^|\n)\s*sitemap:"))


def llms_found(status: Column) -> Column:
    return F.when(status.isNotNull(), status == 200)


def lowered_headers(headers: Column) -> Column:
    """Header names in lower case, several values of a header joined with a comma."""
    return F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(
        F.lower(e["key"]).alias("key"), F.array_join(e["value"], ", ").alias("value"))))


def site_inputs(raw: DataFrame) -> DataFrame:
    """Per-site inputs of the audit from fetch results ``(robots_status, robots_body, sitemap_status, ...)``."""
    robots = robots_text(F.col("robots_status"), F.col("robots_body"))
    headers = lowered_headers(F.col("headers"))
    return raw.select(
        "report_id",
        "root_url",
        F.col("robots_status").isNotNull().alias("robots_fetched"),
        robots.alias("robots_txt"),
        sitemap_found(F.col("sitemap_status"), robots).alias("sitemap_found"),
        llms_found(F.col("llms_status")).alias("llms_txt_found"),
        F.coalesce(F.size(headers) > 0, F.lit(False)).alias("headers_fetched"),
        headers.alias("headers"),
        "root_html",
        "gtm_body",
    )


def unwrapped_json(raw: Column) -> Column:
    """A document that was stored as a JSON string inside JSON is unwrapped once; NULL for text that is neither."""
    inner = F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string", {"mode": "PERMISSIVE"})["v"]
    text = F.trim(raw)
    return F.when(F.startswith(text, F.lit('"')), inner).when(F.startswith(text, F.lit("{")), text)


def read_results(df: DataFrame, column: str) -> DataFrame:
    """Adds ``doc``, the typed result document; NULL when the text cannot be read."""
    text = unwrapped_json(F.col(column))
    return df.withColumn("doc", F.from_json(text, RESULT, {"mode": "PERMISSIVE"}))
