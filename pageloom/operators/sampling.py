"""Which pages of a site to audit, and which of the submitted ones never came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.urls import dedupe_key, host_of, is_sensitive, path_of, path_priority
from pageloom.session import salted_join


def link_urls(links: Column) -> Column:
    """Map results may be bare URLs or records with ``url`` or ``href``; records are given as JSON text."""
    return F.transform(links, lambda l: F.when(F.startswith(l, F.lit("{")), F.coalesce(
        F.get_json_object(l, "$.url"), F.get_json_object(l, "$.href"))).otherwise(l))


def exploded_links(df: DataFrame) -> DataFrame:
    """``(report_id, link_ord, url)`` from ``(report_id, links)``; unreadable entries drop out."""
    return df.select("report_id", F.posexplode(link_urls(F.col("links"))).alias("link_ord", "url")).filter(
        F.col("url").isNotNull() & (F.col("url") != ""))


def candidates(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Same-site links, one per dedupe key (the first wins), without the home page.

    ``links``: ``report_id, link_ord, url``; ``roots``: ``report_id, root_url``.
    """
    own = salted_join(links, roots, ["report_id"], "inner", "url").filter(host_of(F.col("url")) == host_of(F.col("root_url")))
    keyed = own.withColumn("key", dedupe_key(F.col("url"))).filter(
        (F.col("key") != "") & (F.col("key") != dedupe_key(F.col("root_url"))))
    return keyed.groupBy("report_id", "root_url", "key").agg(
        F.min_by("url", "link_ord").alias("url"), F.min("link_ord").alias("link_ord"))


def pick_pages(links: DataFrame, roots: DataFrame, size: int) -> DataFrame:
    """Home page first, then the best ``size - 1`` candidates by priority (stable), never a sensitive path."""
    clean = candidates(links, roots).filter(~is_sensitive(F.col("url")))
    order = Window.partitionBy("report_id").orderBy(F.desc("priority"), "link_ord")
    best = (
        clean.withColumn("priority", path_priority(F.col("url")))
        .withColumn("pos", F.row_number().over(order)).filter(F.col("pos") < size)
        .select("report_id", "pos", "url")
    )
    home = roots.select("report_id", F.lit(0).alias("pos"), F.col("root_url").alias("url"))
    return home.unionByName(best)


def excluded_counts(links: DataFrame, roots: DataFrame) -> DataFrame:
    """How many candidates the sensitive-path rule dropped; the paths themselves are not kept."""
    return candidates(links, roots).groupBy("report_id").agg(
        F.count_if(is_sensitive(F.col("url"))).alias("pages_excluded"))


def crawl_counts(submitted: DataFrame, usable_pages: DataFrame) -> DataFrame:
    attempted = submitted.groupBy("report_id").agg(F.count("*").alias("pages_attempted"))
    sampled = usable_pages.groupBy("report_id").agg(F.count("*").alias("pages_sampled"))
    return attempted.join(sampled, "report_id", "left").withColumn(
        "pages_sampled", F.coalesce("pages_sampled", F.lit(0)))


def failed_pages(
    submitted: DataFrame, returned: DataFrame, content_only: bool = False
) -> DataFrame:
    """Pages tried but not audited, all of them: ``report_id, pass_no, ord, path, reason``, in order by the middle three.

    ``submitted``: ``report_id, url_ord, url``; ``returned``: ``report_id, page_ord, source_url, status_code, html,
    raw_html, markdown``. Any returned row with a URL counts as audited (its metadata is enough), so only timeouts can
    occur; ``content_only`` asks for content, and then empty rows are classified by their status.
    """
    filled = F.lit(False)
    for c in ("html", "raw_html", "markdown"):
        filled = filled | (F.coalesce(F.col(c), F.lit("")) != "")
    rows = returned.filter(F.col("source_url").isNotNull()).select(
        "report_id", path_of(F.col("source_url")).alias("path"), F.col("page_ord"), "status_code",
        (filled if content_only else F.lit(True)).alias("good"))
    # One row per returned path: is any of its rows usable, else the first row's reason.
    paths = rows.groupBy("report_id", "path").agg(
        F.bool_or("good").alias("good"), F.min("page_ord").alias("ord"),
        F.min_by(F.struct("status_code"), "page_ord").alias("first"))
    code = F.col("first.status_code")
    bad = paths.filter(~F.col("good")).select(
        "report_id", "path", F.lit(0).alias("pass_no"), F.col("ord"),
        F.when(code >= 500, "5xx").when(code >= 400, "4xx").otherwise("no-content").alias("reason"))
    short = (
        submitted.groupBy("report_id").agg(F.count("*").alias("asked"))
        .join(returned.groupBy("report_id").agg(F.count("*").alias("got")), "report_id", "left")
        .filter(F.coalesce("got", F.lit(0)) < F.col("asked")).select("report_id")
    )
    lost = (
        salted_join(submitted, short, ["report_id"], "left_semi", "url")
        .groupBy("report_id", path_of(F.col("url")).alias("path")).agg(F.min("url_ord").alias("ord"))
        .join(paths.select("report_id", "path"), ["report_id", "path"], "left_anti")
        .select("report_id", "path", F.lit(1).alias("pass_no"), "ord", F.lit("timeout").alias("reason"))
    )
    return bad.unionByName(lost).select("report_id", "pass_no", "ord", "path", "reason")


# Sentences of the four reasons.
FAILED_TEXT = {
    "4xx": "returned a 4xx error",
    "5xx": "returned a 5xx server error",
    "no-content": "returned no usable content",
    "timeout": "timed out / never returned",
}


def failed_text(reason: Column) -> Column:
    out = reason
    for key, text in FAILED_TEXT.items():
        out = F.when(reason == key, text).otherwise(out)
    return out
