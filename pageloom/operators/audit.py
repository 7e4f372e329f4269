"""The 58 checks over page facts: verdicts per page, ratios per report, evidence lists.

Shape of the job: facts (one narrow row per page) -> one partial aggregate per report -> one row per report holding
all 58 ratios -> long form. The per-report step only ever sees map-side partials, so a report with a third of all
pages is no hotter than any other. Evidence comes from a second pass over the facts, not over page bodies.
"""

from __future__ import annotations

from datetime import datetime
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import clamp01, matches, scrubbed, trimmed, word_count, without_tags, replaced
from pageloom.functions.urls import comparable, host_of, path_of, resolved_canonical
from pageloom.operators.signals import (
    DETECTORS,
    blocks_snippets,
    container_facts,
    header_ratios,
    merged_detectors,
    robots_blocks_ai,
    robots_blocks_site,
    tracking_ratios,
)
from pageloom.plans.rubric import AVG_IDS, CHECK_IDS, COV_IDS, SEMANTIC_CHECKS, SEMANTIC_LABEL, SOURCE_LABELS, rubric
from pageloom.plans.schema import missing, no_reason, reason
from pageloom.session import salted_join, small

DATE_SHAPES = [
    "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "M/d/yyyy", "yyyy/M/d", "d MMM yyyy HH:mm:ss z",
]


# --- per page -----------------------------------------------------------------------------------------------------


def with_page_url(facts: DataFrame, site_aux: DataFrame | None) -> DataFrame:
    """Adds ``url`` (own URL, else the root URL of the report) and ``path``.

    Only pages without a URL of their own meet the per-site table; the filter on ``source_url`` reaches the scan, so
    the second branch reads next to nothing on ordinary crawls.
    """
    own = facts.filter(F.col("source_url").isNotNull()).withColumn("url", F.col("source_url"))
    lost = facts.filter(F.col("source_url").isNull())
    if site_aux is None:
        lost = lost.withColumn("url", F.lit(""))
    else:
        roots = site_aux.select("report_id", F.col("root_url").alias("url"))
        lost = salted_join(lost, roots, ["report_id"], "left", "page_ord")
        lost = lost.withColumn("url", F.coalesce("url", F.lit("")))
    return own.unionByName(lost).withColumn("path", path_of(F.col("url")))


@lru_cache(maxsize=1)
def page_reasons() -> dict[str, Column]:
    """Per coverage check: the failure record of a page, NULL if it passes. Reads facts, ``url`` and ``path``."""
    c = F.col
    ok = no_reason()

    def length_rule(size: Column, what: str, low: int, high: int) -> Column:
        return (
            F.when(size == 0, missing(what))
            .when(size < low, reason("too_short", actual=size, min=low))
            .when(size > high, reason("too_long", actual=size, max=high))
            .otherwise(ok)
        )

    def need(flag: Column, what: str) -> Column:
        return F.when(flag, ok).otherwise(missing(what))

    https = F.startswith(c("url"), F.lit("https://"))
    target = resolved_canonical(trimmed(c("canonical_href")), c("url"))
    target_path = F.regexp_replace(F.regexp_replace(target, r"(?i)^https?://[^/]+", ""), r"[#?].*\z", "")
    jump_from, jump_to = F.substring("level_jump", 1, 1), F.substring("level_jump", 2, 1)
    other_hosts = F.size(F.array_except(c("authority_hosts"), F.array(host_of(c("url")))))
    lead_notes = {
        "heading": "first content line is a heading, not a lead paragraph",
        "unfit": "lead paragraph found but it is too long or lacks ending punctuation",
    }
    return {
        "S1": length_rule(c("title_len"), "title", 15, 60),
        "S2": length_rule(c("desc_len"), "meta description", 70, 160),
        "S3": need(c("has_canonical"), "canonical link tag"),
        "S4": F.when(c("noindex"), reason("noindex")).otherwise(ok),
        "S5": need(c("h1_tags") >= 1, "h1 heading"),
        "S10": F.when(c("words") >= 300, ok).otherwise(reason("too_short", actual=c("words"), min=300)),
        "S12": need(c("has_og"), "og:title and og:image"),
        "S17": F.when((c("status_code") < 200) | (c("status_code") >= 400), reason("http_status", code=c("status_code")))
        .when(c("not_found") & (c("words") < 50), reason("soft_404"))
        .otherwise(ok),
        "S18": F.when(c("headings") == 0, missing("heading tags"))
        .when(c("h1_levels") != 1, reason("wrong_count", what="h1 heading", actual=c("h1_levels"), expected_n=1))
        .when(c("level_jump").isNotNull(), reason("other", note=F.format_string(
            "heading level h%s jumps to h%s (skipped h%s)", jump_from, jump_to,
            (jump_from.cast("int") + 1).cast("string"))))
        .otherwise(ok),
        "S21": F.when(c("bad_hreflang").isNotNull(), reason("other", note=scrubbed(F.concat(
            F.lit("invalid hreflang value '"), "bad_hreflang", F.lit("'"))))).otherwise(ok),
        "S23": F.when(c("canonical_href").isNull() | (comparable(target) == comparable(c("url"))), ok).otherwise(
            reason("mismatch", what="canonical", expected=scrubbed(c("path")), actual_s=scrubbed(F.when(target_path == "", "/").otherwise(target_path)))),
        "G1": need(c("has_jsonld"), "JSON-LD <script>"),
        "G4": F.when(c("lead_state") == "pass", ok).otherwise(reason("other", note=F.when(
            c("lead_state") == "heading", lead_notes["heading"]).when(
            c("lead_state") == "unfit", lead_notes["unfit"]).otherwise(
            "no lead paragraph (60-400 chars) before the first heading"))),
        "G5": need(c("has_qa"), "Q&A / FAQ structure"),
        "G6": F.when(c("statistics") >= 3, ok).otherwise(reason(
            "wrong_count", what="concrete statistics (%, currency, ratios)", actual=c("statistics"), expected_n=3)),
        "G8": need(c("has_author"), "author / Organization / sameAs signals"),
        "G11": need(c("typed_schema"), "typed schema (Organization / Article / Product / FAQ / HowTo / ...)"),
        "G12": F.when(c("nosnippet"), reason("other", note="nosnippet / max-snippet:0 directive blocks citation"))
        .otherwise(ok),
        "G14": need(c("extractable"), "extractable lists or tables"),
        "G15": need(other_hosts >= 1, "outbound citation to an authoritative source"),
        "G18": F.when(~c("has_same_as"), missing("Organization.sameAs JSON-LD block"))
        .when(c("same_as_wiki") | (c("same_as_links") >= 2), ok)
        .otherwise(reason("wrong_count", what="sameAs URLs (Wikipedia/Wikidata or 2+ socials)",
                          actual=c("same_as_links"), expected_n=2)),
        "G20": F.when(c("takeaway_state") == "pass", ok)
        .when(c("takeaway_state") == "empty", missing("page content"))
        .when(c("takeaway_state") == "none", missing("TL;DR / Key Takeaways heading in the top quarter"))
        .otherwise(reason("other", note="Key Takeaways heading found but no bullet/numbered list follows")),
        "TB1": F.when(https, ok).otherwise(reason("non_https")),
        "TB3": F.when(https & (c("insecure_refs") > 0), reason(
            "wrong_count", what="insecure http:// sub-resources on an HTTPS page", actual=c("insecure_refs"),
            expected_n=0)).otherwise(ok),
        "TB4": need(c("has_viewport"), '<meta name="viewport"> tag'),
        "TB10": F.when(c("has_charset") & c("has_lang"), ok)
        .when(~c("has_charset") & ~c("has_lang"), missing("<meta charset> and <html lang>"))
        .when(~c("has_charset"), missing("<meta charset>"))
        .otherwise(missing("<html lang>")),
        "TB12": need(c("has_favicon"), 'favicon <link rel="icon">'),
        "TB22": need(c("html5"), "<!DOCTYPE html> at document start"),
    }


def parsed_date(text: Column) -> Column:
    """Timestamps in ISO form and a few common written forms; NULL when unreadable."""
    text = F.trim(text)
    out = F.when(matches(text, r"^\d{4}(-|\z)"), text.try_cast("timestamp"))
    no_weekday = F.regexp_replace(text, r"^[A-Za-z]{3,9}, ", "")
    for shape in DATE_SHAPES:
        out = F.coalesce(out, F.try_to_timestamp(no_weekday, F.lit(shape)))
    return out


def page_fractions(as_of: datetime) -> dict[str, Column]:
    """Per averaged check: the page's share in 0..1, NULL when the page cannot be assessed."""
    c = F.col
    at = parsed_date(c("fresh_date"))
    days = (F.unix_micros(F.lit(as_of)) - F.unix_micros(at)) / F.lit(86_400_000_000.0)
    by_age = F.when(days <= 90, 1.0).when(days >= 730, 0.1).otherwise(1 - (days - 90) / 640 * 0.9)
    return {
        "S13": c("alt_share"),
        "G7": F.when(c("fresh_date").isNull(), F.when(c("fresh_hint"), 0.3).otherwise(0.0))
        .when(at.isNull(), 0.3)
        .otherwise(by_age),
        "G19": c("section_share"),
        "TB6": c("sized_share"),
        "TB20": c("head_free"),
        "TB19": clamp01(c("modern_share")),
    }


def page_failures(facts: DataFrame, site_aux: DataFrame | None = None) -> DataFrame:
    """Long form ``(report_id, page_ord, path, check_id, reason)``: one row per failed coverage check and page."""
    pages = with_page_url(facts, site_aux)
    rules = page_reasons()
    keys = ("report_id", "page_ord", "path")

    def rows(df: DataFrame, check_id: str) -> DataFrame:
        return df.select(*keys, F.lit(check_id).alias("check_id"), rules[check_id].alias("reason")).filter(
            F.col("reason").isNotNull())

    entries = [F.struct(F.lit(i).alias("check_id"), rules[i].alias("reason")) for i in COV_IDS if i != "S21"]
    item = F.explode(F.filter(F.array(*entries), lambda e: e["reason"].isNotNull())).alias("item")
    out = pages.select(*keys, item).select(*keys, "item.check_id", "item.reason")
    # hreflang is judged only where at least one page of the site declares alternates.
    multilingual = facts.filter("declares_hreflang").select("report_id").distinct()
    out = out.unionByName(
        rows(salted_join(pages.filter(F.col("bad_hreflang").isNotNull()), multilingual, ["report_id"], "left_semi",
                         "page_ord"), "S21"))
    if site_aux is None:
        return out
    # A root header that forbids snippets fails every page of the report, whatever the page itself says.
    blocked = site_aux.filter(blocks_snippets(F.col("headers"))).select("report_id")
    silent = salted_join(pages.filter(~F.col("nosnippet")), blocked, ["report_id"], "left_semi", "page_ord")
    return out.unionByName(rows(silent.withColumn("nosnippet", F.lit(True)), "G12"))


# --- per report ---------------------------------------------------------------------------------------------------


def unique_shares(facts: DataFrame) -> DataFrame:
    """Share of non-empty titles and descriptions that occur once in their report; NULL below two values."""
    values = facts.select("report_id", F.explode(F.array(
        F.struct(F.lit("title").alias("kind"), F.col("title_key").alias("value")),
        F.struct(F.lit("description").alias("kind"), F.col("desc_key").alias("value")))).alias("v"))
    counted = values.filter(F.col("v.value") != "").groupBy("report_id", "v.kind", "v.value").agg(
        F.count("*").alias("n"))

    def share(kind: str) -> Column:
        mine = F.col("kind") == kind
        total = F.sum(F.when(mine, F.col("n")))
        return F.when(total >= 2, F.coalesce(F.sum(F.when(mine & (F.col("n") == 1), 1)), F.lit(0)) / total)

    return counted.groupBy("report_id").agg(
        share("title").alias("unique_titles"), share("description").alias("unique_descriptions"))


def site_rollup(
    facts: DataFrame, site_aux: DataFrame | None, as_of: datetime, only: frozenset[str] | None = None
) -> DataFrame:
    """One row per report: usable pages, passes of each coverage check, means, detectors, home page."""
    pages = with_page_url(facts, site_aux)
    rules, shares = page_reasons(), page_fractions(as_of)
    aggs = [F.count("*").alias("n")]
    aggs += [F.count_if(rules[i].isNull()).alias(f"pass_{i}") for i in COV_IDS if only is None or i in only]
    aggs += [F.avg(shares[i]).alias(f"mean_{i}") for i in AVG_IDS if only is None or i in only]
    aggs += [F.avg("brand_score").alias("brand"), F.bool_or("declares_hreflang").alias("multilingual")]
    aggs += [F.bool_or(f"det_{d}").alias(d) for d in DETECTORS]
    # Only flags and numbers: a string buffer would turn the hash aggregate into a sort of all facts.
    aggs += [F.bool_or(F.col("container_id").isNotNull()).alias("names_container")]
    # Stands in for the home page where no page is on the root host (see home_words).
    aggs += [F.min_by("rendered_words", "page_ord").alias("first_words")]
    return pages.groupBy("report_id").agg(*aggs)


def home_words(facts: DataFrame, site_aux: DataFrame) -> DataFrame:
    """Rendered words of the first page whose host is the root host; one row per report that has such a page."""
    per_host = (
        facts.select("report_id", "page_ord", "rendered_words",
                     host_of(F.coalesce("source_url", F.lit(""))).alias("host"))
        .groupBy("report_id", "host").agg(F.min_by("rendered_words", "page_ord").alias("home_words"))
    )
    roots = site_aux.select("report_id", host_of(F.col("root_url")).alias("host"))
    return per_host.join(roots, ["report_id", "host"]).select("report_id", "home_words")


def container_ids(facts: DataFrame) -> DataFrame:
    """The first tag-container id of each report, in page order."""
    named = facts.filter(F.col("container_id").isNotNull())
    return named.groupBy("report_id").agg(F.min_by("container_id", "page_ord").alias("container_id"))


def _served_words(root_html: Column) -> Column:
    shown = replaced(replaced(root_html, r"(?i)<script[\s\S]*?</script>", " "), r"(?i)<style[\s\S]*?</style>", " ")
    return word_count(without_tags(shown))


@lru_cache(maxsize=1)
def ratio_columns() -> dict[str, Column]:
    """The 58 ratios of a report row (roll-up joined with uniqueness, home page and per-site inputs); NULL = N/A."""
    c, n = F.col, F.col("n")
    out = {i: c(f"pass_{i}") / n for i in COV_IDS}
    out |= {i: clamp01(c(f"mean_{i}")) for i in AVG_IDS}
    out["S21"] = F.when(c("multilingual"), out["S21"])
    out["G12"] = F.when(F.coalesce(blocks_snippets(c("headers")), F.lit(False)), 0.0).otherwise(out["G12"])
    out["S15"], out["S16"], out["G17"] = c("unique_titles"), c("unique_descriptions"), c("brand")
    yes_no = lambda flag: F.when(flag, 1.0).otherwise(0.0)
    fetched = F.coalesce(c("robots_fetched"), F.lit(False))
    out["S14"] = F.when(c("sitemap_found").isNotNull(), yes_no(c("sitemap_found")))
    out["G16"] = F.when(c("llms_txt_found").isNotNull(), yes_no(c("llms_txt_found")))
    out["G9"] = F.when(fetched, yes_no(~robots_blocks_ai(c("robots_txt"))))
    out["TB5"] = F.when(fetched, yes_no(~robots_blocks_site(c("robots_txt"))))
    root_html = F.coalesce(c("root_html"), F.lit(""))
    shown = F.coalesce(c("home_words"), c("first_words"))
    out["G3"] = F.when(root_html == "", F.lit(None)).when(shown <= 20, 1.0).otherwise(
        clamp01(_served_words(root_html) / F.greatest(shown * 0.6, F.lit(1.0))))
    det = merged_detectors({d: c(d) for d in DETECTORS}, c("container"))
    out |= tracking_ratios(det, c("container").isNotNull(), root_html)
    out |= header_ratios(c("headers_fetched"), c("headers"))
    return {i: out[i].cast("double") for i in CHECK_IDS}


_AUX_NULLS = {
    "root_url": "string", "robots_fetched": "boolean", "robots_txt": "string", "sitemap_found": "boolean",
    "llms_txt_found": "boolean", "headers_fetched": "boolean", "headers": "map<string,string>", "root_html": "string",
    "gtm_body": "string",
}


def report_rows(
    facts: DataFrame, site_aux: DataFrame | None, as_of: datetime, only: frozenset[str] | None = None
) -> DataFrame:
    """Roll-up plus everything else the ratios read, one row per report, still partitioned by ``report_id``."""
    rows = site_rollup(facts, site_aux, as_of, only)
    if only is None or only & {"S15", "S16"}:
        rows = rows.join(unique_shares(facts), "report_id", "left")
    if site_aux is None:
        rows = rows.withColumns({k: F.lit(None).cast(t) for k, t in _AUX_NULLS.items()})
        rows = rows.withColumn("home_words", F.lit(None).cast("int"))
    else:
        rows = rows.join(site_aux, "report_id", "left")
        if only is None or "G3" in only:
            rows = rows.join(home_words(facts, site_aux), "report_id", "left")
    # The container is only read for sites whose pages carry its id.
    return rows.withColumn("container", F.when(F.col("names_container"), container_facts(F.col("gtm_body"))))


def check_ratio(facts: DataFrame, site_aux: DataFrame | None, as_of: datetime, check_id: str) -> DataFrame:
    """One check for every report, without the aggregates and joins the other 57 need."""
    return report_rows(facts, site_aux, as_of, frozenset([check_id])).select(
        "report_id", F.lit(check_id).alias("check_id"), ratio_columns()[check_id].alias("ratio"))


def check_results(
    facts: DataFrame,
    site_aux: DataFrame | None,
    as_of: datetime,
    verdicts: DataFrame | None = None,
) -> DataFrame:
    """All checks in long form with the rubric: ``report_id, n, has_container, check_id, ratio, semantic, ...``."""
    ratios = ratio_columns()
    entries = F.array(*[F.struct(F.lit(i).alias("check_id"), ratios[i].alias("ratio")) for i in CHECK_IDS])
    long = report_rows(facts, site_aux, as_of).select(
        "report_id", F.col("n").cast("int").alias("n"), F.col("container").isNotNull().alias("has_container"),
        F.explode(entries).alias("e"),
    ).select("report_id", "n", "has_container", "e.check_id", "e.ratio")
    if verdicts is None:
        long = long.withColumn("semantic", F.lit(False))
    else:
        long = override_with_verdicts(long, verdicts)
    return long.join(small(rubric(facts.sparkSession)), "check_id")


def override_with_verdicts(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verified verdicts ``(report_id, check_id, verdict)`` of the four semantic checks replace the measured ratio."""
    usable_verdicts = verdicts.filter(F.col("check_id").isin(*SEMANTIC_CHECKS) & F.col("verdict").isNotNull()).select(
        "report_id", "check_id", clamp01(F.col("verdict")).alias("verdict"))
    return (
        results.join(usable_verdicts, ["report_id", "check_id"], "left")
        .withColumn("semantic", F.col("verdict").isNotNull())
        .withColumn("ratio", F.coalesce("verdict", "ratio"))
        .drop("verdict")
    )


# --- evidence -----------------------------------------------------------------------------------------------------


def failing_paths(failures: DataFrame) -> DataFrame:
    """One row per report, check and path: the reason of the first page with that path.

    Reasons are aggregated by sorting. Failures compress so well that one split of their file holds gigabytes of rows, so they are
    dealt out first, page by page, as a path may have most of them.
    """
    return failures.repartition("report_id", "check_id", "path", "page_ord").groupBy("report_id", "check_id", "path").agg(
        F.min("page_ord").alias("first_ord"), F.min_by("reason", "page_ord").alias("reason"))


def evidence(failures: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` failing paths per report and check, in page order, and how many more there are.

    A list for display: whatever counts or judges pages reads ``failing_paths``, which is whole.

    The rank filter becomes a per-partition limit before the shuffle, so a hot report sends ``limit`` rows per task;
    the overflow is a plain count. Both read the same exchange.
    """
    paths = failing_paths(failures)
    order = Window.partitionBy("report_id", "check_id").orderBy("first_ord", "path")
    listed = (
        paths.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= limit)
        .groupBy("report_id", "check_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "path", "reason"))).alias("items"))
    )
    # Counts through the same columns, so that the plan of ``paths`` is the same on both sides and its exchange reused.
    both = F.col("first_ord").isNotNull() & F.col("reason").isNotNull()
    totals = paths.groupBy("report_id", "check_id").agg(F.count_if(both).alias("total"))
    return listed.join(totals, ["report_id", "check_id"]).select(
        "report_id", "check_id",
        F.transform("items", lambda i: F.struct(i["path"].alias("path"), i["reason"].alias("reason"))).alias("failing"),
        F.when(F.col("total") > limit, (F.col("total") - limit).cast("int")).alias("more"),
    )


def where_label() -> Column:
    """Where a check looked, from ``check_id, dimension, n, ratio, has_container, semantic``; NULL for N/A."""
    n, plural = F.col("n").cast("string"), F.when(F.col("n") == 1, "").otherwise("s")
    across = F.concat(F.lit("Across all "), n, F.lit(" crawled page"), plural)
    tracking = F.concat(F.lit("Tag/script detection across all "), n, F.lit(" crawled page"), plural,
                        F.when(F.col("has_container"), " plus the GTM container").otherwise(""))
    label = F.when(F.col("dimension") == "tracking", tracking)
    for check, text in SOURCE_LABELS.items():
        before, _, after = text.partition("{n}")
        value = F.concat(F.lit(before), n, F.lit(after)) if "{n}" in text else F.lit(text)
        label = label.when(F.col("check_id") == check, value)
    label = label.when(F.col("semantic"), SEMANTIC_LABEL).otherwise(across)
    return F.when(F.col("ratio").isNotNull(), label)


def results_with_evidence(results: DataFrame, failures: DataFrame, limit: int) -> DataFrame:
    """Check results with ``where``, ``checked``, and the first ``limit`` failing paths; N/A and overridden checks list none."""
    listed = F.col("ratio").isNotNull() & ~F.col("semantic")
    return (
        results_with_source(results).join(evidence(failures, limit), ["report_id", "check_id"], "left")
        .withColumn("failing", F.when(listed, F.col("failing")))
        .withColumn("more", F.when(listed, F.col("more")))
    )


def results_with_source(results: DataFrame) -> DataFrame:
    """Check results with where the check looked and, for checks of single pages, how many it saw."""
    per_page = F.col("kind").isin("cov", "avg") & F.col("ratio").isNotNull() & ~F.col("semantic")
    return results.withColumn("where", where_label()).withColumn("checked", F.when(per_page, F.col("n")))


def audited_pages(facts: DataFrame, site_aux: DataFrame | None = None) -> DataFrame:
    """Distinct paths of the usable pages, as rows; ordered by whoever writes them."""
    return with_page_url(facts, site_aux).select("report_id", "path").distinct()


def pages_with_issues(failures: DataFrame) -> DataFrame:
    """Distinct paths per report that fail any coverage check, from the untruncated failures."""
    return failures.select("report_id", "path").distinct().groupBy("report_id").agg(
        F.count("*").alias("pages_with_issues"))


# --- reading results ----------------------------------------------------------------------------------------------


def reason_text(r: Column, style: str = "export") -> Column:
    """One sentence per failure record; ``style`` is 'export' or 'report' (the report page words it differently)."""
    s = lambda f: r[f].cast("string")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    export = {
        "too_short": cat("too short (", s("actual"), " < ", s("min"), ")"),
        "too_long": cat("too long (", s("actual"), " > ", s("max"), ")"),
        "missing": cat("missing ", s("what")),
        "noindex": F.lit("set to noindex"),
        "http_status": cat("returned HTTP ", s("code")),
        "soft_404": F.lit("looks like a soft 404"),
        "non_https": F.lit("served over plain HTTP"),
        "wrong_count": cat("found ", s("actual"), " ", s("what"), " (expected ", s("expected_n"), ")"),
        "mismatch": cat(s("what"), " mismatch (expected ", s("expected"), ", got ", s("actual_s"), ")"),
        "other": s("note"),
    }
    report = export | {
        "too_short": cat(s("actual"), " chars (too short, min ", s("min"), ")"),
        "too_long": cat(s("actual"), " chars (too long, max ", s("max"), ")"),
        "noindex": F.lit("noindex directive set"),
        "soft_404": F.lit("soft-404 (200 OK but the page reads as 'not found')"),
        "non_https": F.lit("served over HTTP, not HTTPS"),
        "wrong_count": cat(s("actual"), " of ", s("what"), " (expected ", s("expected_n"), ")"),
        "mismatch": cat(s("what"), " mismatch (expected '", s("expected"), "', found '", s("actual_s"), "')"),
    }
    texts = export if style == "export" else report
    out = F.when(r.isNull(), F.lit(None if style == "export" else "did not pass").cast("string"))
    for kind, text in texts.items():
        out = out.when(r["kind"] == kind, text)
    return out


def check_status(ratio: Column) -> Column:
    return (
        F.when(ratio.isNull(), "not_applicable").when(ratio >= 1, "pass").when(ratio <= 0, "fail").otherwise("partial"))


def partial_percent(ratio: Column) -> Column:
    return F.when((ratio > 0) & (ratio < 1), F.floor(ratio * 100 + 0.5).cast("int"))
