"""Checks, evidence, scores, action plans and page matrices over the derived crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.check_sql import DIMS, FAILURES, OVERALL, PLAN, audit_query
from catalog.registry import AS_OF, aux, dims, facts, failures, register, results, results_table
from pageloom.operators import audit, matrix, scoring
from pageloom.operators.signals import DETECTORS, any_tracking, merged_detectors, robots_flags
from pageloom.plans.rubric import CHECK_IDS, dimensions, rubric
from pageloom.session import small


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("ratio", F.round("ratio", 9))


def _register_check(check_id: str) -> None:
    sql = audit_query(f"SELECT report_id, check_id, round(ratio, 9) AS ratio FROM checks WHERE check_id = '{check_id}'")

    @register(f"check_{check_id}", sql)
    def run(spark, sf_dir):
        return _rounded(audit.check_ratio(facts(spark, sf_dir), aux(spark, sf_dir), AS_OF, check_id))


for _id in CHECK_IDS:
    _register_check(_id)


@register("check_results", audit_query(
    "SELECT report_id, check_id, dimension, round(ratio, 9) AS ratio, CASE WHEN ratio IS NULL THEN 'not_applicable' WHEN ratio >= 1 "
    "THEN 'pass' WHEN ratio <= 0 THEN 'fail' ELSE 'partial' END AS status, CASE WHEN ratio > 0 AND ratio < 1 THEN "
    "CAST(floor(ratio * 100 + 0.5) AS INT) END AS partial_pct FROM results"))
def check_results(spark, sf_dir):
    ratio = F.col("ratio")
    return results(spark, sf_dir).select(
        "report_id", "check_id", "dimension", F.round("ratio", 9).alias("ratio"),
        audit.check_status(ratio).alias("status"), audit.partial_percent(ratio).alias("partial_pct"))


_PAGE_FACT_SQL = audit_query(
    "SELECT report_id, page_ord, words, path, url, stats AS statistics, " + ", ".join(
        f"d_{d} AS det_{d}" for d in DETECTORS) + " FROM f")


@register("page_facts", _PAGE_FACT_SQL)
def page_fact_rows(spark, sf_dir):
    pages = audit.with_page_url(facts(spark, sf_dir), aux(spark, sf_dir))
    return pages.select("report_id", "page_ord", "words", "path", "url", "statistics", *[f"det_{d}" for d in DETECTORS])


_FAILED = "SELECT report_id, page_ord, path, check_id, reason FROM fails"


@register("page_failures", audit_query(_FAILED, FAILURES))
def page_failures(spark, sf_dir):
    return failures(spark, sf_dir).withColumn("reason", audit.reason_text(F.col("reason")))


@register("page_failures_report_wording", audit_query(
    "SELECT report_id, page_ord, path, check_id, CASE WHEN check_id IN ('S1', 'S2', 'S10') AND reason LIKE 'too short%' THEN "
    "regexp_replace(reason, 'too short \\((\\d+) < (\\d+)\\)', '\\1 chars (too short, min \\2)') WHEN reason LIKE 'too long (%' THEN "
    "regexp_replace(reason, 'too long \\((\\d+) > (\\d+)\\)', '\\1 chars (too long, max \\2)') WHEN check_id = 'S4' THEN "
    "'noindex directive set' WHEN reason = 'looks like a soft 404' THEN 'soft-404 (200 OK but the page reads as ''not found'')' "
    "WHEN check_id = 'TB1' THEN 'served over HTTP, not HTTPS' WHEN check_id = 'S23' THEN regexp_replace(reason, "
    "'^canonical mismatch \\(expected (.*), got (.*)\\)$', 'canonical mismatch (expected ''\\1'', found ''\\2'')') "
    "WHEN reason LIKE 'found %(expected %' THEN regexp_replace(reason, '^found (\\d+) ', '\\1 of ') ELSE reason END AS reason "
    "FROM fails", FAILURES))
def page_failures_report_wording(spark, sf_dir):
    return failures(spark, sf_dir).withColumn("reason", audit.reason_text(F.col("reason"), style="report"))


@register("evidence_lists", audit_query(
    "SELECT report_id, check_id, string_agg(path || ' (' || reason || ')', '; ' ORDER BY pos) FILTER (pos <= 12) AS failing, "
    "CASE WHEN max(total) > 12 THEN CAST(max(total) - 12 AS INT) END AS more FROM franked GROUP BY ALL", FAILURES))
def evidence_lists(spark, sf_dir):
    ev = audit.evidence(failures(spark, sf_dir), limit=12)
    text = F.transform("failing", lambda f: F.concat(f["path"], F.lit(" ("), audit.reason_text(f["reason"]), F.lit(")")))
    return ev.select("report_id", "check_id", F.array_join(text, "; ").alias("failing"), "more")


@register("failing_paths", audit_query("SELECT report_id, check_id, path, first_ord, reason FROM fpaths", FAILURES))
def failing_paths(spark, sf_dir):
    rows = audit.failing_paths(failures(spark, sf_dir))
    return rows.select("report_id", "check_id", "path", "first_ord", audit.reason_text(F.col("reason")).alias("reason"))


@register("pages_with_issues", audit_query(
    "SELECT report_id, count(DISTINCT path) AS pages_with_issues FROM fails GROUP BY report_id", FAILURES))
def pages_with_issues(spark, sf_dir):
    return audit.pages_with_issues(failures(spark, sf_dir))


@register("audited_pages", audit_query("SELECT DISTINCT report_id, path FROM f"))
def audited_pages(spark, sf_dir):
    return audit.audited_pages(facts(spark, sf_dir), aux(spark, sf_dir))


_WHERE = """SELECT report_id, check_id, CASE WHEN ratio IS NULL THEN NULL
  WHEN dimension = 'tracking' THEN 'Tag/script detection across all ' || n || ' crawled page' || CASE WHEN n = 1 THEN '' ELSE 's' END ||
    CASE WHEN known THEN ' plus the GTM container' ELSE '' END
  WHEN check_id = 'S14' THEN 'A fetch of /sitemap.xml (and the robots.txt Sitemap: directive)'
  WHEN check_id IN ('G9', 'TB5') THEN 'The site''s robots.txt' WHEN check_id = 'G16' THEN 'A fetch of /llms.txt'
  WHEN check_id = 'G3' THEN 'The no-JS initial HTML of the home page vs. the rendered page'
  WHEN check_id = 'G12' THEN 'Each of the ' || n || ' crawled pages, plus the root URL''s X-Robots-Tag header'
  WHEN check_id = 'S15' THEN 'Page titles compared across all ' || n || ' crawled pages'
  WHEN check_id = 'S16' THEN 'Meta descriptions compared across all ' || n || ' crawled pages'
  WHEN check_id = 'G17' THEN 'Brand name compared across all ' || n || ' crawled pages'
  WHEN check_id LIKE 'TB3_' THEN 'The root URL''s response headers'
  ELSE 'Across all ' || n || ' crawled page' || CASE WHEN n = 1 THEN '' ELSE 's' END END AS "where" FROM results"""


@register("source_labels", audit_query(_WHERE))
def source_labels(spark, sf_dir):
    return results(spark, sf_dir).select("report_id", "check_id", audit.where_label().alias("where"))


# --- signals ---

@register("site_detectors", audit_query(
    "SELECT report_id, known AS has_container, ga4, gtm, consent, consent_v2, cmp, pixels, data_layer, ua, recorder, "
    "ga4 OR gtm OR consent OR consent_v2 OR cmp OR pixels OR data_layer OR ua AS any_tracking FROM site"))
def site_detectors(spark, sf_dir):
    rows = audit.report_rows(facts(spark, sf_dir), aux(spark, sf_dir), AS_OF)
    det = merged_detectors({d: F.col(d) for d in DETECTORS}, F.col("container"))
    return rows.select("report_id", F.col("container").isNotNull().alias("has_container"),
                       *[det[d].alias(d) for d in DETECTORS], any_tracking(det).alias("any_tracking"))


@register("tag_containers", audit_query(
    "SELECT report_id, gtm_id AS container_id, CASE WHEN known THEN len(list_distinct(regexp_extract_all(gtm_body, 'G-[A-Z0-9]{8,}'))) "
    "END AS ga4_ids, CASE WHEN known THEN len(list_distinct(regexp_extract_all(gtm_body, 'AW-[0-9]+'))) END AS ads_ids FROM site"))
def tag_containers(spark, sf_dir):
    rows = audit.report_rows(facts(spark, sf_dir), aux(spark, sf_dir), AS_OF, frozenset())
    known = F.col("container").isNotNull()
    return rows.join(audit.container_ids(facts(spark, sf_dir)), "report_id", "left").select(
        "report_id", "container_id", F.when(known, F.size("container.ga4")).alias("ga4_ids"),
        F.when(known, F.size("container.adwords")).alias("ads_ids"))


@register("robots_rules", audit_query(
    "SELECT report_id, report_id IN (SELECT report_id FROM blocked_site) AS site_blocked, "
    "report_id IN (SELECT report_id FROM blocked_ai) AS ai_blocked FROM aux"))
def robots_rules(spark, sf_dir):
    return robots_flags(aux(spark, sf_dir))


@register("site_inputs", audit_query(
    "SELECT report_id, root_url, robots_status IS NOT NULL AS robots_fetched, length(robots) AS robots_chars, "
    "CASE WHEN sitemap_status IS NOT NULL THEN sitemap_status = 200 OR regexp_matches(robots, '(?i)(^|\\n)\\s*sitemap:') END "
    "AS sitemap_found, CASE WHEN llms_status IS NOT NULL THEN llms_status = 200 END AS llms_txt_found, hdr AS headers_fetched, "
    "CASE WHEN h_fetched THEN nullif(h_hsts, '') END AS hsts FROM aux"))
def site_inputs(spark, sf_dir):
    return aux(spark, sf_dir).select(
        "report_id", "root_url", "robots_fetched", F.length("robots_txt").alias("robots_chars"), "sitemap_found",
        "llms_txt_found", "headers_fetched",
        F.try_element_at("headers", F.lit("strict-transport-security")).alias("hsts"))


# --- scores ---

@register("dimension_scores", audit_query(
    "SELECT report_id, dimension, score, raw_score, capped, capped_by, not_applicable FROM dims", DIMS))
def dimension_scores(spark, sf_dir):
    return dims(spark, sf_dir).select("report_id", "dimension", "score", "raw_score", "capped",
                                      F.array_join("capped_by", ",").alias("capped_by"), "not_applicable")


@register("overall_scores", audit_query(
    "SELECT report_id, round(math, 6) AS math, overall, grade, capped, CASE WHEN overall >= 90 THEN 'good' WHEN overall >= 50 THEN "
    "'fair' ELSE 'weak' END AS band FROM graded", DIMS, OVERALL))
def overall_scores(spark, sf_dir):
    return scoring.overall_scores(dims(spark, sf_dir)).select(
        "report_id", F.round("math", 6).alias("math"), "overall", "grade", "capped",
        scoring.score_band(F.col("overall")).alias("band"))


_PLAN_COLS = ("report_id, rank, check_id, finding, severity, impact, effort, priority, quick_win, requires_approval")


@register("action_plan", audit_query(f"SELECT {_PLAN_COLS} FROM plan", PLAN))
def action_plan(spark, sf_dir):
    return scoring.action_plan(results(spark, sf_dir)).select(*_PLAN_COLS.split(", "))


@register("action_plan_high_first_20", audit_query(
    "SELECT report_id, check_id, row_number() OVER (PARTITION BY report_id ORDER BY rank) AS shown FROM plan WHERE severity = 'high' "
    "QUALIFY shown <= 20", PLAN))
def action_plan_high(spark, sf_dir):
    plan = scoring.action_plan(results(spark, sf_dir))
    return scoring.plan_view(plan, "high", first=20).select("report_id", "check_id", "shown")


@register("severity_counts", audit_query("SELECT report_id, severity, count(*) AS findings FROM plan GROUP BY ALL", PLAN))
def severity_counts(spark, sf_dir):
    return scoring.severity_counts(scoring.action_plan(results(spark, sf_dir))).select("report_id", "severity", "findings")


@register("tracking_flags", audit_query(
    "SELECT report_id, bool_or(check_id IN ('T1', 'T5', 'T6', 'T7') AND coalesce(ratio < 1, false)) AS tracking_incomplete, "
    "bool_or(check_id = 'T3' AND coalesce(ratio = 1, false)) AS has_gtm, count(ratio) = 0 AS tracking_na FROM results "
    "WHERE dimension = 'tracking' GROUP BY report_id"))
def tracking_flags(spark, sf_dir):
    return scoring.tracking_flags(results(spark, sf_dir))


@register("rubric_coverage", audit_query(
    "SELECT dimension, count(DISTINCT check_id) AS checks, CAST(sum(weight) / count(DISTINCT report_id) AS BIGINT) AS weight_sum, "
    "CAST(floor(max(dim_weight) * 100 + 0.5) AS INT) AS weight_pct, count(ratio) AS assessed FROM results JOIN dim_list USING (dimension) "
    "GROUP BY dimension"))
def rubric_coverage(spark, sf_dir):
    assessed = results(spark, sf_dir).groupBy("check_id").agg(F.count("ratio").alias("assessed"))
    return (
        assessed.join(small(rubric(spark)), "check_id").join(small(dimensions(spark)), "dimension")
        .groupBy("dimension").agg(
            F.count("*").alias("checks"), F.sum("weight").alias("weight_sum"),
            F.floor(F.max("dim_weight") * 100 + 0.5).cast("int").alias("weight_pct"), F.sum("assessed").alias("assessed"))
    )


_TXT = "regexp_replace(format('{:.1f}', score), '[.]0$', '')"


@register("scorecards", audit_query(
    "SELECT report_id, 'Overall: ' || overall || '/100 (grade ' || grade || ').' || chr(10) || 'Dimensions: ' || ds || '.' || "
    "chr(10) || 'Top findings to fix:' || chr(10) || coalesce(ts, '') AS scorecard FROM graded JOIN (SELECT report_id, "
    f"string_agg(dim_label || ' ' || {_TXT} || '/100' || CASE WHEN capped THEN ' (capped by a critical issue)' ELSE '' END, '; ' "
    "ORDER BY dim_ord) AS ds FROM dims GROUP BY 1) USING (report_id) LEFT JOIN (SELECT report_id, string_agg('- ' || finding || "
    "' [' || severity || ']', chr(10) ORDER BY rank) AS ts FROM plan WHERE rank <= 6 GROUP BY 1) USING (report_id)",
    DIMS, OVERALL, PLAN))
def scorecards(spark, sf_dir):
    res = results_table(spark, sf_dir)
    d = scoring.dimension_scores(res)
    return scoring.scorecards(d, scoring.overall_scores(d), scoring.action_plan(res), top=6)


@register("summary_inputs", audit_query(
    "SELECT report_id, overall, grade, ds AS dimensions_json, coalesce(ts, '[]') AS findings_json FROM graded JOIN (SELECT report_id, "
    "'[' || string_agg('{\"id\":\"' || dimension || '\",\"label\":\"' || dim_label || '\",\"score\":' || CAST(score AS VARCHAR) || "
    "',\"capped\":' || capped || '}', ',' ORDER BY dim_ord) || ']' AS ds FROM dims GROUP BY 1) USING (report_id) LEFT JOIN (SELECT "
    "report_id, '[' || string_agg('{\"fix\":\"' || replace(finding, '\"', '\\\"') || '\",\"severity\":\"' || severity || "
    "'\",\"impact\":' || impact || ',\"effort\":' || effort || ',\"quickWin\":' || quick_win || '}', ',' ORDER BY rank) || ']' AS ts "
    "FROM plan WHERE rank <= 8 GROUP BY 1) USING (report_id)", DIMS, OVERALL, PLAN))
def summary_inputs(spark, sf_dir):
    res = results_table(spark, sf_dir)
    d = scoring.dimension_scores(res)
    return scoring.summary_inputs(d, scoring.overall_scores(d), scoring.action_plan(res), top=8)


# --- per page ---

_LISTED = ("listed AS (SELECT r.report_id, r.check_id, r.severity, r.impact, r.ordinal, r.ratio, q.path, q.reason, q.pos, q.total FROM "
           "franked q JOIN results r USING (report_id, check_id) WHERE r.ratio IS NOT NULL)")
_MATRIX = ("pm AS (SELECT a.report_id, a.path, count(l.check_id) AS n_failures, max(l.impact) AS worst, "
           "coalesce(string_agg(l.check_id, ',' ORDER BY l.ordinal), '') AS failing FROM (SELECT DISTINCT report_id, path FROM f) a "
           "LEFT JOIN listed l USING (report_id, path) GROUP BY ALL)")
_SEV = ("CASE worst WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' WHEN 1 THEN 'info' ELSE 'clean' "
        "END")


def _pages(spark, sf_dir):
    return audit.audited_pages(facts(spark, sf_dir), aux(spark, sf_dir))


def _rows(spark, sf_dir):
    return matrix.failure_rows(results(spark, sf_dir), failures(spark, sf_dir))


@register("page_matrix", audit_query("SELECT report_id, path, failing FROM pm", FAILURES, _LISTED, _MATRIX))
def page_matrix(spark, sf_dir):
    return matrix.page_matrix(_pages(spark, sf_dir), _rows(spark, sf_dir)).select(
        "report_id", "path", F.array_join(F.transform("failures", lambda f: f["check_id"]), ",").alias("failing"))


@register("page_severity", audit_query(
    f"SELECT report_id, path, n_failures, {_SEV} AS severity FROM pm", FAILURES, _LISTED, _MATRIX))
def page_severity(spark, sf_dir):
    return matrix.page_severity(_pages(spark, sf_dir), _rows(spark, sf_dir))


@register("severity_histogram", audit_query(
    "SELECT report_id, " + ", ".join(f"CAST(count(*) FILTER ({_SEV} = '{b}') AS INT) AS {b}" for b in matrix.BUCKETS)
    + " FROM pm GROUP BY report_id", FAILURES, _LISTED, _MATRIX))
def severity_histogram(spark, sf_dir):
    return matrix.severity_histogram(matrix.page_severity(_pages(spark, sf_dir), _rows(spark, sf_dir)))


@register("total_issues", audit_query(
    "SELECT report_id, CAST(coalesce(k, bad) AS INT) AS total_issues FROM (SELECT report_id, count(worst) AS bad FROM pm GROUP BY 1) "
    "LEFT JOIN (SELECT report_id, count(DISTINCT path) AS k FROM fails GROUP BY 1) USING (report_id)",
    FAILURES, _LISTED, _MATRIX))
def total_issues(spark, sf_dir):
    hist = matrix.severity_histogram(matrix.page_severity(_pages(spark, sf_dir), _rows(spark, sf_dir)))
    return matrix.total_issues(hist, audit.pages_with_issues(failures(spark, sf_dir)))


@register("affected_pages", audit_query(
    "SELECT report_id, check_id, CAST(max(total) AS INT) AS affected FROM listed WHERE ratio < 1 GROUP BY ALL", FAILURES, _LISTED))
def affected_pages(spark, sf_dir):
    return matrix.affected_pages(_rows(spark, sf_dir))


@register("legacy_evidence", audit_query(
    "SELECT report_id, check_id, path, CAST(NULL AS VARCHAR) AS reason FROM listed", FAILURES, _LISTED))
def legacy_evidence(spark, sf_dir):
    """Failing paths in the old shape (bare paths) read back as records, row by row."""
    item = F.explode(matrix.normalized_failing(F.array("path"), legacy=True)).alias("f")
    return _rows(spark, sf_dir).select("report_id", "check_id", item).select("report_id", "check_id", "f.path", "f.reason")


@register("site_scores_with_top_fixes", audit_query(
    "SELECT g.report_id, g.overall, g.grade, g.capped, p.rank, p.check_id, p.finding, p.severity, p.priority FROM graded g LEFT JOIN "
    "plan p ON g.report_id = p.report_id AND p.rank <= 3", DIMS, OVERALL, PLAN))
def site_scores_with_top_fixes(spark, sf_dir):
    """The flagship: every site scored, with its grade and the three most valuable fixes."""
    res = results_table(spark, sf_dir)
    overall = scoring.overall_scores(scoring.dimension_scores(res)).select("report_id", "overall", "grade", "capped")
    top = scoring.action_plan(res).filter(F.col("rank") <= 3).select(
        "report_id", "rank", "check_id", "finding", "severity", "priority")
    return overall.join(top, "report_id", "left")

