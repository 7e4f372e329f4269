"""Export model, Markdown and JSON documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.check_sql import DIMS, FAILURES, OVERALL, PLAN, audit_query, lit
from catalog.registry import aux, facts, failures, register, results
from catalog.site_queries import _submitted, _SUBMITTED
from pageloom.functions.urls import is_sensitive
from pageloom.operators import audit, export, matrix, sampling, scoring
from pageloom.plans.guidance import GUIDANCE, LOOKS_FOR, guidance
from pageloom.session import materialize, shared_folder
from pageloom.sources import sinks

_INFO = "info(check_id, why, fix, example, when_na, looks_for) AS (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else lit(v) for v in (*g[:5], LOOKS_FOR[g[0]])) + ")" for g in GUIDANCE) + ")"
_CHK = ("chk AS (SELECT r.*, CASE WHEN ratio IS NULL THEN 'N/A' WHEN ratio >= 1 THEN 'PASS' WHEN ratio <= 0 THEN 'FAIL' ELSE 'PARTIAL' END AS mark, "
        "lower(CASE WHEN ratio IS NULL THEN 'not_applicable' WHEN ratio >= 1 THEN 'pass' WHEN ratio <= 0 THEN 'fail' ELSE 'partial' END) AS status, "
        "why, fix, example, looks_for, CASE WHEN ratio IS NULL THEN when_na END AS when_na FROM results r JOIN info USING (check_id)), "
        "pg AS (SELECT q.*, pos = 1 AS leads, path || coalesce(' (' || reason || ')', '') AS txt FROM franked q JOIN results USING (report_id, check_id) WHERE ratio < 1)")
_TXT = "regexp_replace(format('{:.1f}', score), '[.]0$', '')"
GENERATED = "2024-02-01T00:00:00.000Z"


def _model(spark, sf_dir):
    res = results(spark, sf_dir)
    fails = materialize(failures(spark, sf_dir), "failures")
    full = materialize(audit.results_with_source(res), "results")
    checks = export.export_checks(full, guidance(spark))
    dims = scoring.dimension_scores(full)
    overall = scoring.overall_scores(dims).withColumn("domain", F.col("report_id"))
    actions = export.export_actions(scoring.action_plan(full), checks)
    failing = export.export_pages(matrix.failure_rows(full, fails))
    pages = audit.audited_pages(facts(spark, sf_dir), aux(spark, sf_dir))
    known = facts(spark, sf_dir).select("report_id", "page_ord", "source_url", "status_code").withColumns(
        {c: F.lit("x") for c in ("html", "raw_html", "markdown")})
    failed = sampling.failed_pages(_submitted(spark, sf_dir), known)
    excluded = known.filter("source_url IS NOT NULL").groupBy("report_id").agg(
        F.count_if(is_sensitive(F.concat("source_url", F.lit("/user")))).alias("pages_excluded"))
    return overall, dims, actions, checks, failing, pages, audit.pages_with_issues(fails), failed, excluded


@register("export_checks", audit_query(
    "SELECT c.report_id, c.check_id, status, why, fix, example, looks_for, when_na, path, reason FROM chk c LEFT JOIN pg USING (report_id, check_id)", FAILURES, _INFO, _CHK))
def export_checks(spark, sf_dir):
    model = _model(spark, sf_dir)
    return export.with_pages(model[3], model[4]).select(
        "report_id", "check_id", "status", "why", "fix", "example", "looks_for", "when_na", "path", "reason")


@register("export_actions", audit_query(
    "SELECT p.report_id, p.rank, p.check_id, c.why, c.fix, c.example, path, reason FROM plan p JOIN chk c USING (report_id, check_id) LEFT JOIN pg USING "
    "(report_id, check_id)", FAILURES, _INFO, _CHK, PLAN))
def export_actions(spark, sf_dir):
    model = _model(spark, sf_dir)
    return export.with_pages(model[2], model[4]).select(
        "report_id", "rank", "check_id", "why", "fix", "example", "path", "reason")


_WHERE_TXT = ("CASE WHEN ratio IS NULL THEN NULL WHEN dimension = 'tracking' THEN 'Tag/script detection across all ' || n || ' crawled page' || CASE WHEN n = 1 THEN '' ELSE 's' END || "
              "CASE WHEN known THEN ' plus the GTM container' ELSE '' END WHEN check_id = 'S14' THEN 'A fetch of /sitemap.xml (and the robots.txt Sitemap: directive)' WHEN check_id IN "
              "('G9', 'TB5') THEN 'The site''s robots.txt' WHEN check_id = 'G16' THEN 'A fetch of /llms.txt' WHEN check_id = 'G3' THEN 'The no-JS initial HTML of the home page vs. the "
              "rendered page' WHEN check_id = 'G12' THEN 'Each of the ' || n || ' crawled pages, plus the root URL''s X-Robots-Tag header' WHEN check_id = 'S15' THEN 'Page titles compared "
              "across all ' || n || ' crawled pages' WHEN check_id = 'S16' THEN 'Meta descriptions compared across all ' || n || ' crawled pages' WHEN check_id = 'G17' THEN 'Brand name "
              "compared across all ' || n || ' crawled pages' WHEN check_id LIKE 'TB3_' THEN 'The root URL''s response headers' ELSE 'Across all ' || n || ' crawled page' || CASE WHEN n = 1 "
              "THEN '' ELSE 's' END END")
_K = lambda *parts: " || '|' || ".join(["''", *(p if p.startswith("'") or p == "path" else f"lpad(CAST({p} AS VARCHAR), 12, '0')" for p in parts)])
_N = "chr(10)"
_COVERAGE = (
    "cover AS (SELECT g.*, coalesce(n_pages, 0) AS n_pages, last_path, coalesce(issues, 0) AS issues, coalesce(n_lost, 0) AS n_lost, last_lost, excluded FROM graded g "
    "LEFT JOIN (SELECT report_id, count(*) AS n_pages, max(path) AS last_path FROM (SELECT DISTINCT report_id, path FROM f) GROUP BY 1) USING (report_id) "
    "LEFT JOIN (SELECT report_id, count(DISTINCT path) AS issues FROM fails GROUP BY 1) USING (report_id) "
    "LEFT JOIN (SELECT report_id, count(*) AS n_lost, max((ord, path)) AS last_lost FROM lost GROUP BY 1) USING (report_id) "
    "LEFT JOIN (SELECT report_id, count(*) AS excluded FROM crawl WHERE source_url IS NOT NULL GROUP BY 1) USING (report_id)), "
    "ac AS (SELECT p.*, c.why, c.fix, c.example, EXISTS (FROM pg WHERE pg.report_id = p.report_id AND pg.check_id = p.check_id) AS has_pages FROM plan p JOIN chk c USING (report_id, check_id)), "
    f"ln AS (SELECT c.*, dim_ord, min(ordinal) OVER (PARTITION BY c.report_id, c.dimension) AS lead_ord, {_WHERE_TXT} AS where_txt, EXISTS (FROM pg WHERE pg.report_id = c.report_id AND "
    "pg.check_id = c.check_id) AS has_pages FROM chk c JOIN dim_list USING (dimension))")
_LOST = (
    "asked AS (SELECT report_id, count(*) AS n_asked, any_value(k) AS n_got FROM submitted JOIN (SELECT report_id, count(*) AS k FROM crawl GROUP BY 1) USING (report_id) GROUP BY 1), "
    "lost AS (SELECT report_id, path, min(url_ord) AS ord FROM (SELECT report_id, url_ord, regexp_replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)?', 1), '/+$', '') AS path FROM "
    "submitted WHERE ends_with(url, '/gone') AND NOT contains(url, '?') AND NOT contains(url, '#')) WHERE report_id IN (SELECT report_id FROM asked WHERE n_asked > n_got) GROUP BY "
    "report_id, path)")
_ROW = lambda part, key, text, source: f"SELECT report_id, {part} AS part, {key} AS key, {text} AS text FROM {source}"
_OPT = lambda c, before, after="": f"coalesce('{before}' || {c} || '{after}' || chr(10), '')"
_PARTS = (FAILURES, _INFO, _CHK, DIMS, OVERALL, PLAN, _SUBMITTED, _LOST, _COVERAGE)
_PLAN_PAGES, _LINE_PAGES = "pg JOIN (SELECT report_id, check_id, rank FROM plan) USING (report_id, check_id)", "pg JOIN (SELECT report_id, check_id, dim_ord, ordinal FROM ln) USING (report_id, check_id)"
_MD = audit_query(" UNION ALL ".join([
    _ROW(0, "''", f"'# Site audit - ' || report_id || {_N} || {_N} || '- Overall score: ' || overall || '/100 (grade ' || grade || ')' || CASE WHEN capped THEN ' - capped by a critical failure' "
         f"ELSE '' END || {_N} || '- Generated: {GENERATED}' || {_N} || '- Coverage: ' || n_pages || ' pages audited, ' || issues || ' with issues' || CASE WHEN excluded > 0 THEN ', ' || "
         "excluded || ' excluded (sensitive-path filter)' ELSE '' END || CASE WHEN n_lost > 0 THEN ', ' || n_lost || ' could not be crawled' ELSE '' END || "
         f"{_N} || {_N} || '## Scores by dimension' || {_N} || {_N} || '| Dimension | Score |' || {_N} || '| --- | --- |' || {_N}", "cover"),
    _ROW(1, _K("dim_ord"), f"'| ' || dim_label || ' | ' || CASE WHEN not_applicable THEN 'Not assessed' ELSE {_TXT} || '/100' END || CASE WHEN capped THEN ' (capped)' ELSE '' END || ' |' || {_N}", "dims"),
    _ROW(2, "''", f"{_N} || '## Prioritized action plan' || {_N} || {_N}", "graded"),
    _ROW(3, "''", f"'No issues found - every applicable check passed.' || {_N}", "graded WHERE report_id NOT IN (SELECT report_id FROM plan)"),
    _ROW(3, _K("rank", "'0'"), f"CASE WHEN rank > 1 THEN {_N} ELSE '' END || '### ' || rank || '. ' || finding || '  [' || check_id || ': ' || severity || ', impact ' || impact || '/5, effort ' || "
         f"effort || '/5' || CASE WHEN quick_win THEN ', quick win' ELSE '' END || CASE WHEN requires_approval THEN ', needs sign-off' ELSE '' END || ']' || {_N} || "
         f"{_OPT('why', '- Why it matters: ')} || {_OPT('fix', '- How to fix: ')} || {_OPT('example', '- Example: `', '`')} || '- Affected pages: ' || CASE WHEN has_pages THEN '' ELSE 'site-wide' END", "ac"),
    _ROW(3, _K("rank", "'1'", "first_ord", "path"), "CASE WHEN leads THEN '' ELSE ', ' END || txt", _PLAN_PAGES),
    _ROW(3, _K("rank", "'2'"), _N, "ac"),
    _ROW(4, "''", f"{_N} || '## Full check results' || {_N} || {_N}", "graded"),
    _ROW(5, _K("dim_ord"), f"CASE WHEN dim_ord > 0 THEN {_N} ELSE '' END || '### ' || dim_label || CASE WHEN not_applicable THEN ' - Not assessed' ELSE ' - ' || {_TXT} || '/100' END || {_N}", "dims"),
    _ROW(5, _K("dim_ord", "ordinal", "'0'"), "'- [' || mark || '] ' || check_id || ' ' || label || CASE WHEN mark NOT IN ('FAIL', 'PARTIAL') THEN '' WHEN has_pages THEN ' - failing: ' ELSE "
         "coalesce(' - ' || where_txt, '') END", "ln"),
    _ROW(5, _K("dim_ord", "ordinal", "'1'", "first_ord", "path"), "CASE WHEN leads THEN '' ELSE ', ' END || txt", _LINE_PAGES),
    _ROW(5, _K("dim_ord", "ordinal", "'2'"), _N, "ln"),
    _ROW(6, "''", f"{_N} || '## Crawl coverage' || {_N} || {_N} || CASE WHEN n_pages > 0 THEN '- Audited: ' ELSE '' END", "cover WHERE n_pages > 0 OR n_lost > 0"),
    _ROW(7, _K("path"), "path || CASE WHEN path < last_path THEN ', ' ELSE '' END", "(SELECT DISTINCT report_id, path FROM f) JOIN cover USING (report_id)"),
    _ROW(8, "''", f"CASE WHEN n_pages > 0 THEN {_N} ELSE '' END || '- Excluded (sensitive-path filter): ' || excluded", "cover WHERE (n_pages > 0 OR n_lost > 0) AND excluded > 0"),
    _ROW(9, _K("1", "ord", "path"), f"{_N} || '- Could not crawl ' || path || ': timed out / never returned'", "lost JOIN graded USING (report_id)"),
    _ROW(10, "''", _N, "cover WHERE n_pages > 0 OR n_lost > 0")]), *_PARTS)


@register("export_markdown", _MD)
def export_markdown(spark, sf_dir):
    return export.markdown_parts(*_model(spark, sf_dir), generated_at=GENERATED)


_Q = lambda c: f"coalesce(CAST(to_json({c}) AS VARCHAR), 'null')"
_NUM = lambda c, d: f"coalesce(CAST(CAST(round({c}, {d}) AS DECIMAL(12,{d})) AS VARCHAR), 'null')"
_OBJ = lambda **fields: " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in fields.items())
_PAGE = "CASE WHEN leads THEN '' ELSE ',' END || '{' || " + _OBJ(path=_Q("path"), reason=_Q("reason")) + " || '}'"
_JSON = audit_query(" UNION ALL ".join([
    _ROW(0, "''", "'{' || " + _OBJ(tool="'\"Site\"'", domain=_Q("report_id"), generatedAt=f"'\"{GENERATED}\"'", overall="overall", grade=_Q("grade"), capped="capped")
         + " || ',\"coverage\":{\"pagesAudited\":['", "cover"),
    _ROW(1, _K("path"), f"{_Q('path')} || CASE WHEN path < last_path THEN ',' ELSE '' END", "(SELECT DISTINCT report_id, path FROM f) JOIN cover USING (report_id)"),
    _ROW(2, "''", "'],' || " + _OBJ(pagesWithIssues="issues", pagesExcluded="coalesce(CAST(excluded AS VARCHAR), 'null')") + " || ',\"pagesFailed\":['", "cover"),
    _ROW(3, _K("1", "ord", "path"), "'{' || " + _OBJ(path=_Q("path"), reason="'\"timed out / never returned\"'") + " || '}' || CASE WHEN (ord, path) < last_lost THEN ',' ELSE '' END",
         "lost JOIN cover USING (report_id)"),
    _ROW(4, "''", "']},\"dimensions\":['", "cover"),
    _ROW(5, _K("dim_ord"), "CASE WHEN dim_ord > 0 THEN ',' ELSE '' END || '{' || " + _OBJ(
        id=_Q("dimension"), label=_Q("dim_label"), score=_NUM("CASE WHEN NOT not_applicable THEN score END", 1), rawScore=_NUM("CASE WHEN NOT not_applicable THEN raw_score END", 1),
        capped="capped", notApplicable="not_applicable") + " || ',\"checks\":['", "dims"),
    _ROW(5, _K("dim_ord", "ordinal", "'0'"), "CASE WHEN ordinal > lead_ord THEN ',' ELSE '' END || '{' || " + _OBJ(
        id=_Q("check_id"), label=_Q("label"), status=_Q("status"), ratio=_NUM("ratio", 6), severity=_Q("severity"), where=_Q("where_txt"), why=_Q("why"), fix=_Q("fix"),
        example=_Q("example"), whenNotApplicable=_Q("when_na")) + " || ',\"failingPages\":['", "ln"),
    _ROW(5, _K("dim_ord", "ordinal", "'1'", "first_ord", "path"), _PAGE, _LINE_PAGES),
    _ROW(5, _K("dim_ord", "ordinal", "'2'"), "']}'", "ln"),
    _ROW(5, _K("dim_ord", "'~'"), "']}'", "dims"),
    _ROW(6, "''", "'],\"actionPlan\":['", "cover"),
    _ROW(7, _K("rank", "'0'"), "CASE WHEN rank > 1 THEN ',' ELSE '' END || '{' || " + _OBJ(
        rank="rank", checkId=_Q("check_id"), finding=_Q("finding"), severity=_Q("severity"), impact="impact", effort="effort", quickWin="quick_win",
        requiresApproval="requires_approval", why=_Q("why"), fix=_Q("fix"), example=_Q("example")) + " || ',\"affectedPages\":['", "ac"),
    _ROW(7, _K("rank", "'1'", "first_ord", "path"), _PAGE, _PLAN_PAGES),
    _ROW(7, _K("rank", "'2'"), "']}'", "ac"),
    _ROW(8, "''", "']}' || chr(10)", "cover")]), *_PARTS)


@register("export_json", _JSON)
def export_json(spark, sf_dir):
    return export.json_parts(*_model(spark, sf_dir), generated_at=GENERATED)


def _whole(parts_sql: str) -> str:
    return (f"SELECT report_id, CAST(sum(strlen(text)) AS BIGINT) AS bytes, md5(string_agg(text, '' ORDER BY part, key)) AS digest FROM ({parts_sql}) GROUP BY report_id")


@register("json_documents", _whole(_JSON))
def json_documents(spark, sf_dir):
    parts = export.json_parts(*_model(spark, sf_dir), generated_at=GENERATED)
    return sinks.write_documents(parts, shared_folder(spark, "json-documents")).select("report_id", "bytes", "digest")


@register("markdown_documents", _whole(_MD))
def markdown_documents(spark, sf_dir):
    parts = export.markdown_parts(*_model(spark, sf_dir), generated_at=GENERATED)
    return sinks.write_documents(parts, shared_folder(spark, "markdown-documents"), ".md").select("report_id", "bytes", "digest")
