"""Reports as documents: the export model, Markdown and JSON.

A document is a table of parts ``(report_id, part, key, text)`` whose texts, in order of part and key, are the document.
Lists without a bound (audited pages, failing pages of a check, pages that could not be crawled) are a part per element, so
nothing is cut and no report is ever gathered into one value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.operators.audit import check_status, reason_text
from pageloom.operators.sampling import failed_text
from pageloom.operators.scoring import score_text
from pageloom.session import salted_join, small

# Marks, headings and sentences of the documents.
MARKS = {"pass": "PASS", "partial": "PARTIAL", "fail": "FAIL", "not_applicable": "N/A"}
PLAN_HEADING = "## Prioritized action plan\n\n"
CHECKS_HEADING = "## Full check results\n\n"
COVERAGE_HEADING = "\n## Crawl coverage\n\n"
NO_ISSUES = "No issues found - every applicable check passed.\n"


def export_checks(results: DataFrame, guidance: DataFrame) -> DataFrame:
    """Checks with status and guidance; their failing pages are the rows of ``export_pages``."""
    return results.join(small(guidance.select("check_id", "why", "fix", "example", "when_na", "looks_for")), "check_id", "left").select(
        "report_id", "check_id", "ordinal", "label", "dimension", "severity", "ratio", "where", "why", "fix", "example", "looks_for",
        F.when(F.col("ratio").isNull(), F.col("when_na")).alias("when_na"), check_status(F.col("ratio")).alias("status"))


def export_pages(rows: DataFrame) -> DataFrame:
    """Failing pages of findings, each with its reason as text and whether it is the first of its check."""
    pages = rows.filter(F.col("ratio") < 1).select(
        "report_id", "check_id", "first_ord", "path", reason_text(F.col("reason")).alias("reason"))
    first = pages.groupBy("report_id", "check_id").agg(F.min(F.struct("first_ord", "path")).alias("first"))
    return salted_join(pages, first, ["report_id", "check_id"], "inner", "path").withColumn(
        "leads", F.struct("first_ord", "path") == F.col("first")).drop("first")


def with_pages(findings: DataFrame, failing: DataFrame) -> DataFrame:
    """Findings with a row per failing page, or one without a page: a left join whose pages of one finding are spread over tasks."""
    keys = ["report_id", "check_id"]
    listed = salted_join(failing.select(*keys, "path", "reason"), findings, keys, "inner", "path")
    none = findings.join(failing.filter("leads").select(*keys), keys, "left_anti")
    return listed.unionByName(none.withColumns({c: F.lit(None).cast("string") for c in ("path", "reason")}))


def export_actions(plan: DataFrame, checks: DataFrame) -> DataFrame:
    """Ranked actions with guidance."""
    info = checks.select("report_id", "check_id", "why", "fix", "example")
    return plan.join(info, ["report_id", "check_id"], "left")


def page_text() -> Column:
    return F.concat("path", F.when(F.col("reason").isNotNull(), F.concat(F.lit(" ("), F.col("reason"), F.lit(")"))).otherwise(""))


def _line(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _part(df: DataFrame, number: int, text: Column, *key: Column | str) -> DataFrame:
    """Rows as parts; numbers in a key are padded, so that keys sort as their elements do."""
    pieces = [F.lpad(F.col(k).cast("string"), 12, "0") if isinstance(k, str) and dict(df.dtypes)[k] in ("int", "bigint") else
              F.col(k) if isinstance(k, str) else k for k in key]
    return df.select("report_id", F.lit(number).alias("part"), F.concat_ws("|", F.lit(""), *pieces).alias("key"), text.alias("text"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _coverage(reports: DataFrame, pages: DataFrame, issues: DataFrame, failed: DataFrame, excluded: DataFrame) -> DataFrame:
    """Reports with the counts of the coverage section, and the last of their audited and lost pages."""
    n_pages = pages.groupBy("report_id").agg(F.count("*").alias("n_pages"), F.max("path").alias("last_path"))
    lost = failed.groupBy("report_id").agg(F.count("*").alias("n_lost"), F.max(F.struct("pass_no", "ord", "path")).alias("last_lost"))
    return (
        reports.join(n_pages, "report_id", "left").join(issues, "report_id", "left").join(lost, "report_id", "left")
        .join(excluded, "report_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_pages", "pages_with_issues", "n_lost")})
    )


def _listed(pages: DataFrame, failed: DataFrame, cov: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audited and lost pages with whether another follows."""
    audited = salted_join(pages, cov.select("report_id", "last_path"), ["report_id"], "inner", "path").withColumn(
        "more", F.col("path") < F.col("last_path"))
    lost = salted_join(failed, cov.select("report_id", "last_lost"), ["report_id"], "inner", "path").withColumn(
        "more", F.struct("pass_no", "ord", "path") < F.col("last_lost")).withColumn("reason", failed_text(F.col("reason")))
    return audited, lost


def markdown_parts(
    overall: DataFrame, dims: DataFrame, actions: DataFrame, checks: DataFrame, failing: DataFrame, pages: DataFrame, issues: DataFrame,
    failed: DataFrame, excluded: DataFrame, generated_at: str, tool: str = "Site",
) -> DataFrame:
    """Markdown documents in parts. ``overall`` carries ``report_id, domain, overall, grade, capped``; ``failing`` is ``export_pages``."""
    cov = _coverage(overall, pages, issues, failed, excluded)
    bits = _line(
        F.col("n_pages").cast("string"), " pages audited, ", F.col("pages_with_issues").cast("string"), " with issues",
        F.when(F.col("pages_excluded") > 0, _line(", ", F.col("pages_excluded").cast("string"),
                                                  " excluded (sensitive-path filter)")).otherwise(""),
        F.when(F.col("n_lost") > 0, _line(", ", F.col("n_lost").cast("string"), " could not be crawled")).otherwise(""))
    head = _line(
        f"# {tool} audit - ", F.col("domain"), "\n\n- Overall score: ", F.col("overall").cast("string"), "/100 (grade ",
        F.col("grade"), ")", F.when(F.col("capped"), " - capped by a critical failure").otherwise(""),
        f"\n- Generated: {generated_at}\n- Coverage: ", bits, "\n\n## Scores by dimension\n\n| Dimension | Score |\n| --- | --- |\n")
    scored = F.when(F.col("not_applicable"), "Not assessed").otherwise(_line(score_text(F.col("score")), "/100"))
    row = _line("| ", F.col("dim_label"), " | ", scored, F.when(F.col("capped"), " (capped)").otherwise(""), " |\n")
    tags = _line(F.col("severity"), ", impact ", F.col("impact").cast("string"), "/5, effort ", F.col("effort").cast("string"), "/5",
                 F.when(F.col("quick_win"), ", quick win").otherwise(""),
                 F.when(F.col("requires_approval"), ", needs sign-off").otherwise(""))
    opt = lambda c, before, after="": F.when(F.col(c).isNotNull(), _line(before, F.col(c), after, "\n")).otherwise("")
    has_pages = failing.filter("leads").select("report_id", "check_id", F.lit(True).alias("has_pages"))
    acts = actions.join(has_pages, ["report_id", "check_id"], "left")
    block = _line(
        F.when(F.col("rank") > 1, "\n").otherwise(""), "### ", F.col("rank").cast("string"), ". ", F.col("finding"), "  [", F.col("check_id"), ": ", tags, "]\n",
        opt("why", "- Why it matters: "), opt("fix", "- How to fix: "), opt("example", "- Example: `", "`"),
        "- Affected pages: ", F.when(F.col("has_pages"), "").otherwise("site-wide"))
    affected = salted_join(failing, actions.select("report_id", "check_id", "rank"), ["report_id", "check_id"], "inner", "path")
    mark = None
    for status, text in MARKS.items():
        mark = F.when(F.col("status") == status, text) if mark is None else mark.when(F.col("status") == status, text)
    found = F.col("status").isin("fail", "partial")
    lines = checks.join(has_pages, ["report_id", "check_id"], "left").join(dims.select("report_id", "dimension", "dim_ord"), ["report_id", "dimension"])
    check_line = _line("- [", mark, "] ", F.col("check_id"), " ", F.col("label"), F.when(found, F.when(F.col("has_pages"), " - failing: ").otherwise(
        F.coalesce(_line(" - ", F.col("where")), F.lit("")))).otherwise(""))
    listed = salted_join(failing, lines.select("report_id", "check_id", "dim_ord", "ordinal"), ["report_id", "check_id"], "inner", "path")
    section = _line(F.when(F.col("dim_ord") > 0, "\n").otherwise(""), "### ", F.col("dim_label"), F.when(
        F.col("not_applicable"), " - Not assessed").otherwise(_line(" - ", score_text(F.col("score")), "/100")), "\n")
    covered = cov.filter((F.col("n_pages") > 0) | (F.col("n_lost") > 0))
    audited, lost = _listed(pages, failed, cov)
    comma = F.when(F.col("leads"), "").otherwise(", ")
    first, middle, last = F.lit("0"), F.lit("1"), F.lit("2")
    end = F.lit("\n")
    excluded_line = _line(F.when(F.col("n_pages") > 0, "\n").otherwise(""), "- Excluded (sensitive-path filter): ", F.col("pages_excluded").cast("string"))
    return _union([
        _part(cov, 0, head),
        _part(dims, 1, row, "dim_ord"),
        _part(overall, 2, F.lit("\n" + PLAN_HEADING)),
        _part(overall.join(actions.filter("rank = 1").select("report_id"), "report_id", "left_anti"), 3, F.lit(NO_ISSUES)),
        _part(acts, 3, block, "rank", first),
        _part(affected, 3, _line(comma, page_text()), "rank", middle, "first_ord", "path"),
        _part(acts, 3, end, "rank", last),
        _part(overall, 4, F.lit("\n" + CHECKS_HEADING)),
        _part(dims, 5, section, "dim_ord"),
        _part(lines, 5, check_line, "dim_ord", "ordinal", first),
        _part(listed, 5, _line(comma, page_text()), "dim_ord", "ordinal", middle, "first_ord", "path"),
        _part(lines, 5, end, "dim_ord", "ordinal", last),
        _part(covered, 6, _line(COVERAGE_HEADING, F.when(F.col("n_pages") > 0, "- Audited: ").otherwise(""))),
        _part(audited, 7, F.concat("path", F.when(F.col("more"), ", ").otherwise("")), "path"),
        _part(covered.filter(F.col("pages_excluded") > 0), 8, excluded_line),
        _part(lost, 9, _line("\n- Could not crawl ", F.col("path"), ": ", F.col("reason")), "pass_no", "ord", "path"),
        _part(covered, 10, end),
    ])


def quoted(c: Column) -> Column:
    """A value as JSON text, null as null."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.to_json(F.array(c)), r"^\[", ""), r"\]\z", ""), F.lit("null"))


def json_number(c: Column, digits: int) -> Column:
    return F.coalesce(F.round(c, digits).cast(f"decimal(12,{digits})").cast("string"), F.lit("null"))


def _object(**fields: Column) -> Column:
    """Fields as the inside of a JSON object."""
    return F.concat_ws(",", *[_line(f'"{name}":', value) for name, value in fields.items()])


def json_parts(
    overall: DataFrame, dims: DataFrame, actions: DataFrame, checks: DataFrame, failing: DataFrame, pages: DataFrame, issues: DataFrame,
    failed: DataFrame, excluded: DataFrame, generated_at: str, tool: str = "Site",
) -> DataFrame:
    """The export model as JSON in parts; ratios have six digits, scores one."""
    cov = _coverage(overall, pages, issues, failed, excluded)
    audited, lost = _listed(pages, failed, cov)
    whole, flag = (lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))), (lambda c: F.col(c).cast("string"))
    head = _line("{", _object(tool=quoted(F.lit(tool)), domain=quoted(F.col("domain")), generatedAt=quoted(F.lit(generated_at)), overall=whole("overall"),
                              grade=quoted(F.col("grade")), capped=flag("capped")), ',"coverage":{"pagesAudited":[')
    counts = _line("],", _object(pagesWithIssues=whole("pages_with_issues"), pagesExcluded=whole("pages_excluded")), ',"pagesFailed":[')
    assessed = ~F.col("not_applicable")
    dim = _line(F.when(F.col("dim_ord") > 0, ",").otherwise(""), "{", _object(
        id=quoted(F.col("dimension")), label=quoted(F.col("dim_label")), score=json_number(F.when(assessed, F.col("score")), 1),
        rawScore=json_number(F.when(assessed, F.col("raw_score")), 1), capped=flag("capped"), notApplicable=flag("not_applicable")), ',"checks":[')
    lead = checks.groupBy("report_id", "dimension").agg(F.min("ordinal").alias("lead"))
    lines = checks.join(lead, ["report_id", "dimension"]).join(dims.select("report_id", "dimension", "dim_ord"), ["report_id", "dimension"])
    check = _line(F.when(F.col("ordinal") > F.col("lead"), ",").otherwise(""), "{", _object(
        id=quoted(F.col("check_id")), label=quoted(F.col("label")), status=quoted(F.col("status")), ratio=json_number(F.col("ratio"), 6),
        severity=quoted(F.col("severity")), where=quoted(F.col("where")), why=quoted(F.col("why")), fix=quoted(F.col("fix")),
        example=quoted(F.col("example")), whenNotApplicable=quoted(F.col("when_na"))), ',"failingPages":[')
    action = _line(F.when(F.col("rank") > 1, ",").otherwise(""), "{", _object(
        rank=whole("rank"), checkId=quoted(F.col("check_id")), finding=quoted(F.col("finding")), severity=quoted(F.col("severity")),
        impact=whole("impact"), effort=whole("effort"), quickWin=flag("quick_win"), requiresApproval=flag("requires_approval"),
        why=quoted(F.col("why")), fix=quoted(F.col("fix")), example=quoted(F.col("example"))), ',"affectedPages":[')
    page = _line(F.when(F.col("leads"), "").otherwise(","), "{", _object(path=quoted(F.col("path")), reason=quoted(F.col("reason"))), "}")
    listed = salted_join(failing, lines.select("report_id", "check_id", "dim_ord", "ordinal"), ["report_id", "check_id"], "inner", "path")
    affected = salted_join(failing, actions.select("report_id", "check_id", "rank"), ["report_id", "check_id"], "inner", "path")
    first, middle, last, after = F.lit("0"), F.lit("1"), F.lit("2"), F.lit("~")
    close = F.lit("]}")
    comma = F.when(F.col("more"), ",").otherwise("")
    return _union([
        _part(cov, 0, head),
        _part(audited, 1, F.concat(quoted(F.col("path")), comma), "path"),
        _part(cov, 2, counts),
        _part(lost, 3, _line("{", _object(path=quoted(F.col("path")), reason=quoted(F.col("reason"))), "}", comma), "pass_no", "ord", "path"),
        _part(cov, 4, F.lit(']},"dimensions":[')),
        _part(dims, 5, dim, "dim_ord"),
        _part(lines, 5, check, "dim_ord", "ordinal", first),
        _part(listed, 5, page, "dim_ord", "ordinal", middle, "first_ord", "path"),
        _part(lines, 5, close, "dim_ord", "ordinal", last),
        _part(dims, 5, close, "dim_ord", after),
        _part(cov, 6, F.lit('],"actionPlan":[')),
        _part(actions, 7, action, "rank", first),
        _part(affected, 7, page, "rank", middle, "first_ord", "path"),
        _part(actions, 7, close, "rank", last),
        _part(cov, 8, F.lit("]}\n")),
    ])
