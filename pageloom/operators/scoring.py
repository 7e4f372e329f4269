"""Scores, grades and the action plan from check results in long form.

Input rows: ``report_id, check_id, dimension, weight, severity, effort, ordinal, label, ratio`` (NULL ratio = N/A).
Results are partitioned by ``report_id`` already, so grouping by report and dimension and ranking within a report
need no further shuffle; a report has 58 rows at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import round_half_up
from pageloom.plans.rubric import CRITICAL_CAP, DIMENSIONS, GRADES, SEVERITIES

SEVERITY_RANK = dict(SEVERITIES)


def severity_rank(severity: Column) -> Column:
    out = None
    for name, rank in SEVERITIES:
        out = F.when(severity == name, rank) if out is None else out.when(severity == name, rank)
    return out


def _by_dimension(position: int) -> Column:
    out = None
    for i, row in enumerate(DIMENSIONS):
        value = i if position < 0 else row[position]
        hit = F.col("dimension") == row[0]
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def grade(score: Column) -> Column:
    out = None
    for letter, low in GRADES:
        out = F.when(score >= low, letter) if out is None else out.when(score >= low, letter)
    return out.otherwise("F")


def score_band(score: Column) -> Column:
    return F.when(score >= 90, "good").when(score >= 50, "fair").otherwise("weak")


def dimension_scores(results: DataFrame) -> DataFrame:
    """Weighted mean of the assessable checks, capped at 59 by a failed critical check; N/A if nothing counts.

    Weights are whole numbers and N/A ratios are NULL, so SQL's NULL rules do the renormalisation.
    """
    r, w = F.col("ratio"), F.col("weight")
    failed_critical = (F.col("severity") == "critical") & (r == 0)
    sums = results.groupBy("report_id", "dimension").agg(
        F.sum(F.when(r.isNotNull(), w)).alias("w"),
        F.sum(w * r).alias("wr"),
        F.array_sort(F.collect_list(F.when(failed_critical, F.struct("ordinal", "check_id")))).alias("caps"),
    )
    raw = 100 * F.col("wr") / F.col("w")
    capped = F.size("caps") > 0
    return sums.select(
        "report_id",
        _by_dimension(-1).alias("dim_ord"),
        "dimension",
        _by_dimension(1).alias("dim_label"),
        F.coalesce(round_half_up(F.when(capped, F.least(raw, F.lit(float(CRITICAL_CAP)))).otherwise(raw), 1),
                   F.lit(0.0)).alias("score"),
        F.coalesce(round_half_up(raw, 1), F.lit(0.0)).alias("raw_score"),
        capped.alias("capped"),
        F.when(capped, F.transform("caps", lambda c: c["check_id"])).alias("capped_by"),
        F.col("w").isNull().alias("not_applicable"),
    )


def overall_scores(dims: DataFrame) -> DataFrame:
    """Overall 0-100, grade and cap flag per report from the rounded dimension scores."""
    share = F.when(~F.col("not_applicable"), _by_dimension(2))
    # Four rows per report, added in dimension order so that the sum does not depend on row order.
    parts = [F.sum(F.when(F.col("dimension") == d[0], share * F.col("score"))) for d in DIMENSIONS]
    shares = [F.sum(F.when(F.col("dimension") == d[0], share)) for d in DIMENSIONS]
    zero = F.lit(0.0)
    total, weight = zero, zero
    for p, s in zip(parts, shares):
        total, weight = total + F.coalesce(p, zero), weight + F.coalesce(s, zero)
    sums = dims.groupBy("report_id").agg(
        total.alias("total"), weight.alias("weight"), F.bool_or("capped").alias("capped"),
        F.bool_or((F.col("dimension") == "tracking") & F.col("not_applicable")).alias("tracking_na"))
    math = F.when(F.col("weight") > 0, F.col("total") / F.col("weight")).otherwise(0.0)
    floor_to = None
    for letter, low in GRADES[:-1]:
        hit = grade(math) == letter
        floor_to = F.when(hit, float(low - 1)) if floor_to is None else floor_to.when(hit, float(low - 1))
    floored = F.when(F.col("capped") & (grade(math) != "F"), F.least(math, floor_to)).otherwise(math)
    overall = F.floor(floored + 0.5).cast("int")
    return sums.select(
        "report_id", math.alias("math"), overall.alias("overall"), grade(overall).alias("grade"), "capped",
        "tracking_na")


def action_items(results: DataFrame) -> DataFrame:
    """Failing and partly failing checks with impact, priority and flags; N/A and passing checks drop out."""
    impact = severity_rank(F.col("severity"))
    effort = F.coalesce("effort", F.lit(3))
    return results.filter(F.col("ratio") < 1).select(
        "report_id", "check_id", F.col("label").alias("finding"), "severity", "ordinal", "dimension",
        impact.alias("impact"), effort.alias("effort"), (impact * 2 - effort).alias("priority"),
        ((impact >= 4) & (effort <= 2)).alias("quick_win"),
        (F.col("dimension") == "tracking").alias("requires_approval"),
    )


def action_plan(results: DataFrame) -> DataFrame:
    """Action items ranked by priority, severity, then rubric order."""
    order = Window.partitionBy("report_id").orderBy(F.desc("priority"), F.desc("impact"), "ordinal")
    return action_items(results).withColumn("rank", F.row_number().over(order))


def plan_view(plan: DataFrame, severity: str | None = None, first: int | None = None) -> DataFrame:
    """Items of a plan, of one severity or of all; the ``first`` of them where a number is given."""
    if severity is not None:
        plan = plan.filter(F.col("severity") == severity)
    order = Window.partitionBy("report_id").orderBy("rank")
    shown = plan.withColumn("shown", F.row_number().over(order))
    return shown if first is None else shown.filter(F.col("shown") <= first)


def severity_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("report_id", "severity").agg(
        F.count("*").alias("findings"), F.max("impact").alias("severity_rank"))


def tracking_flags(results: DataFrame) -> DataFrame:
    """Does tracking look incomplete, is there a tag manager, is the whole dimension N/A."""
    ratio_of = lambda i: F.max(F.when(F.col("check_id") == i, F.col("ratio")))
    low = F.bool_or(F.col("check_id").isin("T1", "T5", "T6", "T7") & F.coalesce(F.col("ratio") < 1, F.lit(False)))
    return results.filter(F.col("dimension") == "tracking").groupBy("report_id").agg(
        low.alias("tracking_incomplete"),
        F.coalesce(ratio_of("T3") == 1, F.lit(False)).alias("has_gtm"),
        (F.count("ratio") == 0).alias("tracking_na"),
    )


def score_text(score: Column) -> Column:
    """Scores as text the way documents print them: no trailing '.0'."""
    return F.regexp_replace(F.format_string("%.1f", score), r"\.0\z", "")


def scorecards(dims: DataFrame, overall: DataFrame, plan: DataFrame, top: int) -> DataFrame:
    """Plain-text scorecard per report: overall, dimensions, first findings. Three bounded lists per report."""
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("dim_ord", "dim_label", "score", "capped"))),
        lambda d: F.concat(d["dim_label"], F.lit(" "), score_text(d["score"]), F.lit("/100"),
                           F.when(d["capped"], " (capped by a critical issue)").otherwise("")))
    dim_text = dims.groupBy("report_id").agg(F.array_join(lines, "; ").alias("dims"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", "finding", "severity"))),
                        lambda a: F.concat(F.lit("- "), a["finding"], F.lit(" ["), a["severity"], F.lit("]")))
    top_text = plan.filter(F.col("rank") <= top).groupBy("report_id").agg(F.array_join(items, "\n").alias("top"))
    return overall.join(dim_text, "report_id").join(top_text, "report_id", "left").select(
        "report_id",
        F.concat(F.lit("Overall: "), F.col("overall").cast("string"), F.lit("/100 (grade "), F.col("grade"),
                 F.lit(").\nDimensions: "), F.col("dims"), F.lit(".\nTop findings to fix:\n"),
                 F.coalesce("top", F.lit(""))).alias("scorecard"),
    )


def summary_inputs(dims: DataFrame, overall: DataFrame, plan: DataFrame, top: int) -> DataFrame:
    """What the summary writer gets: grade, dimensions and the first findings as JSON."""
    dim_json = dims.groupBy("report_id").agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("dim_ord", "dimension", "dim_label", "score", "capped"))),
        lambda d: F.struct(d["dimension"].alias("id"), d["dim_label"].alias("label"), d["score"].alias("score"),
                           d["capped"].alias("capped")))).alias("dimensions_json"))
    top_json = plan.filter(F.col("rank") <= top).groupBy("report_id").agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "finding", "severity", "impact", "effort", "quick_win"))),
        lambda a: F.struct(a["finding"].alias("fix"), a["severity"].alias("severity"), a["impact"].alias("impact"),
                           a["effort"].alias("effort"), a["quick_win"].alias("quickWin")))).alias("findings_json"))
    return overall.join(dim_json, "report_id").join(top_json, "report_id", "left").select(
        "report_id", "overall", "grade", "dimensions_json",
        F.coalesce("findings_json", F.lit("[]")).alias("findings_json"))
