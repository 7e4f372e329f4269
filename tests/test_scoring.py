import pytest
from pyspark.sql import functions as F

from pageloom.operators import scoring

COLS = "report_id string, check_id string, dimension string, weight int, severity string, effort int, ordinal int, label string, ratio double"


def results(spark, report, *rows):
    return spark.createDataFrame([(report, c, d, w, s, e, i, c, r) for i, (c, d, w, s, e, r) in enumerate(rows)], COLS)


def score(df):
    dims = scoring.dimension_scores(df)
    return {r.dimension: r for r in dims.collect()}, scoring.overall_scores(dims).first()


def test_capped_site(spark):
    df = results(spark, "r", ("S1", "seo", 10, "high", 1, 1.0), ("S2", "seo", 7, "medium", 1, 0.5), ("T1", "tracking", 16, "high", 3, None),
                 ("T5", "tracking", 16, "high", 3, 1.0), ("G1", "geo", 8, "high", 2, 0.75), ("TB4", "tech", 14, "critical", 1, 1.0),
                 ("TB1", "tech", 16, "critical", 2, 0.0))
    dims, top = score(df)
    assert (dims["seo"].score, dims["tracking"].score, dims["geo"].score, dims["tech"].score) == (79.4, 100.0, 75.0, 46.7)
    assert dims["tech"].capped and dims["tech"].capped_by == ["TB1"]
    assert (top.overall, top.grade, top.capped) == (69, "D", True)
    assert round(top.math, 2) == 76.91


def test_na_dimension_is_left_out(spark):
    df = results(spark, "r", ("a", "seo", 5, "low", 1, 0.8), ("b", "tracking", 5, "low", 1, None), ("c", "geo", 5, "low", 1, 0.8),
                 ("d", "tech", 5, "low", 1, 0.8))
    dims, top = score(df)
    assert dims["tracking"].not_applicable and dims["tracking"].score == 0
    assert (top.overall, top.grade) == (80, "B")


def test_nothing_assessable(spark):
    _, top = score(results(spark, "r", ("a", "seo", 5, "low", 1, None)))
    assert (top.overall, top.grade) == (0, "F")


def test_critical_failure_caps_at_one_grade_below(spark):
    df = results(spark, "r", ("a", "seo", 5, "low", 1, 1.0), ("b", "tracking", 5, "low", 1, 1.0), ("c", "geo", 5, "low", 1, 1.0),
                 ("d", "tech", 1, "critical", 1, 0.0), ("e", "tech", 99, "low", 1, 1.0))
    dims, top = score(df)
    assert dims["tech"].score == 59 and dims["tech"].raw_score == 99
    assert (top.overall, top.grade) == (89, "B")


def test_partial_critical_does_not_cap(spark):
    dims, _ = score(results(spark, "r", ("d", "tech", 1, "critical", 1, 0.1)))
    assert not dims["tech"].capped


@pytest.mark.parametrize("value,letter", [(100, "A"), (90, "A"), (89, "B"), (70, "C"), (60, "D"), (59, "F"), (0, "F")])
def test_grades(spark, value, letter):
    assert spark.range(1).select(scoring.grade(F.lit(value))).first()[0] == letter


def test_plan_order(spark):
    df = results(spark, "r", ("low", "seo", 1, "low", 1, 0.0), ("high1", "seo", 1, "high", 2, 0.0), ("med", "tracking", 1, "medium", 1, 0.9),
                 ("high2", "seo", 1, "high", 2, 0.5), ("pass", "seo", 1, "critical", 1, 1.0), ("na", "seo", 1, "critical", 1, None),
                 ("hard", "seo", 1, "critical", 4, 0.0))
    plan = scoring.action_plan(df).orderBy("rank").collect()
    assert [p.check_id for p in plan] == ["hard", "high1", "high2", "med", "low"]
    assert [p.priority for p in plan] == [6, 6, 6, 5, 3]
    assert [p.quick_win for p in plan] == [False, True, True, False, False]
    assert [p.requires_approval for p in plan] == [False, False, False, True, False]


def test_renormalisation_is_invariant_to_na_checks(spark):
    base = [("a", "seo", 5, "low", 1, 0.4), ("b", "seo", 3, "low", 1, 0.9)]
    plain, _ = score(results(spark, "r", *base))
    more, _ = score(results(spark, "r", *base, ("c", "seo", 50, "critical", 1, None)))
    assert plain["seo"].score == more["seo"].score
