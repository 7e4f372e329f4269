from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pageloom.operators import access
from pageloom.session import salted_join
from pageloom.sources.crawl import lowered_headers, robots_text, sitemap_found, unwrapped_json

NOW = datetime(2024, 6, 1)


def reports(spark):
    rows = [("a", 1, "done", NOW - timedelta(days=1), None, 90), ("b", 1, "crawling", NOW - timedelta(minutes=11), "", None),
            ("c", 2, "queued", NOW - timedelta(minutes=9), None, None), ("d", 2, "error", NOW - timedelta(days=100), "x", None)]
    return spark.createDataFrame(rows, "report_id string, user_id int, status string, created_at timestamp, error string, score_overall int")


def docs(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, "not-a-uuid"), (4, "d")], "doc_id int, report_id string")


def test_watchdog(spark):
    out = {r.report_id: (r.status, r.error) for r in access.stuck_to_error(reports(spark), NOW).collect()}
    assert out == {"a": ("done", None), "b": ("error", access.TIMEOUT_TEXT), "c": ("queued", None), "d": ("error", "x")}


def test_purge_keeps_documents_of_unknown_reports(spark):
    leads = spark.createDataFrame([(1, NOW - timedelta(days=366)), (2, NOW)], "lead_id int, created_at timestamp")
    r, d, l = access.purge(reports(spark), docs(spark), leads, NOW)
    assert {x.report_id for x in r.collect()} == {"a", "b", "c"}
    assert {x.doc_id for x in d.collect()} == {1, 2, 3}
    assert [x.lead_id for x in l.collect()] == [2]


def test_owner_scope(spark):
    seen = access.scoped(docs(spark), reports(spark), F.lit(1), "doc_id").collect()
    assert {x.doc_id for x in seen} == {1, 2}


def test_delete_only_own_reports(spark):
    ids = spark.createDataFrame([("a",), ("d",)], "report_id string")
    steps = spark.createDataFrame([(1, "a"), (2, "d")], "step_id int, report_id string")
    messages = spark.createDataFrame([(1, "a")], "message_id int, report_id string")
    out = access.delete_reports(ids, F.lit(1), docs(spark), reports(spark), steps, messages)
    assert {x.report_id for x in out["reports"].collect()} == {"b", "c", "d"}
    assert {x.doc_id for x in out["documents"].collect()} == {2, 3, 4}
    assert [x.step_id for x in out["steps"].collect()] == [2] and out["messages"].count() == 0


def test_history(spark):
    df = reports(spark).withColumn("domain", F.lit("d"))
    out = [(r.report_id, r.grade) for r in access.history_list(df, NOW, days=7, first=100).orderBy("user_id", "pos").collect()]
    assert out == [("b", "?"), ("a", "A"), ("c", "?")]


def test_latest_rows(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y")], "id string, at int, v string")
    assert access.latest_rows(log, "id", ["at"]).first().v == "z"


def test_finished_reports(spark):
    scores = spark.createDataFrame([("a", 70)], "report_id string, overall int")
    out = {r.report_id: (r.status, r.score_overall, r.error) for r in access.finished_reports(reports(spark), scores).collect()}
    assert out["a"] == ("done", 70, None) and out["b"] == ("error", None, access.NO_CONTENT_TEXT)


def test_source_rules(spark):
    df = spark.createDataFrame([(200, "User-agent: *\n Sitemap: x", 404), (404, "Sitemap: x", 404), (None, None, None)], "s int, b string, m int")
    rob = robots_text(F.col("s"), F.col("b"))
    assert [tuple(r) for r in df.select(rob, sitemap_found(F.col("m"), rob)).collect()] == [
        ("User-agent: *\n Sitemap: x", True), ("", False), ("", None)]
    h = spark.createDataFrame([({"X-A": ["1", "2"], "b": ["3"]},)], "h map<string,array<string>>")
    assert h.select(lowered_headers(F.col("h"))).first()[0] == {"x-a": "1, 2", "b": "3"}
    j = spark.createDataFrame([('{"a":1}',), ('"{\\"a\\":1}"',), ("x",)], "j string")
    assert [r[0] for r in j.select(unwrapped_json(F.col("j"))).collect()] == ['{"a":1}', '{"a":1}', None]


def test_copies_of_a_salted_join_are_counted_before_they_are_broadcast(spark, capsys):
    """The right side alone is below the size check, its copies for all salts are not."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "400000")
    try:
        left = spark.range(300_000).withColumnRenamed("id", "report_id").withColumn("row", F.col("report_id"))
        right = spark.range(20_000).withColumnRenamed("id", "report_id")
        joined = salted_join(left, right, ["report_id"], "left_semi", "row")
        joined.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert joined.count() == 20_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
