import hashlib
import json

from pageloom.operators.facts import page_facts, usable
from pageloom.sources import sinks
from pageloom.sources.crawl import read_pages
from pageloom.streaming.runner import file_stream


def test_pages_from_json_keep_the_schema(spark, tmp_path):
    rows = [{"report_id": "r", "page_ord": 1, "raw_html": "<h1>x</h1>", "unknown": 1}, {"report_id": "r", "page_ord": 2}, {"report_id": "r", "title": "t"}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, rows)))
    pages = read_pages(spark, str(tmp_path / "p.json"), "json")
    assert "unknown" not in pages.columns and pages.count() == 3
    assert usable(pages).count() == 2  # the second row has neither content nor metadata
    assert page_facts(pages).filter("h1_tags = 1").count() == 1


def test_report_sink_partitions(spark, tmp_path):
    df = spark.createDataFrame([("a", "done", 70), ("b", "error", None)], "report_id string, status string, score_overall int")
    sinks.write_reports(df, str(tmp_path / "out"), "status")
    assert spark.read.parquet(str(tmp_path / "out")).filter("status = 'error'").first().report_id == "b"


def test_merged_reports_keep_the_others(spark, tmp_path):
    """Two writes of different reports both remain, later versions win whatever comes first, and a repeat changes nothing."""
    path, schema = str(tmp_path / "reports"), "report_id string, version int, status string, score_overall int"
    first = spark.createDataFrame([(f"r{i}", 1, "queued", None) for i in range(300)] + [("r7", 3, "done", 70), ("r7", 2, "crawling", None)], schema)
    second = spark.createDataFrame([(f"r{i}", 2, "done", i % 100) for i in range(200, 400)] + [("r7", 2, "late", 1)], schema)
    table = lambda: sorted((r.report_id, r.version, r.status, r.score_overall) for r in spark.read.parquet(path).collect())
    sinks.merge_reports(first, path, ["version"], buckets=16)
    sinks.merge_reports(second, path, ["version"], buckets=16)
    want = {f"r{i}": (1, "queued", None) for i in range(200)} | {f"r{i}": (2, "done", i % 100) for i in range(200, 400)} | {"r7": (3, "done", 70)}
    assert table() == sorted((k, *v) for k, v in want.items())
    for again in (first, second):
        sinks.merge_reports(again, path, ["version"], buckets=16)
    assert table() == sorted((k, *v) for k, v in want.items())
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "reports").rglob("*.parquet")}
    sinks.merge_reports(spark.createDataFrame([("r5", 9, "error", None)], schema), path, ["version"], buckets=16)
    kept = {f for f in (tmp_path / "reports").rglob("*.parquet")} & set(before)
    assert len({f.parent for f in kept}) == len({f.parent for f in before}) - 1  # one bucket was replaced
    sinks.merge_reports(first.limit(0), path, ["version"], buckets=16)
    assert dict((r[0], r[1:]) for r in table())["r5"] == (9, "error", None)


def test_one_document_per_report(spark, tmp_path):
    """Each file is its report's document, also of one report with 100,000 pages, whatever tasks its parts lie in."""
    pages = spark.range(100_000).selectExpr("'big' AS report_id", "1 AS part", "lpad(CAST(id AS STRING), 9, '0') AS key", "concat(if(id > 0, ',', ''), '{\"path\":\"/é', id, '\"}') AS text")
    ends = spark.createDataFrame([("big", 0, "", '{"pages":['), ("big", 2, "", "]}"), ("é/../x", 0, "", '{"pages":['), ("é/../x", 1, "", "]}"), ("null", 0, "", "{}"), ("null", 1, "", None)],
                                 "report_id string, part int, key string, text string")
    index = sinks.write_documents(pages.unionByName(ends).repartition(7), str(tmp_path / "documents")).collect()
    assert sorted(r.report_id for r in index) == ["big", "null", "é/../x"]
    docs = {r.report_id: (tmp_path / "documents" / r.file).read_bytes() for r in index}
    assert all(len(docs[r.report_id]) == r.bytes and hashlib.md5(docs[r.report_id]).hexdigest() == r.digest for r in index)
    assert [p["path"] for p in json.loads(docs["big"])["pages"]] == [f"/é{i}" for i in range(100_000)]
    assert json.loads(docs["é/../x"]) == {"pages": []} and json.loads(docs["null"]) == {}
    assert sinks.write_documents(ends.limit(0), str(tmp_path / "none")).count() == 0


def test_step_sink(spark, tmp_path):
    steps = spark.createDataFrame([("r", 1)], "report_id string, id int")
    steps.write.parquet(str(tmp_path / "in"))
    query = sinks.write_steps(file_stream(spark, str(tmp_path / "in"), steps.schema), str(tmp_path / "steps"), str(tmp_path / "state"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "steps")).count() == 1
