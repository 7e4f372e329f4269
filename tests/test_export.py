import json

import pytest
from pyspark.sql import functions as F

from catalog import export_queries
from pageloom.operators import audit, export
from pageloom.sources import sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return [df.cache() for df in export_queries._model(spark, SF)]


def documents(parts):
    """Texts of each report in order of part and key."""
    rows = {}
    for r in parts.collect():
        rows.setdefault(r.report_id, []).append((r.part, r.key, r.text))
    return {report: "".join(text for _, _, text in sorted(own)) for report, own in rows.items()}


def test_json_documents(model):
    docs = {report: json.loads(text) for report, text in documents(export.json_parts(*model, generated_at="now")).items()}
    assert len(docs) == model[0].count()
    paths, failing = {}, {}
    for r in model[5].collect():
        paths.setdefault(r.report_id, []).append(r.path)
    for r in model[4].collect():
        failing.setdefault((r.report_id, r.check_id), []).append((r.first_ord, r.path, r.reason))
    for report, d in docs.items():
        assert d["coverage"]["pagesAudited"] == sorted(paths[report])
        assert [x["id"] for x in d["dimensions"]] == ["seo", "tracking", "geo", "tech"]
        assert sum(len(x["checks"]) for x in d["dimensions"]) == 58
        assert [a["rank"] for a in d["actionPlan"]] == list(range(1, len(d["actionPlan"]) + 1))
        assert set(d["coverage"]) == {"pagesAudited", "pagesWithIssues", "pagesExcluded", "pagesFailed"}
        listed = [(c["id"], c["failingPages"]) for x in d["dimensions"] for c in x["checks"]] + [(a["checkId"], a["affectedPages"]) for a in d["actionPlan"]]
        for check, pages in listed:  # every failing page, in page order
            assert [(p["path"], p["reason"]) for p in pages] == [f[1:] for f in sorted(failing.get((report, check), []))]


def test_written_parts_are_the_document(spark, model, tmp_path):
    parts = export.markdown_parts(*model, generated_at="now").cache()
    docs = documents(parts)
    sinks.write_parts(parts, str(tmp_path / "parts"))
    back = documents(spark.read.parquet(str(tmp_path / "parts")))
    assert back == docs and len(docs) == model[0].count()
    for report, doc in docs.items():
        assert doc.startswith(f"# Site audit - {report}\n\n- Overall score: ") and doc.endswith("\n") and "\n\n\n" not in doc


def test_large_reports_lose_nothing(spark, model):
    """A report with very many failing pages: as many parts as pages, none dropped."""
    one = model[0].select("report_id").first().report_id
    many = model[4].filter(F.col("report_id") == one).limit(1).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(30_000)))).withColumns(
        {"path": F.concat(F.lit("/p"), F.col("i")), "first_ord": F.col("i") + 1_000_000, "leads": F.lit(False)}).drop("i")
    parts = export.json_parts(*model[:4], model[4].unionByName(many), *model[5:], generated_at="now")
    doc = json.loads(documents(parts.filter(F.col("report_id") == one))[one])
    assert sum(len(c["failingPages"]) for x in doc["dimensions"] for c in x["checks"]) >= 30_000


def test_pages_of_one_finding_are_spread_and_findings_without_pages_stay(spark):
    findings = spark.createDataFrame([("r", "S1", 1), ("r", "S2", 2), (None, "S1", 3)], "report_id string, check_id string, rank int")
    rows = [("r", "S1", f"/{i}", "why", i == 0) for i in range(50)] + [("x", "S1", "/", "why", True)]
    failing = spark.createDataFrame(rows, "report_id string, check_id string, path string, reason string, leads boolean")
    out = export.with_pages(findings, failing)
    want = findings.join(failing.drop("leads"), ["report_id", "check_id"], "left").select(*out.columns)
    assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty() and out.count() == 52


def test_failures_are_dealt_out_before_they_are_sorted(spark, capsys):
    """All failures of one path in one file still go to several tasks."""
    rows = [("r", p, "/", "S1", (f"{p}",)) for p in range(400)]
    failures = spark.createDataFrame(rows, "report_id string, page_ord long, path string, check_id string, reason struct<note:string>").coalesce(1)
    paths = audit.failing_paths(failures)
    assert [(r.first_ord, r.reason.note) for r in paths.collect()] == [(0, "0")]
    paths.explain()
    plan = capsys.readouterr().out
    sorts = [line for line in plan.splitlines() if "hashpartitioning(report_id" in line]
    assert any("page_ord" in line for line in sorts) and any("page_ord" not in line for line in sorts)
