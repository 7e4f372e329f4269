import re

import pytest

import corpus_pipeline
from catalog.compare import compare, duck
from pageloom.llm import contamination, secrets, simhash, toxicity
from pageloom.llm.queries import QUERIES, SQL
from tests.llm.odd import no_documents, odd_documents

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "pipeline"])
def test_queries(spark, name):
    state, rows, note = compare(spark, duck(SF), name, QUERIES[name], SQL.get(name), SF)
    assert state == ("ok" if name in SQL else "rows-only"), note
    assert rows > 0 or name == "op3_decontamination"


def test_every_stage_does_its_whole_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs.cache()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(stage(spark, kept[-1], SF).cache())
        assert k == len(corpus_pipeline.STAGES) - 1 or kept[-1].columns == columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    scores = toxicity.toxicity_scores(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids[1] == {r.doc_id for r in scores.where("predicted = 0").collect()}
    assert ids[2] == {r.doc_id for r in simhash.near_duplicates(kept[1]).where("doc_id = component_id").collect()}
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids[3] == ids[2] - {r.doc_id for r in contamination.contained_items(kept[2], items).collect()}
    assert ids[4] == ids[3]
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in kept[3:5])
    dirty = {r.doc_id for r in secrets.found_secrets(kept[3]).where("spans <> ''").collect()}
    assert {k for k in before if before[k] != after[k]} == dirty
    assert not any(secrets.base_spans(t or "") for t in after.values())
    mix = kept[5]
    assert {"copies", "taken", "target"} <= set(mix.columns) and mix.where("copies < 1 or copies > 3 or taken <> copies * size").count() == 0
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == r.size for r in mix.collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, mix.collect()))
    for d in kept:
        d.unpersist()


@pytest.mark.parametrize("rows", [odd_documents, no_documents])
def test_stages_bear_odd_rows(spark, rows):
    docs = rows(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.collect()
        docs = out if stage is not corpus_pipeline.STAGES[-1][1] else docs
        assert docs.columns == rows(spark).columns
