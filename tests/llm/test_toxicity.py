import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pageloom.llm import toxicity
from tests.llm.odd import no_documents, odd_documents

BAD = ["snarkle", "grumbot", "vexling", "dorkwad"]


def corpus(n, seed=1):
    dice = random.Random(seed)
    syllables = ["ta", "lo", "min", "er", "on", "the", "ka", "ri", "su", "ped"]
    word = lambda: "".join(dice.choices(syllables, k=dice.randint(1, 4)))
    rows = []
    for k in range(n):
        toxic = dice.random() < 0.25
        words = [dice.choice(BAD) if toxic and (dice.random() < 0.06 or j == 3) else word() for j in range(dice.randint(6, 300))]
        rows.append((k, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    return rows, {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}


def test_held_out_accuracy(scored):
    rows, got = scored
    assert len(got) == len(rows)
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _, _ in rows)
    out = [(got[k].predicted, y) for k, _, y in rows if got[k].held_out]
    assert np.mean([p == y for p, y in out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_only_labels_of_the_training_fold_matter(spark, scored):
    rows, got = scored
    flipped = [(k, 1 - y if got[k].held_out else y) for k, _, y in rows]
    again = toxicity.toxicity_scores(spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id long, text string, lang string"),
                                     spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert {r.doc_id: r.score for r in again.collect()} == {k: r.score for k, r in got.items()}


def test_windows_cover_whole_texts_and_batches_do_not_matter():
    rows = corpus(60, 4)
    model = toxicity.train([(t, y) for _, t, y in corpus(400, 2)], 100)
    texts = [t for _, t, _ in rows] + ["", None, "x" * 1000]
    whole = toxicity.scores(pa.array(texts), model)
    assert np.allclose(whole, [toxicity.scores(pa.array([t], pa.string()), model)[0] for t in texts])
    raw, offsets = toxicity.flat(toxicity.tidy(pa.array(texts)))
    begin, length, row = toxicity.windows(raw, offsets)
    for k, text in enumerate(texts):
        joined = b" ".join(raw[s:s + n].tobytes() for s, n, r in zip(begin, length, row, strict=True) if r == k)
        assert joined.split() == (text or "").encode().split()


def test_saving_is_that_of_single_compressions():
    model = toxicity.train([(t, y) for _, t, y in corpus(400, 2)], 100)
    raw, offsets = toxicity.flat(pa.array(["a snarkle of ka ri", "the loser on min"]))
    begin, length, _ = toxicity.windows(raw, offsets)
    tail = model.ordinary[-toxicity.TAIL:]
    each = [[len(toxicity.compressor(d).compress(raw[s:s + n].tobytes() + tail)) for d in (model.ordinary, model.toxic)] for s, n in zip(begin, length, strict=True)]
    assert toxicity.saved(raw, begin, length, model).tolist() == [a - b for a, b in each]


def test_without_labels_every_score_is_the_base_rate(spark):
    labels = spark.createDataFrame([(6, 1), (None, 1), (7, None), (7, 5)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(odd_documents(spark), labels).collect()
    assert len(got) == 11 and len({r.score for r in got}) == 1
    assert toxicity.toxicity_scores(no_documents(spark), labels).count() == 0
    kept = toxicity.without_toxic(odd_documents(spark), labels.limit(0), least=0.9)
    assert kept.columns == odd_documents(spark).columns and kept.count() == 11
    assert toxicity.without_toxic(odd_documents(spark), labels, least=0.0).count() == 0


def test_training_reads_one_text_of_an_id_and_a_budget_of_bytes(spark, monkeypatch):
    """Thousands of rows under one chosen id add nothing to the sample; a budget cuts it in the order of choice."""
    rows = corpus(300, 3)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    hot = next(k for k, _, y in rows if y and zlib.crc32(str(k).encode()) % 5)
    more = docs.unionByName(spark.createDataFrame([(hot, rows[hot][1])] * 2000, "doc_id long, text string"))
    one, same = toxicity.fitted(docs, labels), toxicity.fitted(more, labels)
    assert (one.ordinary, one.toxic, one.weights.tolist(), one.intercept) == (same.ordinary, same.toxic, same.weights.tolist(), same.intercept)
    monkeypatch.setattr(toxicity, "TRAINING_BYTES", 0)
    assert len(toxicity.fitted(docs, labels).weights) == 0
