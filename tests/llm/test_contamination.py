import random

from pageloom.llm import contamination
from tests.llm.odd import no_documents, odd_documents

ITEMS = "item_id long, text string"


def plain(docs, items, width=5, threshold=0.8):
    out = set()
    for d, text in docs:
        words = (text or "").lower().split()
        for i, wanted in items:
            own = (wanted or "").lower().split()
            k = min(width, len(own))
            if k:
                a = {tuple(own[j:j + k]) for j in range(len(own) - k + 1)}
                b = {tuple(words[j:j + k]) for j in range(len(words) - k + 1)}
                if len(a & b) >= threshold * len(a):
                    out.add((d, i, len(a), len(a & b)))
    return out


def data(seed=2):
    dice = random.Random(seed)
    word = lambda: f"w{dice.randrange(60)}"
    items = [(k, " ".join(word() for _ in range(dice.choice([1, 2, 4, 5, 6, 12, 40, 90])))) for k in range(25)]
    docs = []
    for k in range(120):
        text = [word() for _ in range(dice.randint(0, 80))]
        if dice.random() < 0.6:  # a passage, cut or changed at some places
            part = dice.choice(items)[1].split()
            part = part[dice.randint(0, len(part) // 6):]
            if part and dice.random() < 0.4:
                part[dice.randrange(len(part))] = "Changed"
            at = dice.randint(0, len(text))
            text[at:at] = part
        docs.append((k, dice.choice([" ", "\n", "  "]).join(text).upper() if k % 3 else " ".join(text)))
    return docs, items


def test_against_brute_force(spark):
    docs, items = data()
    found = contamination.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS))
    assert {tuple(r)[:4] for r in found.collect()} == plain(docs, items)


def test_blocks_of_items_give_the_same(spark):
    docs, items = data(5)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    assert sorted(contamination.contained_items(d, i, block_chars=300).collect()) == sorted(contamination.contained_items(d, i).collect())
    dirty = {r[0] for r in plain(docs, items)}
    for size in (300, 4_000_000):
        assert {r.doc_id for r in contamination.clean_documents(d, i, block_chars=size).collect()} == {k for k, _ in docs} - dirty


def test_batches_and_pieces_do_not_matter(spark, monkeypatch):
    docs, items = data(8)
    ready = contamination.Items(items, 5, 0.8)
    import pyarrow as pa

    texts = pa.array([t for _, t in docs])
    want = list(ready.found(texts))
    monkeypatch.setattr(contamination, "pieces", lambda o: ((k, k + 1) for k in range(len(o) - 1)))
    assert sorted(ready.found(texts)) == sorted(want)


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "two three four five six"), (2, None), (3, " "), (4, "word1 word2 word3 word4 word5 word6 word7"), (4, "five six")], ITEMS)
    found = contamination.contained_items(odd_documents(spark), items).collect()
    assert sorted((r.doc_id, r.item_id, r.containment) for r in found) == [(4, 4, 1.0), (5, 4, 1.0), (6, 1, 1.0), (6, 1, 1.0), (6, 4, 1.0), (6, 4, 1.0)]
    clean = contamination.clean_documents(odd_documents(spark), items)
    assert clean.columns == odd_documents(spark).columns and clean.count() == 7
    assert contamination.contained_items(no_documents(spark), items).count() == 0
    assert contamination.contained_items(odd_documents(spark), items.limit(0)).count() == 0
    assert contamination.clean_documents(odd_documents(spark), items.limit(0)).count() == 11
