import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from pageloom.llm import simhash
from tests.llm.odd import COLUMNS, odd_documents, no_documents


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return 0
    runs = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks, radius):
    """marks: {id: fingerprint}; smallest id reachable, by brute force."""
    ids = sorted(marks)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if bin(marks[i] ^ marks[j]).count("1") <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def texts(n, seed=1):
    dice = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for k in range(n):
        if out and dice.random() < 0.4:
            words = dice.choice(out).split()
            for _ in range(dice.randint(0, 2)):
                words[dice.randrange(len(words))] = dice.choice(vocabulary)
            out.append(" ".join(words))
        else:
            out.append(" ".join(dice.choices(vocabulary, k=dice.randint(5, 200))))
    return out


def test_against_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(texts(300))]
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    marks = {k: plain_fingerprint(t) for k, t in rows}
    assert {k: v[0] for k, v in got.items()} == marks
    assert {k: v[1] for k, v in got.items()} == plain_components(marks, 2)


@pytest.mark.parametrize("tile", [2, 16, 4096])
def test_links_connect_all_within_the_radius_whatever_the_tile(spark, tile):
    dice = random.Random(3)
    centre = dice.getrandbits(64)
    marks = {centre}
    for _ in range(150):  # a crowd that shares long runs of bits, chains included
        x = dice.choice(sorted(marks))
        for _ in range(dice.randint(1, 4)):
            x ^= 1 << dice.randrange(64)
        marks.add(x)
    marks = sorted(marks)
    signed = [(int(np.uint64(m).astype(np.int64)),) for m in marks]
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(spark.createDataFrame(signed, "fp long"), tile=tile).collect()]
    label = {m: m for m in marks}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        label[max(root(a), root(b))] = min(root(a), root(b))
    want = plain_components({m: m for m in marks}, 2)
    assert {m: root(m) for m in marks} == want


def test_odd_rows(spark):
    rows = simhash.near_duplicates(odd_documents(spark)).collect()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == 11 and by_id[1].fp == by_id[2].fp == by_id[3].fp == 0
    assert by_id[1].component_id == by_id[2].component_id == by_id[3].component_id == 1
    assert by_id[4].component_id == by_id[5].component_id == 4
    kept = simhash.one_of_each(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 6, 7, 8, None])


def test_different_texts_under_one_id_both_stay(spark):
    rows = [(1, "alpha beta gamma delta epsilon", "", "", 1), (1, "completely other words stand in here", "", "", 1), (2, "alpha beta gamma delta epsilon", "", "", 1),
            (None, "third text of no name at all", "", "", 1), (None, "third text of no name at all", "", "", 1)]
    for _ in range(2):
        kept = simhash.one_of_each(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()
        assert sorted((r.doc_id or 0, r.text[:5]) for r in kept) == [(0, "third"), (1, "alpha"), (1, "compl")]
        rows = rows[::-1]


def test_empty_table_and_null_ids(spark):
    assert simhash.near_duplicates(no_documents(spark)).count() == 0
    assert simhash.one_of_each(no_documents(spark)).count() == 0
    only = simhash.near_duplicates(spark.createDataFrame([(None, "a b c", "", "", 1)], COLUMNS)).collect()
    assert only[0].component_id is None


def test_long_texts_are_hashed_in_steps(monkeypatch):
    text = texts(1, 9)[0] * 5
    want = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 7)
    assert simhash.fingerprint(text.encode()) == want == plain_fingerprint(text)
