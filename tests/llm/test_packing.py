import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pageloom.llm import packing
from pageloom.llm.tokens import PLAIN, Identifiers
from tests.llm.odd import COLUMNS, no_documents, odd_documents


@pytest.fixture(scope="module")
def coder():
    return Identifiers()


def test_identifiers_are_those_of_the_tokenizer(coder):
    dice = random.Random(4)
    plain = list("  \t\n\r\xa0aAbzéßœαЖ日あ''sdmtllvereLL0129²½.,-_!?;:\"()[]{}<>|\\/`~^¡©€…🌀")
    beyond = [*plain, "\x1c", "\x85", " ", "́", "ﬁ", "𝐀", "٣", "‍"]
    for alphabet in (plain, beyond):
        for _ in range(3000):
            text = "".join(dice.choices(alphabet, k=dice.randrange(30)))
            assert alphabet is beyond or PLAIN.fullmatch(text)
            assert coder.packed(text) == coder.encoded(text), text
    for text in ("", "<|endoftext|>", "a <|endoftext|> b", " " * 100_000 + "a", "x" * 50_000, "\n" * 50_000 + "y" * 200 + "ß" * 200):
        assert coder.packed(text) == coder.encoded(text)


def whole(plan, counts):
    held = Counter()
    for pattern, times in plan:
        assert times > 0 and sum(pattern) <= len(counts) - 1
        for length in pattern:
            held[length] += times
    assert held == Counter({k: int(n) for k, n in enumerate(counts) if n})
    return sum(n for _, n in plan)


def test_pricing_against_all_configurations():
    rng = np.random.default_rng(3)
    for _ in range(20):
        capacity = int(rng.integers(3, 14))
        worth = np.concatenate(([0.0], np.where(rng.random(capacity) < 0.6, rng.random(capacity), 0.0)))
        best, take = packing.priced(worth)
        most = [0.0] * (capacity + 1)
        for c in range(1, capacity + 1):
            most[c] = max([most[c - 1], *[most[c - k] + worth[k] for k in range(1, c + 1)]])
        assert np.allclose(best, most)
        lengths = np.arange(1, capacity + 1)
        for length, row in zip(lengths, packing.filled(lengths, take), strict=True):
            assert row.sum() <= capacity and length in row
            assert np.isclose(worth[row].sum(), worth[length] + most[capacity - length])


def test_plans_are_whole_and_need_few_sequences():
    rng = np.random.default_rng(7)
    even = np.bincount(rng.integers(1, 201, 4000), minlength=201)
    halves = np.bincount(rng.integers(60, 120, 3000), minlength=201)
    thirds = np.zeros(201, np.int64)
    thirds[[58, 60, 62, 64, 66, 70, 72, 76]] = rng.integers(200, 900, 8)
    one = np.zeros(201, np.int64)
    one[[200, 7]] = 3, 1
    for counts in (even, halves, thirds, one, np.zeros(201, np.int64)):
        used = whole(packing.planned(counts), counts)
        fit = whole(packing.best_fit([], counts), counts)
        assert -(-int(counts @ np.arange(201)) // 200) <= used <= fit
    assert whole(packing.planned(thirds), thirds) < 0.97 * whole(packing.best_fit([], thirds), thirds)
    bins, left = packing.rounded(packing.fractional(thirds), thirds, 1.0)
    assert sum(n for _, n in bins) > 0.6 * whole(packing.planned(thirds), thirds) and (left >= 0).all()


def test_best_fit_is_that_of_single_pieces():
    dice = random.Random(1)
    for _ in range(60):
        capacity = dice.randrange(5, 40)
        lengths = sorted((dice.randrange(1, capacity + 1) for _ in range(dice.randrange(1, 60))), reverse=True)
        free = []
        for length in lengths:
            fitting = [k for k, f in enumerate(free) if f >= length]
            if fitting:
                k = min(fitting, key=lambda k: free[k])
                free[k] -= length
            else:
                free.append(capacity - length)
        counts = np.bincount(lengths, minlength=capacity + 1)
        assert whole(packing.best_fit([], counts), counts) == len(free)


def rebuilt(rows, texts, coder, capacity):
    """Checks pieces against their documents and sequences; the number of sequences comes out."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert 0 < r.length <= capacity and len(r.ids) == 4 * r.length and r.ids_crc32 == zlib.crc32(r.ids)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for doc_id, all_texts in texts.items():
        want = sorted(coder.encoded(t or "") + bytes(4) for t in all_texts)
        if len(want) == 1:
            pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
            assert [r.piece for r in pieces] == list(range(len(pieces)))
            assert b"".join(r.ids for r in pieces) == want[0]
            assert all(r.start == sum(p.length for p in pieces[: r.piece]) for r in pieces) and all(r.length == capacity for r in pieces[1:])
        else:
            assert sorted(b for r in by_doc[doc_id] for b in r.ids) == sorted(b for w in want for b in w)
    assert set(by_doc) == set(texts)
    return len(by_sequence)


def documents(df):
    out = {}
    for r in df.select("doc_id", "text").collect():
        out.setdefault(r.doc_id, []).append(r.text)
    return out


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_are_a_round_trip(spark, coder, capacity):
    dice = random.Random(capacity)
    rows = [(k, " ".join(dice.choices(["word", "été", "x1", "\n", "longer", "😀"], k=dice.choice([0, 1, 5, 9, 40, 3000]))), "en", "s", 0) for k in range(150)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    out = packing.packed(docs, capacity, with_ids=True).collect()
    used = rebuilt(out, documents(docs), coder, capacity)
    counts = np.bincount([r.length for r in out], minlength=capacity + 1)
    assert used <= whole(packing.best_fit([], counts), counts)


def test_odd_rows(spark, coder):
    docs = odd_documents(spark, [(50, " " * 300_000 + "a", "en", "a", 300_001)])
    rebuilt(packing.packed(docs, 64, with_ids=True).collect(), documents(docs), coder, 64)
    assert packing.packed(no_documents(spark)).count() == 0
    assert all(r.ids is None for r in packing.packed(docs, 64).collect())
