import hashlib

import pytest

from pageloom.llm import mixture
from tests.llm.odd import COLUMNS, no_documents, odd_documents


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, capped again and again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not above:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in above}


def rows(n=400):
    sources = ["s9", "s1", "é", "Z", None, "tiny"]
    out = []
    for k in range(n):
        source = sources[0 if k % 3 == 0 else k % 5]
        out.append((k, " ".join(["w"] * (1 + int(hashlib.md5(str(k).encode()).hexdigest(), 16) % 60)), "en", source, 0))
    return [*out, (n, "a b", "en", "tiny", 0)]


def test_targets_and_amounts(spark):
    data = rows()
    got = {r.doc_id: r for r in mixture.mixed(spark.createDataFrame(data, COLUMNS)).collect()}
    sizes, taken = {}, {}
    for k, text, _, source, _ in data:
        sizes[source] = sizes.get(source, 0) + len(text.split())
        taken[source] = taken.get(source, 0) + got[k].taken
    targets = plain_targets(sizes)
    for k, text, _, source, _ in data:
        assert got[k].size == len(text.split()) and got[k].source_size == sizes[source]
        assert got[k].target == pytest.approx(targets[source])
        assert got[k].taken % got[k].size == 0 and got[k].taken <= 3 * got[k].size
    for source in sizes:
        assert abs(taken[source] - targets[source]) <= 30  # half the longest document


def plain_copies(sizes, target, most=3):
    """Expected copies by document: in proportion to the bits of its size, those beyond ``most`` held there, until none is above."""
    amount = {k: n.bit_length() for k, n in sizes.items() if n}
    fixed = {}
    while True:
        free = [k for k in amount if k not in fixed]
        level = (target - most * sum(sizes[k] for k in fixed)) / sum(amount[k] * sizes[k] for k in free) if free else 0
        above = [k for k in free if level * amount[k] > most + 1e-12]
        if not above:
            return fixed | {k: level * amount[k] for k in free}
        fixed |= dict.fromkeys(above, most)


def test_order_sample_against_brute_force(spark):
    data = rows(250)
    got = {r.doc_id: r for r in mixture.mixed(spark.createDataFrame(data, COLUMNS)).collect()}
    shares = set()
    for source in {r[3] for r in data}:
        own = {k: len(t.split()) for k, t, _, s, _ in data if s == source}
        texts = {r[0]: r[1] for r in data}
        target = got[next(iter(own))].target
        copies = plain_copies(own, target)
        certain = {k: int(c + 1e-9) for k, c in copies.items()}
        rank = {}
        for k in own:
            share = copies[k] - certain[k]
            if share > 1e-9:
                u = (int(hashlib.md5(f"mix|{k}|{hashlib.md5(texts[k].encode()).hexdigest()}|1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                rank[k] = u / (1 - u) / (share / (1 - share))
                shares.add(round(share, 6))
        lacks, here, picked = target - sum(certain[k] * own[k] for k in own), 0, set()
        for k in sorted(rank, key=lambda k: (rank[k], k)):
            if here + own[k] / 2 <= lacks + 1e-6:
                picked.add(k)
            here += own[k]
        assert {k: got[k].copies for k in own} == {k: certain[k] + (k in picked) for k in own}
    assert len(shares) > 10  # inclusion probabilities differ within sources


def test_rows_without_an_id_and_alike_rows_are_drawn_one_by_one(spark):
    words = " ".join(["w"] * 10)
    for ids in ([None] * 1000, [7] * 1000, list(range(500)) + [None] * 500):
        data = [(k, words, "en", "big", 0) for k in ids] + [(5000 + k, words, "en", "other", 0) for k in range(400)]
        docs = spark.createDataFrame(data, COLUMNS).repartition(7)
        out = mixture.mixed(docs).collect()
        taken = {s: sum(r.taken for r in out if r.source_size == s) for s in (10_000, 4000)}
        target = {r.source_size: r.target for r in out}
        assert all(abs(taken[s] - target[s]) <= 5 for s in taken)
        again = mixture.mixed(docs.repartition(3)).collect()
        assert sorted((r.doc_id or -1, r.taken) for r in out) == sorted((r.doc_id or -1, r.taken) for r in again)


def test_ranks_follow_inclusion_odds(spark):
    """Rows of a larger inclusion probability get smaller ranks from the same random number."""
    from pyspark.sql import functions as F

    r = spark.range(1000).select(mixture.odds_rank(mixture.uniform(F.col("id")), F.lit(0.2)).alias("a"), mixture.odds_rank(
        mixture.uniform(F.col("id")), F.lit(0.6)).alias("b"), mixture.uniform(F.col("id")).alias("u")).toPandas()
    assert (r.a > r.b).all() and 0.47 < r.u.mean() < 0.53 and 0 < r.u.min() and r.u.max() < 1
    assert 0.17 < (r.a < 1).mean() < 0.23 and 0.55 < (r.b < 1).mean() < 0.65  # rank below one has the inclusion probability


def test_bins_do_not_change_the_sample(spark, monkeypatch):
    d = spark.createDataFrame(rows(150), COLUMNS)
    want = sorted(mixture.mixed(d).collect())
    monkeypatch.setattr(mixture, "BINS", 3)
    assert sorted(mixture.mixed(d).collect()) == want


def test_odd_rows(spark):
    got = mixture.mixed(odd_documents(spark)).collect()
    assert len(got) == 11 and all(r.taken == 0 for r in got if r.size == 0)
    assert {r.target for r in got if r.doc_id in (4, 5)} == {r.target for r in got if r.doc_id in (4, 5)}
    assert mixture.mixed(no_documents(spark)).count() == 0
    blank = spark.createDataFrame([(1, "", "", "a", 0), (2, None, "", None, 0)], COLUMNS)
    assert sorted((r.doc_id, r.target, r.taken) for r in mixture.mixed(blank).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
    assert mixture.mixed_documents(odd_documents(spark)).select("document.*").columns == odd_documents(spark).columns
    assert mixture.mixed_documents(no_documents(spark)).count() == 0
