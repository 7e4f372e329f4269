import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import multiindex

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def plain(rows, positives=5, negatives=10, every=100):
    """All pairs, in whole numbers of any size."""
    good = [(n, k, (y + 1) % 10 if k is not None and k % 7 == 0 else y, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for n, (k, v, y) in enumerate(rows)
            if y is not None and v is not None and None not in v and np.isfinite(v).all()]
    first = lambda found, n: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:n]
    out = []
    for n, a, y, u in good:
        if a is None or a % every:
            continue
        scored = [(sum(x * z for x, z in zip(u, v, strict=True)), k, label) for m, k, label, v in good if m != n and len(v) == len(u)]
        for p, pid, _ in first([s for s in scored if s[2] == y], positives):
            found = first([s for s in scored if s[2] != y and 30 * p <= 100 * s[0] <= 90 * p], negatives)
            out += [(a, pid, rank, k, p, s) for rank, (s, k, _) in enumerate(found, 1)]
    return sorted(out, key=repr)


def got(spark, rows, **more):
    frame = spark.createDataFrame([(k, v, y, "clash") for k, v, y in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in multiindex.hard_negatives(frame, **more).collect()), key=repr)


def vectors(n, d, seed, spread=0.6):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, d))
    return [(k, [float(np.float32(x)) for x in middles[k % 6] + spread * rng.normal(size=d)], int(rng.integers(4))) for k in range(n)]


@pytest.mark.parametrize("settings", [{}, {"codes": 4, "first": 8, "growth": 2, "tile": 16, "block": 2}, {"codes": 1, "sample": 3}])
def test_against_all_pairs(spark, settings):
    rows = vectors(420, 7, 1)
    want = plain(rows, every=20 if settings else 100)
    anchors = F.col("vec_id") % 20 == 0 if settings else None
    assert got(spark, rows, anchors=anchors, **settings) == want and len(want) > 100


def test_copies_and_ties(spark):
    """Hundreds of equal vectors: the smallest ids come first, and no more copies than can count are read."""
    rows = [(k, [1.0, 2.0, 0.5], k % 2) for k in range(500)] + [(1000 + k, [0.5, 1.0, 0.25 + k / 512], 1) for k in range(60)]
    assert got(spark, rows, tile=32, block=3) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [0.5, 0.5], 2), (2, [0.5, 0.5], 2), (3, None, 1), (4, [1.0, 1.0], None), (5, [nan, 1.0], 1), (6, [1.0, None], 2),
            (8, [inf, 1.0], 2), (9, [1.0, 2.0, 3.0], 1), (100, [1.0, 2.0, 2.9], 1), (10, [0.5, 1.0, 1.0], 2), (None, [0.75, 0.25], 2), (None, [0.9, 0.5], 1), (200, [], 1), (11, [], 1), (12, [], 2),
            (300, [-1.0, 0.0], 3), (13, [1.0, 0.0], 3), (400, [3e38, 3e38], 5), (14, [3e38, 2e38], 5), (15, [1e38, 2e38], 6)]
    want = [(a, p, r, n, min(s, 2**63 - 1), min(t, 2**63 - 1)) for a, p, r, n, s, t in plain(rows)]
    out = got(spark, rows)
    assert [r for r in out if r[0] != 400] == [r for r in want if r[0] != 400] and {r[0] for r in out} >= {100, 200}
    assert got(spark, rows[3:6]) == [] and multiindex.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sequence_gives_cells_in_order_of_their_sums():
    rng = np.random.default_rng(4)
    for _ in range(30):
        u, v = rng.normal(size=rng.integers(1, 9)), rng.normal(size=rng.integers(1, 9))
        seen = list(multiindex.multi_sequence(u, v))
        assert sorted((i, j) for _, i, j in seen) == list(itertools.product(range(len(u)), range(len(v))))
        assert all(s == u[i] + v[j] for s, i, j in seen) and [s for s, _, _ in seen] == sorted((s for s, _, _ in seen), reverse=True)


def test_bounds_hold_and_cells_are_skipped():
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(9, 8)) * 400
    rows = np.floor(np.concatenate([m + rng.normal(size=(60, 8)) * 20 for m in middles]))
    halves = [multiindex.codebook(h, 5) for h in (rows[:, :4], rows[:, 4:])]
    (c1, d1), (c2, d2) = (multiindex.nearest(h, c) for h, c in zip((rows[:, :4], rows[:, 4:]), halves, strict=True))
    r1, r2 = (np.array([d[c == k].max(initial=0) for k in range(len(b))]) for c, d, b in ((c1, d1, halves[0]), (c2, d2, halves[1])))
    n = np.zeros((len(r1), len(r2)), np.int64)
    np.add.at(n, (c1, c2), 1)
    for q in rows[::50]:
        (low1, up1), (low2, up2) = multiindex.half_bounds(q[:4], halves[0], r1), multiindex.half_bounds(q[4:], halves[1], r2)
        s = rows @ q
        assert (s <= up1[c1] + up2[c2]).all() and (s >= low1[c1] + low2[c2]).all()
        tenth = int(np.sort(s)[-10])
        found, _ = multiindex.visits(q, (halves[0], r1, halves[1], r2, n), 0, [tenth], [2**62], 10**9)
        cells = {(i, j) for i, codes in found.items() for j in codes}
        assert {(int(a), int(b)) for a, b, x in zip(c1, c2, s, strict=True) if x >= tenth} <= cells and len(cells) < (n > 0).sum()


def test_products_are_exact():
    a, b = np.array([[2.0**30, 1.0, -3.0]]), np.array([[2.0**30, 2.0, 5.0], [-(2.0**31), 1.0, 1.0]])
    assert multiindex.inner_products(a, b).tolist() == [[2**60 + 2 - 15, -(2**61) + 1 - 3]]
    assert multiindex.inner_products(np.array([[1e30]]), np.array([[1e30], [-1e30]])).tolist() == [[2**63 - 1, -(2**63)]]
