import itertools

import numpy as np

from pageloom.llm import lattice

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def plain(rows, least=0.9):
    good = {k: np.array(v, np.float64) for k, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links, label = {k: set() for k, _ in rows}, {k: k for k, _ in rows}
    for a, b in itertools.combinations(good, 2):
        if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= least:
            links[a].add(b)
            links[b].add(a)
    for _ in rows:
        for a in links:
            for b in links[a]:
                label[a] = label[b] = min(label[a], label[b])
    return links, label


def vectors(n=260, d=24, seed=1):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=d) for _ in range(n // 2)]
    while len(rows) < n:  # copies at every distance up to the threshold
        x = rows[rng.integers(len(rows))]
        x = x / np.linalg.norm(x)
        z = rng.normal(size=d)
        z -= (z @ x) * x
        c = rng.choice([1.0, 0.99, 0.95, 0.91])
        rows.append((c * x + np.sqrt(1 - c * c) * z / np.linalg.norm(z)) * rng.uniform(0.1, 9))
    return [(k, [float(np.float32(v)) for v in x]) for k, x in enumerate(rows)]


def run(spark, rows, **more):
    return {r.vec_id: r for r in lattice.similar_vectors(spark.createDataFrame([(k, v, 0, "clash") for k, v in rows], SCHEMA), **more).collect()}


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)) * 1.5
    near = np.array(list(itertools.product((-1, 0, 1), repeat=8)), float)
    for row, got in zip(x[:60], lattice.decoded(x[:60]), strict=True):
        points = []
        for shift in (0.0, 0.5):
            around = np.rint(row - shift) + near
            points.append(around[around.sum(1) % 2 == 0] + shift)
        points = np.concatenate(points)
        assert ((row - got) ** 2).sum() <= ((row - points) ** 2).sum(1).min() + 1e-9
    assert len(lattice.roots()) == 240 and np.allclose((lattice.roots() ** 2).sum(1), 2)
    assert (lattice.decoded(lattice.roots()) == lattice.roots()).all()


def test_recall_and_no_false_links(spark):
    rows = vectors()
    links, label = plain(rows)
    got = run(spark, rows)
    wanted = sum(map(len, links.values()))
    assert all(got[k].n_links <= len(links[k]) for k in links)
    assert sum(r.n_links for r in got.values()) >= 0.95 * wanted > 0
    assert all(label[k] <= got[k].component_id <= k and got[k].kept == (got[k].component_id == k) for k in got)


def test_tiles_change_nothing_and_each_link_counts_once(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    rows = [(k, [float(np.float32(v)) for v in centre + rng.normal(size=16) * 0.05]) for k in range(120)]
    links, _ = plain(rows)
    for tile in (7, 50, 4096):
        got = run(spark, rows, tile=tile)
        assert {k: r.n_links for k, r in got.items()} == {k: len(v) for k, v in links.items()}
        assert {r.component_id for r in got.values()} == {0}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [nan, 1.0]),
            (9, [inf, 1.0]), (10, [1.0]), (11, [1e-30, 0.0]), (None, [0.0, 1.0]), (12, [0.0, 3e38])]
    out = lattice.similar_vectors(spark.createDataFrame([(k, v, 0, "clash") for k, v in rows], SCHEMA)).collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    assert len(out) == len(rows) and got[1] == got[2] == got[3] == got[11] == (4, 1)
    assert all(got[k] == (0, k) for k in (4, 5, 6, 7, 8, 9, 10))
    assert got[None] == (1, 12) and got[12] == (1, 12)
    assert lattice.similar_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    double = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0000001])], "vec_id long, embedding array<double>")
    assert [r.n_links for r in lattice.similar_vectors(double).collect()] == [1, 1]
