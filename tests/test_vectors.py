import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.operators import vectors


def test_vector_search(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 1.0]), (3, "b", [0.0, 2.0]), (4, "a", [0.0, 0.0]), (5, "a", [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, report_id string, embedding array<float>")
    out = vectors.match_documents(df, [2.0, 0.0], k=10, where={"report_id": "a"}).collect()
    assert [r.id for r in out] == [1, 2, 5, 4]
    assert out[0].similarity == pytest.approx(1.0) and out[3].similarity is None
    assert len(vectors.match_documents(df, [1.0, 0.0], k=2).collect()) == 2


def test_batch_search_equals_single_searches(spark):
    rnd = random.Random(2)
    rows = [(i, f"r{i % 3}", [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, report_id string, embedding array<double>")
    queries = [(q, f"r{q % 3}", [rnd.uniform(-1, 1) for _ in range(8)]) for q in range(6)]
    batch = vectors.match_batch(df, spark.createDataFrame(queries, "query_id long, report_id string, query array<double>"), k=5).collect()
    for q, report, vec in queries:
        single = [r.id for r in vectors.match_documents(df, vec, k=5, where={"report_id": report}).collect()]
        assert [r.id for r in sorted((b for b in batch if b.query_id == q), key=lambda b: b.pos)] == single


def clustered(n=900, groups=12, d=16, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, d))
    return [(i, f"r{i % 2}", [float(x) for x in middles[i % groups] + rng.normal(size=d) * 0.1]) for i in range(n)]


def exact(rows, query, k):
    q = np.array(query) / np.linalg.norm(query)
    scores = {i: float(np.array(v) @ q / np.linalg.norm(v)) for i, _, v in rows}
    return sorted(scores, key=lambda i: (-scores[i], i))[:k]


def test_cells_are_skipped_and_none_of_them_holds_a_hit(spark):
    rows = clustered()
    index = vectors.build_index(spark.createDataFrame(rows, "id long, report_id string, embedding array<double>"), cells=24)
    cell = {r.id: r.cell for r in index.rows.select("id", "cell").collect()}
    for query in (rows[5][2], rows[100][2], [float(x) for x in np.ones(16)]):
        out, read = vectors.search(index, query, 10)
        want = exact(rows, query, 10)
        assert [r.id for r in out.collect()] == want
        assert len(read) < len(index.counts) / 2 and {cell[i] for i in want} <= set(read)
        bound = vectors.most_similar(index.centres, index.radii, (np.array(query) / np.linalg.norm(query))[None, :])[0]
        q = np.array(query) / np.linalg.norm(query)
        assert all(np.array(v) @ q / np.linalg.norm(v) <= bound[cell[i]] for i, _, v in rows)


def test_a_search_reads_only_the_files_of_its_cells(spark):
    index = vectors.build_index(spark.createDataFrame(clustered(), "id long, report_id string, embedding array<double>"), cells=24)
    plan = index.rows.where(F.col("cell").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "PushedFilters: []" in plan


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "a", [1.0, 0.0]), (2, "a", None), (3, "a", []), (4, "a", [0.0, 0.0]), (5, "a", [nan, 1.0]), (6, "a", [1.0, None]), (7, "a", [1.0, 2.0, 3.0]),
            (8, "b", [1e300, 1e300]), (9, "a", [inf, 0.0]), (10, "a", [1e-200, 0.0])]
    df = spark.createDataFrame(rows, "id long, report_id string, embedding array<double>")
    out = vectors.match_documents(df, [2.0, 0.0], k=20).collect()
    assert [r.id for r in out] == [1, 10, 8, 2, 3, 4, 5, 6, 7, 9] and [r.similarity is None for r in out] == [False] * 3 + [True] * 7
    assert out[2].similarity == pytest.approx(0.5**0.5)
    assert {r.similarity for r in vectors.match_documents(df, [0.0, 0.0], k=4).collect()} == {None}
    queries = spark.createDataFrame([(100, "a", [3.0, 0.0]), (101, "a", [0.0, 0.0]), (102, "c", [1.0, 0.0])], "query_id long, report_id string, query array<double>")
    got = {(r.query_id, r.pos): r.id for r in vectors.match_batch(df, queries, 3).collect()}
    assert got == {(100, 1): 1, (100, 2): 10, (100, 3): 2, (101, 1): 1, (101, 2): 2, (101, 3): 3}
    empty = spark.createDataFrame([], "id long, report_id string, embedding array<double>")
    assert vectors.match_documents(empty, [1.0], 3).count() == 0


def test_batches_equal_exact_search_on_clusters(spark):
    rows = clustered(600)
    index = vectors.build_index(spark.createDataFrame(rows, "id long, report_id string, embedding array<double>"), cells=16)
    queries = [(1000 + q, f"r{q % 2}", rows[q * 7][2]) for q in range(20)]
    got = vectors.search_batch(index, spark.createDataFrame(queries, "query_id long, report_id string, query array<double>"), 5).collect()
    for q, report, query in queries:
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.pos)] == exact([r for r in rows if r[1] == report], query, 5)
