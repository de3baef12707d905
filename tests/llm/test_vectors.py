import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import vectors


def _data(seed=0, n=600, near=120):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 64))
    pick = rng.integers(0, n - near, near)
    x[n - near :] = x[pick] + rng.standard_normal((near, 64)) * rng.uniform(0.02, 0.3, (near, 1))
    return x * rng.uniform(0.5, 2, (n, 1))


def _brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -2)
    top = np.argsort(-c, axis=1, kind="stable")[:, :k]
    return c, top


def _frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r], 0.5) for i, r in enumerate(x)], "id bigint, embedding array<float>, cosine double")


def test_chi_square():
    assert abs(vectors.chi_square_quantile(0.95, 1) - 3.8415) < 1e-3
    assert abs(vectors.chi_square_quantile(0.99, 12) - 26.217) < 1e-2
    assert abs(vectors.chi_square_quantile(0.999, 24) - 51.179) < 1e-2


def test_stopping_saves_work():
    """On clustered data the test ends searches early and keeps the recall."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 64)) * 3
    x = (centres[rng.integers(0, 60, 6000)] + rng.standard_normal((6000, 64)) * 0.15).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(6000)
    q, r, _, verified = vectors.search_block(u[:300], ids[:300], u, ids, 10, leaf_rows=128)
    _, top = _brute(x, 10)
    hits = sum(b in set(top[a]) for a, b in zip(q.tolist(), r.tolist()))
    assert hits >= 0.95 * 3000 and verified < 0.5 * 300 * 6000


def test_stopping_without_clusters():
    """Even where no vector has near neighbours, the test leaves out most pairs and keeps the recall."""
    rng = np.random.default_rng(6)
    u = rng.standard_normal((20_000, 64)).astype(np.float32)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ids = np.arange(len(u))
    q, r, c, verified = vectors.search_block(u[:100], ids[:100], u, ids, 10)
    cosine = u[:100] @ u.T
    cosine[np.arange(100), np.arange(100)] = -2
    top = np.argsort(-cosine, axis=1)[:, :10]
    assert sum(b in set(top[a]) for a, b in zip(q.tolist(), r.tolist())) >= 0.95 * 1000
    assert np.abs(c - cosine[q, r]).max() < 1e-5 and verified < 0.4 * 100 * 20_000


def test_verify_in_order_stops_each_query_by_itself():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    x[1:60] = x[0] + rng.standard_normal((59, 64)) * 1e-3
    near = vectors.projected_squares((x @ vectors.projection(64, 24, 1)).astype(np.float32), (x @ vectors.projection(64, 24, 1)).astype(np.float32))
    np.fill_diagonal(near, np.inf)
    seen = []

    def distance(a, b):
        seen.append(len(a))
        return np.linalg.norm(x[a] - x[b], axis=1)

    a, b, d, best = vectors.verify_in_order(near, distance, np.full((400, 5), np.inf), vectors.chi_square_quantile(0.99, 24))
    assert sum(seen) == len(a) == len(set(zip(a.tolist(), b.tolist()))) and (a != b).all()
    whole = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(whole, np.inf)
    assert np.isclose(best.max(axis=1)[:60], np.sort(whole[:60], axis=1)[:, 4]).mean() > 0.9
    assert b[a < 60].max() < 60  # rows of the cluster never look outside it


def test_trees_follow_the_rows():
    assert vectors.trees_for(8_000, 0.9) == 1 and vectors.trees_for(30_000, 0.9) == 8
    numbers = [vectors.trees_for(10**p, 0.9) for p in range(4, 10)]
    assert numbers == sorted(numbers) and numbers[-1] > 30
    assert vectors.trees_for(10**6, 1.0) == 8 and vectors.trees_for(10**6, 0.99) < vectors.trees_for(10**6, 0.5)
    for wrong in (0.0, -1.0, 1.1):
        with pytest.raises(ValueError):
            vectors.trees_for(10**6, wrong)
    splits = np.ceil(np.log2(10**8 / vectors.LEAF_ROWS))
    assert (1 - (1 - np.arccos(0.9) / np.pi) ** splits) ** vectors.trees_for(10**8, 0.9) <= vectors.LOSS


def test_query_set_recall(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROW_BLOCK", 150)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 20)
    monkeypatch.setattr(vectors, "SMALL_BLOCK", 100)
    x = _data(1)
    _, top = _brute(x, 10)
    rows = vectors.neighbours_of_queries(_frame(spark, x), F.col("id") % 20 == 0).collect()
    assert len(rows) == 300 and {r.id for r in rows} == set(range(0, 600, 20))
    assert sum(r.neighbour in set(top[r.id]) for r in rows) >= 0.95 * 300


def test_least_similarity_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 200)
    monkeypatch.setattr(vectors, "LEAF_ROWS", 100)
    monkeypatch.setattr(vectors, "TREES_AT_ONCE", 3)
    x = _data(2)
    c, top = _brute(x, 10)
    want = {(i, int(j)) for i in range(len(x)) for j in top[i] if c[i, j] >= 0.9}
    got = {(r.id, r.neighbour) for r in vectors.similar_neighbours(_frame(spark, x), 0.9).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    pairs = {(r.id_a, r.id_b) for r in vectors.mutual_pairs(vectors.similar_neighbours(_frame(spark, x), 0.9)).collect()}
    assert pairs == {(a, b) for a, b in got if a < b and (b, a) in got}


def test_tight_cluster_equals_brute_force(spark):
    """More different vectors than any list holds, closer together than half precision tells apart."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((900, 64))
    x[:700] = x[0] / np.linalg.norm(x[0]) + rng.standard_normal((700, 64)) * 0.0003
    x = x.astype(np.float32).astype(np.float64)
    c, top = _brute(x, 10)
    assert c[:700, :700][~np.eye(700, dtype=bool)].min() > 0.99998
    want = {(i, int(j)) for i in range(len(x)) for j in top[i] if c[i, j] >= 0.9}
    near = vectors.similar_neighbours(_frame(spark, x), 0.9)
    assert {(r.id, r.neighbour) for r in near.collect()} == want
    assert {(r.id_a, r.id_b) for r in vectors.mutual_pairs(near).collect()} == {(a, b) for a, b in want if a < b and (b, a) in want}


def test_dirt_ties_and_copies(spark):
    one = [1.0] + [0.0] * 63
    two = [1.0, 0.01] + [0.0] * 62
    bad = [None, [1.0] * 32, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, []]
    rows = [(i, one, None) for i in range(14)] + [(14, two, None), (14, two, None), (15, [2 * v for v in two], None)] + [(20 + i, v, None) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>, rank int")
    got = {}
    for r in vectors.similar_neighbours(df, 0.9).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert set(got) == set(range(16))
    assert got[3] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10] and got[0] == list(range(1, 11))
    assert got[14] == [15, 0, 1, 2, 3, 4, 5, 6, 7, 8] and got[15][0] == 14
    assert vectors.similar_neighbours(df.limit(0), 0.9).count() == 0
    asked = {}
    for r in vectors.neighbours_of_queries(df, F.col("id") == 3).orderBy("rank").collect():
        asked.setdefault(r.id, []).append(r.neighbour)
    assert asked == {3: got[3]}
