"""Nearest neighbours: recall against brute force, the graph, repeated ids."""

from __future__ import annotations

import numpy as np

from loregrid.llm import ann


def test_recall_at_fifty_thousand_vectors(spark):
    """390 lists, of which a query searches about a hundred."""
    n = 50_000
    x = np.random.default_rng(8).normal(size=(n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    import pyarrow as pa

    table = pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 64), pa.array(x.ravel()))})
    df = spark.createDataFrame(table)
    got = ann.neighbours(df, df.where("vec_id % 500 = 0")).toPandas()
    hit = 0
    for q in range(0, n, 500):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argpartition(d, 10)[:10]) & set(got[got.query_id == q].vec_id))
    assert len(got) == 1000 and hit / 1000 >= 0.9


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(5)
    sample = rng.normal(size=(6000, 16))
    index = ann.Index.fit(sample, 400)
    x = rng.normal(size=(300, 16))
    near, d = index.nearest(x, 48)
    want, exact = index.ranked(x)
    assert near.shape == (300, 48) and (np.diff(d, axis=1) >= 0).all()
    assert all(len(set(row)) == 48 for row in near)
    assert np.mean(near[:, 0] == want[:, 0]) >= 0.97
    assert np.allclose(np.sort(np.linalg.norm(x[:, None] - index.centroids[near], axis=2), axis=1), d)


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(0, [0.0, 1.0]), (0, [0.0, 9.0]), (1, [0.0, 2.0]), (1, [0.0, 2.0]), (2, [5.0, 5.0]), (2, [0.0, 1.5]), (None, [0.0, 1.0]), (3, [0.0, 2.0]), (100, [1e8, 1e8]), (101, [1e8, 1e8 + 2.0]), (102, [1e8, 1e8 - 1.0])]
    df = spark.createDataFrame([(*r, "own", "own", "own") for r in rows], "vec_id long, embedding array<double>, key string, v string, query string")
    got: dict = {}
    for r in ann.neighbours(df, df.where("vec_id % 100 = 0"), k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got[0] == [(2, 0.5), (1, 1.0), (3, 1.0)]
    assert got[100][:2] == [(102, 1.0), (101, 2.0)]
    assert ann.neighbours(df.limit(0), df).count() == 0


def test_queries_of_another_length_ask_nothing(spark):
    rows = [(0, [1.0, 2.0, 3.0]), *[(k, [float(k), 1.0]) for k in range(1, 9)], (200, [4.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.neighbours(df, df.where("vec_id % 100 = 0"), k=2).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(200, 4, 0.0), (200, 3, 1.0)]
    assert ann.neighbours(df, df.where("vec_id = 0")).count() == 0
