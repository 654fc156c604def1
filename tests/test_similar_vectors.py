"""Cosine pairs as products of blocks, against brute force."""

import numpy as np

from tarnmill.operators import metrics as M


def made(spark, n=2_300, dims=16):
    r = np.random.default_rng(9)
    v = r.normal(size=(n, dims)).astype(np.float32).astype(float)
    v[1] = v[n - 1] * 3
    v[7] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(n, None), (n + 1, [None] * dims)]
    return v, spark.createDataFrame(rows, "id long, v array<double>").repartition(4)


def brute(v, least):
    u = np.delete(v, 7, 0)
    ids = np.delete(np.arange(len(v)), 7)
    u = u / np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    i, j = np.nonzero(np.triu(s >= least, 1))
    return sorted(zip(ids[i].tolist(), ids[j].tolist(), s[i, j].tolist(), strict=True), key=lambda x: (-x[2], x[0], x[1]))


def test_pairs_without_a_join_of_rows(spark):
    v, df = made(spark)
    want = brute(v, 0.7)
    assert len(want) > 150 and want[0] == (1, len(v) - 1, 1.0)
    every, top = M.similar_pairs(df, 0.7, None), M.similar_pairs(df, 0.7, 100)
    assert "Join" not in every._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, every.collect())) == sorted(want)
    assert [tuple(x) for x in top.collect()] == want[:100]


def test_groups_read_their_pairs_once(spark, monkeypatch):
    kept, keep = [], M.stored
    monkeypatch.setattr(M, "stored", lambda df, name="step": kept.append(name) or keep(df, name))
    pairs = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.7), (8, 9, 0.9)], "a long, b long, similarity double")
    assert [tuple(x) for x in M.similar_groups(pairs).collect()] == [(1, 3, 0.4), (8, 2, 0.9)]
    assert kept == ["similar"]
