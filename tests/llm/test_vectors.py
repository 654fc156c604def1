import numpy as np
import pytest

from tarnmill.llm.ann_search import chi_square, nearest
from tarnmill.llm.topk_search import exact_topk


def table(spark, n=700, dims=16):
    r = np.random.default_rng(10)
    centres = r.standard_normal((8, dims))
    x = centres[r.integers(0, 8, n)] + 0.6 * r.standard_normal((n, dims))
    x = x.astype(np.float32)
    x[40:60] = x[3]  # ties
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1050, []), (1100, [None] * dims), (1150, [float("nan")] * dims), (1200, [float("inf")] * dims), (1250, [0.0] * dims), (None, x[0].tolist()), (1300, [1.0, 2.0]), (7, x[7].tolist())]
    return data, spark.createDataFrame([(i, v, 0) for i, v in data + odd], "vec_id long, embedding array<float>, score int").repartition(3)


def brute(data, every, k, score, zero):
    ids = np.array([i for i, _ in data])
    x = np.array([v for _, v in data], dtype=np.float32).astype(np.float64)
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            s = score(x, q)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def listed(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


@pytest.mark.parametrize("shard", [64, 100000])
def test_exact(spark, shard):
    data, df = table(spark)
    scaled = lambda x, q: np.floor(256 * x) @ np.floor(256 * q)
    want = brute(data + [(7, data[7][1]), (1250, [0.0] * 16)], 50, 5, scaled, True)
    got = listed(exact_topk(df, 50, shard=shard, block=7))
    assert got.pop(1300, None) is None
    assert got == {q: [(i, int(s)) for i, s in v] for q, v in want.items()}
    assert exact_topk(df.limit(0), 50).count() == 0


@pytest.mark.parametrize("shard", [128, 100000])
def test_recall_and_scores(spark, shard):
    data, df = table(spark)
    data = data + [(7, data[7][1])]
    want = brute(data, 20, 20, lambda x, q: (x * q).sum(axis=1), False)
    got = listed(nearest(df, 20, shard=shard, block=9))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(len({i for i, _ in v}) for v in want.values())
    assert hit >= 0.95
    vectors = {i: np.array(v, dtype=np.float32).astype(float) for i, v in data}
    for q, found in got.items():
        assert all(abs(s - float(vectors[q] @ vectors[i])) < 1e-9 for i, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert nearest(df.limit(0), 20).count() == 0


def test_chi_square():
    assert abs(chi_square(15.507) - 0.95) < 1e-4
