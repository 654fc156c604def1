"""Approximate nearest neighbours by low-dimensional stable projections (Sun et al. 2014).

The largest inner product is made a nearest distance: each vector gets one more component,
sqrt(M^2 - |x|^2), with M the shard's largest norm, and a query gets 0. Gaussian directions, which are
2-stable, project to ``DIMS`` dimensions, where squared distances are true ones times a chi-square of
DIMS degrees; a kd-tree over the projections, built once a shard and written, gives leaves by distance.
Of a leaf's rows those are verified on the original vectors for which the chi-square test does not hold
yet: a row as near as the kth found would have shown up within a projected distance of ``limit`` times
the kth's with probability ``SURE``. Leaves all beyond that distance end a query's walk. The kth score
comes along from shard to shard. Every row is indexed; scores are the inner products themselves, summed
row by row so that equal vectors score equal. Recall is measured by the tests.

Vectors that are null, empty, all zero or hold null or non-finite components take no part, nor do rows
without an id. Rows that repeat an id are candidates each, but for their own id's queries. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shards

K = 20
DIMS = 24
SURE = 0.85  # on the check tool's table 37 in 100 rows are verified, at a recall of 0.95


def chi_square(x: float, degrees: int = 8) -> float:
    """The distribution function, for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, degrees // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


@functools.cache
def _limit(sure: float) -> float:
    """The x at which the chi-square test holds."""
    low, high = 0.0, 1.0
    while chi_square(high, DIMS) < sure:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, DIMS) < sure else (low, mid)
    return high


@functools.cache
def _directions(n: int) -> np.ndarray:
    return np.random.default_rng(n).standard_normal((n + 1, DIMS))


def _index(ids, data):
    norms = np.square(data).sum(axis=1)
    flat = np.column_stack([data, np.sqrt(np.maximum(norms.max() - norms, 0))]) @ _directions(data.shape[1])
    tree = shards.KdTree.build(flat)
    return ids[tree.order], data[tree.order], [*shards.kept(tree), flat[tree.order], norms.max(keepdims=True)]


def _projected(ids, data, index, q_ids, q_data, floor, k, sure, verified=None):
    """Arrays (query's place, candidate's place, score) of the k best found per query."""
    tree, flat, top = shards.read(index[:5]), np.frombuffer(index[5]).reshape(len(ids), -1), np.frombuffer(index[6])[0]
    q_flat, q_norms, limit, best = q_data @ _directions(data.shape[1])[:-1], np.square(q_data).sum(axis=1), _limit(sure), shards.Best(floor, k)
    flat_norms, q_flat_norms = np.square(flat).sum(axis=1), np.square(q_flat).sum(axis=1)

    def bound(nodes):  # minus the squared projected distance to each box
        out = np.zeros((len(q_flat), len(nodes)))
        for d in range(q_flat.shape[1]):
            x = q_flat[:, d, None]
            out -= np.square(np.maximum(np.maximum(tree.low[nodes, d] - x, x - tree.high[nodes, d]), 0))
        return out

    def reach(who):  # squared projected distance at which the test holds; infinite while there are fewer than k
        return limit * np.maximum(top + q_norms[who] - 2 * best.kth[who], 0.0)

    for node, who in tree.walk(bound, lambda b: -b <= reach(slice(None))[:, None], len(q_ids)):
        b, e = tree.begin[node], tree.end[node]
        near = flat_norms[b:e] + q_flat_norms[who][:, None] - 2 * (q_flat[who] @ flat[b:e].T)
        test = (near <= reach(who)[:, None] + 1e-9) & (ids[b:e] != q_ids[who][:, None])
        if verified is not None:
            verified.append(int(test.sum()))
        s = np.where(test, q_data[who] @ data[b:e].T, -np.inf)
        least = best.kth[who]
        if e - b > k:
            least = np.maximum(least, np.partition(s, e - b - k, axis=1)[:, e - b - k])
        slack = np.where(np.isfinite(least), 1e-9 * (1 + np.abs(least)), 0.0)
        i, j = np.nonzero(test & (s >= (least - slack)[:, None]))
        best.add(who[i], j + b, (data[j + b] * q_data[who[i]]).sum(axis=1), ids)
    return best.who, best.what, best.score


def nearest(df: DataFrame, every: int, k: int = K, sure: float = SURE, shard: int = shards.SHARD, block: int = shards.BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score for the queries whose vec_id is divisible by ``every``."""
    return shards.search(shards.vectors(df, zero=False), F.col("vec_id") % every == 0, k, _index, lambda *a: _projected(*a, k, sure), "double", shard, block)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 20)
