"""Exact top-k search by kd-trees per shard.

Vectors become floor(256 x) and the score is the integer inner product. Each shard's tree splits at
medians of the widest side and keeps tight boxes; no row of a box scores above q+ . high + q- . low.
A query walks a shard best bound first and stops when the bound falls under its kth score, which it
brought from the shard before. Equal scores go to the smaller vec_id, so bounds that equal the kth
score are still followed. Trees are built once a shard and written. ``share_visited`` tells how much
of a table the bounds leave over.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an
id. Rows that repeat an id are candidates each, but for their own id's queries. An empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shards

K = 5
SCALE = 256.0


def _index(ids, data):
    data = np.floor(SCALE * data)
    tree = shards.KdTree.build(data)
    return ids[tree.order], data[tree.order], shards.kept(tree)


def _best_first(ids, data, index, q_ids, q_data, floor, k, visited=None):
    """Arrays (query's place, candidate's place, score) of each query's k best, ties to the smaller id."""
    tree, q_data = shards.read(index), np.floor(SCALE * q_data)
    largest = data.shape[1] * float(np.abs(data).max()) * float(np.abs(q_data).max())
    exact = (lambda x: x) if largest < 2**53 else (lambda x: x.astype(np.int64))  # beyond, sums are made in int64
    slack = 0.0 if largest < 2**53 else 1e-9
    up, down, best = np.maximum(q_data, 0), np.minimum(q_data, 0), shards.Best(floor, k)

    def bound(nodes):
        b = up @ tree.high[nodes].T + down @ tree.low[nodes].T
        return b + np.abs(b) * slack

    for node, who in tree.walk(bound, lambda b: b >= best.kth[:, None], len(q_ids)):
        b, e = tree.begin[node], tree.end[node]
        s = exact(q_data[who]) @ exact(data[b:e]).T
        if visited is not None:
            visited.append(s.size)
        own = ids[b:e] == q_ids[who][:, None]
        s = np.where(own, np.iinfo(np.int64).min if s.dtype == np.int64 else -np.inf, s)
        least = best.kth[who]
        if e - b > k:
            least = np.maximum(least, np.partition(s, e - b - k, axis=1)[:, e - b - k])
        i, j = np.nonzero((s >= least[:, None]) & ~own)
        best.add(who[i], j + b, s[i, j], ids)
    return best.who, best.what, best.score.astype(np.int64)


def exact_topk(df: DataFrame, every: int, k: int = K, shard: int = shards.SHARD, block: int = shards.BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score for the queries whose vec_id is divisible by ``every``."""
    return shards.search(shards.vectors(df), F.col("vec_id") % every == 0, k, _index, lambda *a: _best_first(*a, k), "long", shard, block)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 50)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
