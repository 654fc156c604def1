"""Vector tables cut into shards, each with a kd-tree, and blocks of queries against them.

A shard is a run of at most ``SHARD`` rows of an input partition, so building needs no shuffle and no
task holds more than a shard. Its index is built once and written: rows in leaf order and, for each
node, the tight bounding box of what lies under it. Queries are dealt into blocks of about ``BLOCK``
rows; every block meets every shard, which is the work that an answer from all rows to a stated query
set asks for. A block walks a tree together: in step r each query goes to its rth nearest leaf, queries
at one leaf share a matrix product, and a query stops where its bound says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rows

SHARD, BLOCK, LEAF = 8192, 1024, 256


@dataclass
class KdTree:
    """Rows in leaf order; nodes in breadth-first order, each with the run of rows under it."""

    order: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray  # of the left child, the right one follows; -1 for a leaf

    @staticmethod
    def build(points: np.ndarray, leaf: int = LEAF) -> KdTree:
        order = np.arange(len(points))
        runs, child, low, high, at = [(0, len(points))], [], [], [], 0
        while at < len(runs):
            b, e = runs[at]
            p = points[order[b:e]]
            low.append(p.min(axis=0))
            high.append(p.max(axis=0))
            spread = high[-1] - low[-1]
            if e - b <= leaf or not spread.any():
                child.append(-1)
            else:
                m = (e - b) // 2
                order[b:e] = order[b:e][np.argpartition(p[:, int(np.argmax(spread))], m)]
                child.append(len(runs))
                runs += [(b, b + m), (b + m, e)]
            at += 1
        return KdTree(order, np.array([r[0] for r in runs]), np.array([r[1] for r in runs]), np.array(low), np.array(high), np.array(child))

    def walk(self, bound: Callable[[np.ndarray, np.ndarray], np.ndarray], good: Callable[[np.ndarray], np.ndarray], n: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries) in best-first order for each of n queries. bound(nodes) is a matrix of how good each query's rows
        under each node may be at best, high for good; good(bounds) tells, each time anew, which are worth following."""
        nodes, reach = np.zeros(1, np.int64), bound(np.zeros(1, np.int64))
        while (self.child[nodes] >= 0).any():  # down the levels; a node that no query may follow drops out
            inner = self.child[nodes] >= 0
            some = nodes[inner & good(reach).any(axis=0)]
            nodes = np.concatenate([nodes[~inner], np.column_stack([self.child[some], self.child[some] + 1]).ravel()])
            reach = bound(nodes)
        order = np.argsort(-reach, axis=1, kind="stable")
        for r in range(order.shape[1]):
            leaf = order[:, r]
            go = np.flatnonzero(good(reach[np.arange(n), leaf][:, None])[:, 0])
            if not len(go):
                return
            for at in np.unique(leaf[go]):
                yield int(nodes[at]), go[leaf[go] == at]


class Best:
    """The k best candidates of each query of a block: larger scores first, then smaller ids."""

    def __init__(self, floor: np.ndarray, k: int):
        self.kth, self.k = floor.copy(), k
        self.who, self.what, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, who: np.ndarray, what: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(who):
            return
        mine = np.isin(self.who, who)
        w, x, s = np.concatenate([self.who[mine], who]), np.concatenate([self.what[mine], what]), np.concatenate([self.score[mine].astype(score.dtype), score])
        order = np.lexsort((ids[x], -s, w))
        w, x, s = w[order], x[order], s[order]
        first = np.r_[True, w[1:] != w[:-1]]
        place = np.arange(len(w)) - np.maximum.accumulate(np.where(first, np.arange(len(w)), 0))
        last = place == self.k - 1
        self.kth[w[last]] = np.maximum(self.kth[w[last]], s[last])
        keep = place < self.k
        self.who, self.what, self.score = np.concatenate([self.who[~mine], w[keep]]), np.concatenate([self.what[~mine], x[keep]]), np.concatenate([self.score[~mine].astype(score.dtype), s[keep]])


def vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", zero: bool = True) -> DataFrame:
    """vec_id and v (array<double>) of rows with an id and a whole, finite vector; zero: whether all-zero vectors stay."""
    v = df[embedding].cast("array<double>")
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = df.select(df[vec_id].cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    return out if zero else out.where(F.exists("v", lambda x: x != 0))


def shards(v: DataFrame, size: int = SHARD, index: Callable[[np.ndarray, np.ndarray], tuple] | None = None) -> DataFrame:
    """One row per shard: ids (array) and data (binary of float64, a vector after the other), at most ``size`` vectors of one
    length each. index(ids, data) gives ids, data and a list of arrays to be kept in ``index``."""

    def row(some: list) -> pa.RecordBatch:
        ids, data, kept = np.array([i for i, _ in some], np.int64), np.stack([x for _, x in some]).astype(np.float64), []
        if index is not None:
            ids, data, kept = index(ids, data)
        return pa.RecordBatch.from_pydict({"ids": pa.array([ids], pa.list_(pa.int64())), "data": pa.array([data.tobytes()], pa.binary()), "index": pa.array([[a.tobytes() for a in kept]], pa.list_(pa.binary()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for i, x in zip(b.column("vec_id").to_pylist(), b.column("v").to_numpy(zero_copy_only=False), strict=True):
                some = held.setdefault(len(x), [])
                some.append((i, x))
                if len(some) == size:
                    yield row(held.pop(len(x)))
        for some in held.values():
            yield row(some)

    return v.mapInArrow(run, "ids array<long>, data binary, index array<binary>")


def kept(tree: KdTree) -> list[np.ndarray]:
    """The tree as arrays to be written; its rows are to be kept in leaf order."""
    return [tree.begin.astype(np.int64), tree.end.astype(np.int64), tree.child.astype(np.int64), tree.low.astype(np.float64), tree.high.astype(np.float64)]


def read(arrays: list[bytes]) -> KdTree:
    begin, end, child = (np.frombuffer(a, np.int64) for a in arrays[:3])
    low, high = (np.frombuffer(a, np.float64).reshape(len(begin), -1) for a in arrays[3:5])
    return KdTree(np.arange(end.max()), begin, end, low, high, child)


def search(v: DataFrame, is_query: Column, k: int, index: Callable, searcher: Callable, score: str, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates that ``searcher`` finds for each query.

    index(ids, data) is made once a shard (see shards). searcher(ids, data, index, q_ids, q_data, floor) gives arrays (query's
    place, candidate's place, score); ``floor`` holds each query's kth best score so far. All blocks first search one shard, and
    the kth scores found there go with them to the others. Rows that repeat are candidates each."""
    table = rows.stored(shards(v, shard, index).withColumn("shard", F.xxhash64("ids", "data")), "shards")
    q = rows.stored(shards(v.where(is_query), block).drop("index").withColumn("block", F.xxhash64("ids", "data")).withColumnsRenamed({"ids": "q_ids", "data": "q_data"}), "queries")
    n, home = table.agg(F.count("*"), F.min("shard")).first()
    table = table.repartition(max(1, n))
    cols = f"query_id long, vec_id long, score {score}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # the shard before: its rows come one after another
        for b in batches:
            for r in range(b.num_rows):
                if held is None or b.column("shard")[r].as_py() != last:
                    last, ids = b.column("shard")[r].as_py(), np.asarray(b.column("ids")[r].values)
                    held = ids, np.frombuffer(b.column("data")[r].as_py(), np.float64).reshape(len(ids), -1), b.column("index")[r].as_py()
                q_ids = np.asarray(b.column("q_ids")[r].values)
                q_data = np.frombuffer(b.column("q_data")[r].as_buffer(), np.float64).reshape(len(q_ids), -1)
                if held[1].shape[1] != q_data.shape[1]:
                    continue  # vectors of different lengths have no product
                known = {x["query_id"]: x["score"] for x in b.column("floor")[r].as_py() or ()}
                floor = np.array([known.get(i, -np.inf) for i in q_ids.tolist()], dtype=np.float64)
                who, what, s = searcher(*held, q_ids, q_data, floor)
                if len(who):
                    yield pa.RecordBatch.from_pydict({"query_id": q_ids[who], "vec_id": held[0][what], "score": s})

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)

    columns = ["shard", "ids", "data", "index", "q_ids", "q_data", "floor"]
    none = F.lit(None).cast("array<struct<query_id:bigint,score:double>>")
    first = rows.stored(table.where(F.col("shard") == F.lit(home)).crossJoin(q.withColumn("floor", none)).select(*columns).mapInArrow(run, cols), "first")
    kth = best(first).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("score"))
    floors = q.select("block", F.explode("q_ids").alias("query_id")).join(kth, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "score")).alias("floor"))
    rest = table.where(F.col("shard") != F.lit(home)).crossJoin(q.join(floors, "block", "left").drop("block")).select(*columns).mapInArrow(run, cols)
    return best(first.unionByName(rest)).select("query_id", "rank", "vec_id", "score")
