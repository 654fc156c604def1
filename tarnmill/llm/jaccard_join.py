"""N-gram Jaccard join by a count-vector R-tree.

A document's set of shingle hashes is hashed into groups; the counts per group are a point, and two sets
share at most the sum of their coordinates' minima. There are at least ``GROUPS`` groups, and as many as
keep the mean count at ``MEAN`` or less: were it larger, any two long texts of one length would have
nearly equal points. (Points that go with very many keys have fewer, see stored_point; sets are verified either way.) Group numbers are powers of two, so points of different length compare after
folding the longer. An R-tree over points bounds a whole
box by the minima with its upper corner, so boxes and pairs whose bound misses the threshold are never
looked at, and what survives is verified on the sets.

Random texts of one length all have nearly the same point, so one tree over everything would prune
little. Points are therefore dealt to small trees by keys that lose no link: two sets that link differ
in at most ``d`` = (1 - s) / (1 + s) of their sizes' sum elements at similarity s (15/185 at 0.85); cut the hash space into more than ``d`` cells,
and at least one cell's content is the same in both. The key is that content's hash, with the size
class that fixes the number of cells; a set near a class's end has keys of the next class too. Cells
empty in both prove nothing, so there are more cells than d + 1, and a set with more empty cells than
that margin has prefix keys besides: the least (1 - s) n + 1 of its hashes, one of which any two
such sets share.

A key's group that fits one leaf of the tree (``SMALL`` nodes or fewer) has no boxes to prune by: its pairs are bounded at
once, many groups together.

Steps: (1) sets that are equal become one node; (2) keys with one node go; (3) in each key's tree,
nodes whose bound passes are united, and a spanning forest of them leaves; (4) the forests' components
are small clusters, to which the sets are dealt; (5) each cluster's tree verifies pairs on the sets
and skips pairs already united; (6) components of the verified links. Keys and clusters of more than
``BLOCK`` nodes, and clusters of more than ``BLOCK_BYTES`` of sets, are cut into blocks, and each pair of blocks is a task's work, so no group is
collected whole; no pair is dropped. Words and shingles are 64-bit hashes throughout, and similarity is
counted on them; a node is told by a hash of its set. Names go back to rows by a join in which the rows of
frequent nodes, as of exact copies, stay where they are.

Texts: null, empty or without words: empty set, linked with nothing. A text of any length is read whole, in
proportion to its length. Rows that repeat have equal sets and one component. A null doc_id never names a
component, and rows without an id are told apart by their texts. An empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rows
from .arrow_text import mix, shingles, words
from .components import components

WIDTH = 4
NUM, DEN = 85, 100  # similarity of op1; others pass num and den
GROUPS, MEAN = 64, 8
BLOCK, BLOCK_BYTES, POINT_BYTES = 4096, 1 << 25, 1 << 20
LEAF, FAN = 32, 16
U = np.uint64
KINDS = {1: np.uint8, 2: np.uint16, 4: np.int32}  # of a stored point, by bytes a count


def _classes(limit: int = 1 << 40) -> np.ndarray:
    """Least sizes of the size classes; each is about 1.5 times the one before."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out)


CLASSES = _classes()


def differing(total: int, num: int = NUM, den: int = DEN) -> int:
    """The most elements by which two linked sets can differ, if their sizes sum to total."""
    return (den - num) * total // (den + num)


def cells(level: int, num: int = NUM, den: int = DEN) -> tuple[int, int]:
    """(number of cells, most empty cells that prove nothing) of a size class."""
    d = differing(2 * (int(CLASSES[level + 1]) - 1), num, den)
    spare = 0 if d == 0 else max(1, -(-15 * d // 100))
    return d + 1 + spare, spare


def keys(hashes: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The keys of one set (sorted distinct hashes)."""
    n, out = len(hashes), []
    first = int(np.searchsorted(CLASSES, n, side="right")) - 1
    last = int(np.searchsorted(CLASSES, n * den // num, side="right")) - 1
    mixed = mix(hashes ^ U(0x5851F42D4C957F2D))
    for level in range(first, last + 1):
        count, spare = cells(level, num, den)
        cell = ((hashes >> U(32)) * U(count)) >> U(32)  # rises with the hash, so cells are runs
        at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        out.append(mix(np.add.reduceat(mixed, at) + cell[at] * U(0x9E3779B97F4A7C15) + U((level + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)))
        if count - len(at) > spare:
            out.append(mix(hashes[: n - -(-num * n // den) + 1] + U((level + 1) * 0x165667B19E3779F9 & 0xFFFFFFFFFFFFFFFF)))
    return np.concatenate(out)


def point(hashes: np.ndarray, most: int = 1 << 40) -> np.ndarray:
    """Counts by group; groups come from other bits than cells. ``most`` bounds the groups, a power of two."""
    groups = min(most, max(GROUPS, 1 << (max(1, len(hashes) // MEAN) - 1).bit_length()))
    return np.bincount((hashes & U(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)


def stored_point(hashes: np.ndarray, copies: int) -> bytes:
    """The point in as few bytes as its counts need; the first byte tells how many each has. One copy goes with each key, so a
    long text's point is coarser: all copies have POINT_BYTES groups, or GROUPS each."""
    p = point(hashes, max(GROUPS, 1 << max(0, (POINT_BYTES // max(1, copies)).bit_length() - 1)))
    kind = np.uint8 if p.max() < 1 << 8 else np.uint16 if p.max() < 1 << 16 else np.int32
    return bytes([kind().itemsize]) + p.astype(kind).tobytes()


def read_point(b: pa.Buffer) -> np.ndarray:
    return np.frombuffer(b, dtype=KINDS[np.frombuffer(b, np.uint8, 1)[0]], offset=1)


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """The point that ``groups`` groups would have given."""
    return p.astype(np.int32, copy=False) if len(p) == groups else p.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def alike(points: list[np.ndarray]) -> np.ndarray:
    """One matrix of points, all folded to the shortest."""
    groups = min(map(len, points))
    return np.stack([folded(p, groups) for p in points])


def sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for w in words(column, lower=True):
        h, doc = shingles(w, width)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        cuts = np.searchsorted(doc, np.arange(w.n_docs + 1))
        for i in range(w.n_docs):
            yield h[cuts[i] : cuts[i + 1]]


def node(hashes: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(hashes).sum(dtype=U) + U(len(hashes))]))[0].astype(np.int64))


class Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def roots(self, of: np.ndarray) -> np.ndarray:
        r = self.up[of]
        while (self.up[r] != r).any():
            r = self.up[r]
        self.up[of] = r
        return r


class RTree:
    """Points sorted by size, then packed bottom-up; a box keeps its upper corner and its range of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        # Sort-tile order: by size, then, in runs of FAN leaves, by the widest coordinate.
        order = np.argsort(sizes, kind="stable")
        for at in range(0, len(order), LEAF * FAN):
            run = order[at : at + LEAF * FAN]
            widest = int(np.argmax(points[run].max(axis=0) - points[run].min(axis=0)))
            order[at : at + LEAF * FAN] = run[np.argsort(points[run, widest], kind="stable")]
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels, high, small, large, step = [], self.points, self.sizes, self.sizes, LEAF
        while True:
            at = np.arange(0, len(high), step)
            high, small, large = np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at)
            self.levels.append((high, small, large, step))
            if len(high) <= FAN:
                break
            step = FAN

    def candidates(self, p: np.ndarray, n: int) -> np.ndarray:
        """Indices of points whose bound allows a link with point p of size n."""
        num, den = self.num, self.den
        at = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            high, small, large, step = self.levels[k]
            shared = np.minimum(high[at], p).sum(axis=1)
            fits = ((den + num) * shared >= num * (n + small[at])) & (den * large[at] >= num * n) & (num * small[at] <= den * n)
            at = at[fits]
            below = len(self.levels[k - 1][0]) if k else len(self.points)
            at = (at[:, None] * step + np.arange(step)).ravel()
            at = at[at < below]
        if not len(at):
            return at
        shared = np.minimum(self.points[at], p).sum(axis=1)
        return self.order[at[(den + num) * shared >= num * (n + self.sizes[at])]]


def united(points: np.ndarray, sizes: np.ndarray, verify=None, block: np.ndarray | None = None, num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """Spanning links of the points whose bound passes and that verify, if given, accepts. With two blocks only pairs across count."""
    tree, union, out = RTree(points, sizes, num, den), Union(len(points)), []
    for i in range(len(points)):
        found = tree.candidates(points[i], int(sizes[i]))
        found = found[found > i]
        if block is not None:
            found = found[block[found] != block[i]]
        if len(found):
            found = found[union.roots(found) != union.root(i)]
        for j in found.tolist():
            if union.root(i) != union.root(j) and (verify is None or verify(i, j)):
                union.join(i, j)
                out.append((i, j))
    return out


def linked(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    """den * intersection >= num * union."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return (den + num) * both >= num * (len(a) + len(b))


def _nodes(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, row (hash), n, node, point and keys of every row; an empty set has no node."""

    def fn(batch):
        every = list(sets(batch.column("text"), width))
        full = [len(h) > 0 for h in every]
        seen: set[int] = set()
        ids = [node(h) if f else None for h, f in zip(every, full, strict=True)]
        fresh = [f and not (i in seen or seen.add(i)) for i, f in zip(ids, full, strict=True)]  # keys once a batch
        named = [keys(h, num, den).view(np.int64) if f else None for h, f in zip(every, fresh, strict=True)]
        return {
            "doc_id": batch.column("doc_id"),
            "row": batch.column("row"),
            "n": [len(h) for h in every],
            "node": pa.array(ids, pa.int64()),
            "point": pa.array([None if k is None else stored_point(h, len(k)) for h, k in zip(every, named, strict=True)], pa.binary()),
            "keys": pa.array(named, pa.list_(pa.int64())),
        }

    t = rows.texts(docs)
    return rows.map_batches(t.withColumn("row", rows.row_hash(t["doc_id"], t["text"])), fn, "doc_id long, row long, n long, node long, point binary, keys array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node), sorted: those whose key has two nodes or more, each once. Holds one row over."""
    key, last, alone = np.zeros(0, np.int64), np.zeros(0, np.int64), True  # the row held; alone: no other node of its key left yet
    for b in batches:
        k = np.concatenate([key, b.column("key").to_numpy()])
        v = np.concatenate([last, b.column("node").to_numpy()])
        same = np.zeros(len(k), dtype=bool)
        same[1:] = (k[1:] == k[:-1]) & (v[1:] == v[:-1])
        first_held = len(key) > 0
        k, v = k[~same], v[~same]
        if not len(k):
            continue
        before, after = np.zeros(len(k), dtype=bool), np.zeros(len(k), dtype=bool)
        before[1:] = k[1:] == k[:-1]
        after[:-1] = before[1:]
        if first_held and not alone:
            before[0] = True
        keep = before | after
        key, last, alone = k[-1:], v[-1:], not before[-1]
        keep[-1] = False
        if keep.any():
            yield pa.RecordBatch.from_pydict({"key": k[keep], "node": v[keep]})
    if len(key) and not alone:
        yield pa.RecordBatch.from_pydict({"key": key, "node": last})


def _blocked(df: DataFrame, by: str, block: int, size: Column | None = None) -> DataFrame:
    """df with a column ``task``: rows of a small group share one; a row of a group of more than ``block`` rows, or of more than
    BLOCK_BYTES in all, has one copy for each pair of blocks that its block is in, with ``part`` its block."""
    total = df.groupBy(by).agg(F.count("*").alias("_n"), F.sum(F.lit(0) if size is None else size).alias("_b"))
    blocks = F.greatest(F.ceil(F.col("_n") / block), F.ceil(F.col("_b") / BLOCK_BYTES)).cast("int")
    big = rows.stored(total.select(F.col(by).alias("_by"), "_n", blocks.alias("_blocks")).where(F.col("_blocks") > 1), "jaccard-big")
    # The HOT_KEYS largest groups are told by broadcast, and their rows are spread; no other has over 1 / HOT_KEYS of all rows.
    hot = big.orderBy(F.desc("_n"), "_by").limit(rows.HOT_KEYS).select(F.col("_by").alias("_hot"), F.col("_blocks").alias("_hot_blocks"))
    out = df.join(F.broadcast(hot), F.col(by) == F.col("_hot"), "left").withColumn("_at", F.when(F.col("_hot").isNull(), F.col(by)).otherwise(F.xxhash64("node")))
    out = out.join(big.drop("_n"), F.col("_at") == F.col("_by"), "left").withColumn("_blocks", F.coalesce("_hot_blocks", "_blocks", F.lit(1)))
    out = out.withColumn("part", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    out = out.withColumn("_other", other)
    return out.withColumn("task", F.xxhash64(by, F.least("part", "_other"), F.greatest("part", "_other"))).drop("_by", "_blocks", "_other", "_hot", "_hot_blocks", "_at")


def _groups(batches: Iterator[pa.RecordBatch], small: int = 1 << 14) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole tasks, with the places where each begins; rows come sorted by task."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < small:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        task = t["task"].to_numpy()
        cut = int(np.searchsorted(task, task[-1], side="left"))
        if cut:
            yield t.slice(0, cut), np.flatnonzero(np.r_[True, task[1:cut] != task[: cut - 1]])
            held = t.slice(cut).combine_chunks().to_batches()
    if held and sum(x.num_rows for x in held):
        t = pa.Table.from_batches(held).combine_chunks()
        task = t["task"].to_numpy()
        yield t, np.flatnonzero(np.r_[True, task[1:] != task[:-1]])


SMALL = 6


def _bounded(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Links of the nodes of one task whose bounds pass: small groups in bulk, others by tree."""
    for t, begins in _groups(batches):
        raw = [read_point(x.as_buffer()) for x in t["point"].combine_chunks()]
        sizes, ids, part = t["n"].to_numpy(), t["node"].to_numpy(), t["part"].to_numpy()
        width = np.diff(np.r_[begins, len(ids)])
        least = np.minimum.reduceat(np.array([len(p) for p in raw]), begins)  # groups of a task's shortest point
        a, b = [], []
        for groups in np.unique(least[width <= SMALL]):
            some = np.flatnonzero((least == groups) & (width <= SMALL))
            rows_ = np.concatenate([np.arange(begins[g], begins[g] + width[g]) for g in some])
            task, points = np.repeat(some, width[some]), np.stack([folded(raw[i], groups) for i in rows_])
            for k in range(1, SMALL):
                i = np.flatnonzero(task[k:] == task[:-k]) if len(task) > k else np.zeros(0, int)
                j = i + k
                fits = (den + num) * np.minimum(points[i], points[j]).sum(axis=1) >= num * (sizes[rows_[i]] + sizes[rows_[j]])
                a.append(ids[rows_[i[fits]]])
                b.append(ids[rows_[j[fits]]])
        for g in np.flatnonzero(width > SMALL):
            at = slice(begins[g], begins[g] + width[g])
            links = united(alike(raw[at]), sizes[at], block=part[at] if part[at].min() != part[at].max() else None, num=num, den=den)
            a.append(ids[at][[x for x, _ in links]])
            b.append(ids[at][[y for _, y in links]])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            pair = np.unique(np.column_stack([np.maximum(a, b), np.minimum(a, b)]), axis=0)
            yield pa.RecordBatch.from_pydict({"a": pair[:, 0].copy(), "b": pair[:, 1].copy()})


def _verified(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of one cluster, or of two blocks of it, verified on the sets."""
    for t, begins in _groups(batches, 256):
        ids, part, raw = t["node"].to_numpy(), t["part"].to_numpy(), t["hashes"].combine_chunks()
        for lo, hi in zip(begins, [*begins[1:], len(ids)], strict=True):
            every = [np.frombuffer(x.as_buffer(), dtype=U) for x in raw[int(lo) : int(hi)]]  # no copy
            points, sizes = alike([point(h) for h in every]), np.array([len(h) for h in every])
            blocks = part[lo:hi] if part[lo:hi].min() != part[lo:hi].max() else None
            links = united(points, sizes, lambda i, j, e=every: linked(e[i], e[j], num, den), blocks, num, den)
            if links:
                yield pa.RecordBatch.from_pydict({"a": ids[lo:hi][[x for x, _ in links]], "b": ids[lo:hi][[y for _, y in links]]})


def jaccard_components(docs: DataFrame, width: int = WIDTH, block: int = BLOCK, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text); shingles of ``width`` words, similarity num / den."""
    nodes = rows.stored(_nodes(docs, width, num, den), "jaccard")
    pairs = nodes.where(F.col("keys").isNotNull()).select(F.explode("keys").alias("key"), "node")
    shared = pairs.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared, "key long, node long")
    points = nodes.where(F.col("point").isNotNull()).dropDuplicates(["node"]).select("node", "n", "point")
    shared = rows.stored(shared, "jaccard-keys")
    dealt = _blocked(shared, "key", block * 2).join(points, "node")
    bounded = dealt.select("task", "part", "node", "n", "point").repartition("task").sortWithinPartitions("task", "n").mapInArrow(lambda batches: _bounded(batches, num, den), "a long, b long")
    clusters = components(bounded)
    one = nodes.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.count("*").alias("copies"))
    chosen = clusters.join(one, "node").select("node", "root", "row")
    found = rows.stored(_sets_of(docs, chosen, width), "jaccard-sets")
    tasks = _blocked(found, "root", block, F.octet_length("hashes")).select("task", "part", "node", "hashes").repartition("task").sortWithinPartitions("task", "node")
    links = components(tasks.mapInArrow(lambda batches: _verified(batches, num, den), "a long, b long"))
    least = one.join(links, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = links.join(least, "root").select("node", "component_id")
    named = one.select("node", "copies", F.col("doc_id").alias("own")).join(named, "node", "left").select("node", "copies", F.coalesce("component_id", "own").alias("component_id"))
    named = rows.stored(named, "jaccard-names")
    total = named.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    rows.discard(shared, found)
    slim = nodes.select("doc_id", "n", "node")
    full = rows.spread_join(slim.where(F.col("node").isNotNull()), named, "node", "copies", total).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return full.unionByName(slim.where(F.col("node").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _sets_of(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """node, root and hashes (binary) of the chosen nodes, from the text of one row of each."""

    def fn(batch):
        every = list(sets(batch.column("text"), width))
        ids = batch.column("node").to_pylist()
        mine = [i for i, h in enumerate(every) if len(h) and node(h) == ids[i]]
        return {"node": pa.array([ids[i] for i in mine], pa.int64()), "root": batch.column("root").take(pa.array(mine, pa.int64())), "hashes": pa.array([every[i].tobytes() for i in mine], pa.binary())}

    t = rows.texts(docs)
    t = t.select(rows.row_hash(t["doc_id"], t["text"]).alias("row"), "text").join(chosen, "row").select("text", "node", "root")
    return rows.map_batches(t, fn, "node long, root long, hashes binary").dropDuplicates(["node"])


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(rows.documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS g FROM w
), d AS MATERIALIZED (
  SELECT doc_id, len(g) AS n, CASE WHEN len(g) > 0 THEN md5(array_to_string(g, chr(10))) END AS node, g FROM s
), u AS MATERIALIZED (
  SELECT node, any_value(n) AS n, any_value(g) AS g, min(doc_id) AS first_id FROM d WHERE node IS NOT NULL GROUP BY node
), e AS MATERIALIZED (
  SELECT node, n, unnest(g) AS x FROM u
), l AS MATERIALIZED (
  SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.x = b.x AND a.node <> b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), r AS (
  SELECT node AS f, node AS t FROM u UNION SELECT r.f, l.b FROM r JOIN l ON l.a = r.t
), c AS (
  SELECT f, min(first_id) AS component_id FROM r JOIN u ON u.node = r.t GROUP BY f
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN c ON c.f = d.node
"""
