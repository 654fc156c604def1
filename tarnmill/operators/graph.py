"""Link-graph operators. ``nodes`` has id, ``edges`` src and dst (ids), once each and without self-links.

Loops run on the driver and only see counts or sums; every few rounds the state is written to the shared
folder, which cuts lineage. Neighbour sums are aggregates with map-side combine, so hubs do not gather.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import discard, stored
from .pages import trimmed

CENTRALITY_NODES = 20_000
CENTRALITY_EDGES = 2_000_000


def build(pages: DataFrame, links: DataFrame, exact: bool = False) -> DataFrame:
    """edges between pages (k, url, final_url). A link goes to the page with its url; else, unless ``exact``, to one whose final
    url it is, else to one whose url differs by a trailing slash. Ties go to the least id."""
    own = pages.select(F.col("url").alias("key"), F.lit(0).alias("rank"), "k")
    keys = own if exact else own.unionByName(pages.where(F.col("final_url") != F.col("url")).select(F.col("final_url").alias("key"), F.lit(1).alias("rank"), "k"))
    keys = keys.groupBy("key").agg(F.min(F.struct("rank", "k")).alias("best"))
    l = links.where("internal").select("src", "dst").distinct()
    src = pages.groupBy(F.col("url").alias("_u")).agg(F.min("k").alias("src_id"))
    found = l.join(src, F.col("src") == F.col("_u")).join(keys, F.col("dst") == F.col("key"), "left").select("src_id", "dst", F.col("best.k").alias("dst_id"))
    if not exact:
        slash = pages.groupBy(trimmed(F.col("url")).alias("_s")).agg(F.min("k").alias("_k"))
        found = found.join(slash, trimmed(F.col("dst")) == F.col("_s"), "left").withColumn("dst_id", F.coalesce("dst_id", "_k"))
    return found.where(F.col("dst_id").isNotNull() & (F.col("src_id") != F.col("dst_id"))).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).distinct()


def by_source(edges: DataFrame) -> DataFrame:
    """edges written once, dealt by source: loops read them each round."""
    return edges if hasattr(edges, "_stored_at") else stored(edges.repartition("src"), "edges")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    o = edges.groupBy(F.col("src").alias("_s")).agg(F.count("*").alias("out_degree"))
    i = edges.groupBy(F.col("dst").alias("_d")).agg(F.count("*").alias("in_degree"))
    return nodes.select("id").join(o, F.col("id") == F.col("_s"), "left").join(i, F.col("id") == F.col("_d"), "left").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, epsilon: float = 1e-4, damping: float = 0.85, digits: int = 2) -> DataFrame:
    """id, score scaled to a maximum of 10. Pages without links spread their rank evenly. Stops when the ranks' sum of changes
    is under epsilon."""
    edges = by_source(edges)
    d = stored(degrees(nodes, edges).select("id", "out_degree"), "degrees")
    n = d.count()
    if not n:
        return d.select("id", F.lit(0.0).alias("score"))
    rank, state = d.withColumn("rank", F.lit(1.0 / n)), None
    for k in range(rounds):
        dangling = F.lit(rank.agg(F.coalesce(F.sum(F.when(F.col("out_degree") == 0, F.col("rank"))), F.lit(0.0))).first()[0])
        sent = edges.join(rank.select(F.col("id").alias("_i"), F.try_divide("rank", "out_degree").alias("part")), F.col("src") == F.col("_i")).groupBy("dst").agg(F.sum("part").alias("got"))
        new = rank.join(sent, F.col("id") == F.col("dst"), "left").select("id", "out_degree", F.col("rank").alias("old"), ((1 - damping) / n + damping * dangling / n + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        before, new = state, stored(new, "pagerank")
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        rank, state = new.select("id", "out_degree", "rank"), new
        discard(before)
        if moved < epsilon:
            break
    top = rank.agg(F.max("rank")).first()[0]
    return rank.select("id", F.round(F.col("rank") / top * 10, digits).alias("score"))


def hits(nodes: DataFrame, edges: DataFrame, rounds: int = 50, epsilon: float = 1e-4, digits: int = 2) -> DataFrame:
    """id, authority and hub, each scaled to a maximum of 10; both are updated from the vectors before."""
    edges, state = by_source(edges), None
    v = stored(nodes.select("id", F.lit(1.0).alias("auth"), F.lit(1.0).alias("hub")), "hits")
    for _ in range(rounds):
        a = edges.join(v.select(F.col("id").alias("_i"), "hub"), F.col("src") == F.col("_i")).groupBy(F.col("dst").alias("_a")).agg(F.sum("hub").alias("new_auth"))
        h = edges.join(v.select(F.col("id").alias("_i"), "auth"), F.col("dst") == F.col("_i")).groupBy(F.col("src").alias("_h")).agg(F.sum("auth").alias("new_hub"))
        new = stored(v.join(a, F.col("id") == F.col("_a"), "left").join(h, F.col("id") == F.col("_h"), "left").select("id", "auth", "hub", F.coalesce("new_auth", F.lit(0.0)).alias("na"), F.coalesce("new_hub", F.lit(0.0)).alias("nh")), "hits")
        na, nh = new.agg(F.sqrt(F.sum(F.col("na") * F.col("na"))), F.sqrt(F.sum(F.col("nh") * F.col("nh")))).first()
        na, nh = na or 1.0, nh or 1.0
        moved = new.agg(F.sum(F.abs(F.col("na") / na - F.col("auth")) + F.abs(F.col("nh") / nh - F.col("hub")))).first()[0]
        v = new.select("id", (F.col("na") / na).alias("auth"), (F.col("nh") / nh).alias("hub"))
        discard(state)
        state = new
        if moved is None or moved < epsilon:
            break
    top_a, top_h = v.agg(F.max("auth"), F.max("hub")).first()
    scale = lambda c, t: F.round(F.col(c) / t * 10, digits) if t else F.lit(0.0)
    return v.select("id", scale("auth", top_a).alias("authority"), scale("hub", top_h).alias("hub"))


def click_depths(edges: DataFrame, home: int, deepest: int | None = None) -> DataFrame:
    """id, depth of the pages reached from home; level by level until nothing is new."""
    spark, edges = edges.sparkSession, by_source(edges)
    seen = spark.createDataFrame([(home, 0)], "id long, depth int")
    front, depth = seen, 0
    while deepest is None or depth < deepest:
        depth += 1
        step = front.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        front = stored(step.join(seen.select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left_anti").withColumn("depth", F.lit(depth)), "depths")
        if front.isEmpty():
            break
        before, seen = seen, stored(seen.unionByName(front), "depths")
        discard(before)
    return seen


def subgraph(edges: DataFrame, root: int, hops: int, cap: int = 500) -> DataFrame:
    """id, depth and whether more lies behind: pages within so many hops, the nearest ``cap`` of them."""
    near = click_depths(edges, root, hops).orderBy("depth", "id").limit(cap)
    out = edges.join(near.select(F.col("id").alias("_i")), F.col("src") == F.col("_i"), "left_semi").join(near.select(F.col("id").alias("_j")), F.col("dst") == F.col("_j"), "left_anti").select(F.col("src").alias("_o")).distinct()
    return near.join(out, F.col("id") == F.col("_o"), "left").select("id", "depth", F.col("_o").isNotNull().alias("expandable"))


def near_orphans(edges: DataFrame, ok: DataFrame, depths: DataFrame, most: int = 2, deep: int = 4) -> DataFrame:
    """ok (id): pages with one to ``most`` links in, the worst of which comes from depth ``deep`` or more; unreached is 999."""
    e = edges.join(depths.select(F.col("id").alias("_i"), F.col("depth").alias("d")), F.col("src") == F.col("_i"), "left")
    per = e.groupBy("dst").agg(F.count("*").alias("in_degree"), F.max(F.coalesce("d", F.lit(999))).alias("worst"))
    return per.join(ok.select(F.col("id").alias("_o")), F.col("dst") == F.col("_o"), "left_semi").where((F.col("in_degree") <= most) & (F.col("worst") >= deep)).select(F.col("dst").alias("id"), "in_degree", F.when(F.col("worst") != 999, F.col("worst")).alias("worst_depth"))


def dilution(edges: DataFrame) -> DataFrame:
    """id, out_degree, equity 1 / log2(out + 1) and warning of pages with 20 links or more."""
    d = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree")).where(F.col("out_degree") >= 20)
    e = F.round(1 / F.log2(F.col("out_degree") + 1), 6)
    return d.withColumn("equity", e).withColumn("warning", F.when(F.col("equity") < 0.13, "excessive").when(F.col("equity") < 0.15, "high").when(F.col("equity") < 0.18, "moderate").otherwise("none"))


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, root): the least id of each connected component, by spreading minima and jumping. Joins are by sorting: both
    sides grow with the links."""
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = stored(links.where(F.col("a") != F.col("b")).select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("x")).select("x.*").distinct(), "components")
    label = stored(both.select(F.col("a").alias("id")).distinct().withColumn("root", F.col("id")), "components")
    state = None
    while True:
        least = both.join(label.select(F.col("id").alias("_i"), "root").hint("merge"), F.col("b") == F.col("_i")).groupBy("a").agg(F.min("root").alias("m"))
        new = label.join(least.hint("merge"), F.col("id") == F.col("a"), "left").select("id", F.least("root", "m").alias("root"), F.col("root").alias("old"))
        jump = new.select(F.col("id").alias("_r"), F.col("root").alias("up"))
        new = stored(new.join(jump.hint("merge"), F.col("root") == F.col("_r"), "left").select("id", F.least("root", "up").alias("root"), "old"), "components")
        if new.where(F.col("root") != F.col("old")).isEmpty():
            return new.select("id", "root")
        discard(label if state is None else state)
        label, state = new.select("id", "root"), new


def centralities(nodes: DataFrame, edges: DataFrame, sources: int = 500) -> DataFrame:
    """id, betweenness and closeness. Up to CENTRALITY_NODES nodes and CENTRALITY_EDGES edges the graph goes to every task, which
    bounds what is sent; over 5000 nodes, betweenness comes from the ``sources`` least nodes by hash, scaled up. Larger graphs are
    walked from those sources by joins (see sampled_centralities); closeness is then known for the sources alone, else null."""
    spark = nodes.sparkSession
    schema = "id long, betweenness double, closeness double"
    n, m = nodes.count(), edges.count()
    if not n:
        return spark.createDataFrame([], schema)
    if n > CENTRALITY_NODES or m > CENTRALITY_EDGES:
        return sampled_centralities(nodes, edges, min(n, sources))
    ids = np.sort(nodes.select("id").toPandas()["id"].to_numpy())
    e = edges.toPandas()
    s, d = np.searchsorted(ids, e["src"].to_numpy()), np.searchsorted(ids, e["dst"].to_numpy())
    order = np.argsort(s, kind="stable")
    graph = spark.sparkContext.broadcast((ids, np.searchsorted(s[order], np.arange(n + 1)), d[order]))
    used = min(n, sources) if n > 5000 else n
    chosen = spark.createDataFrame(pd.DataFrame({"s": np.arange(n)})).orderBy(F.xxhash64("s")).withColumn("between", F.monotonically_increasing_id() >= 0)
    few = chosen.limit(used).select(F.col("s").alias("_s"))
    work = chosen.join(few, F.col("s") == F.col("_s"), "left").select("s", F.col("_s").isNotNull().alias("between")).repartition(8)

    def run(batches):
        ids_, offsets, targets = graph.value
        total, near = np.zeros(len(ids_)), []
        for b in batches:
            for source, between in zip(b["s"], b["between"], strict=True):
                dist, sigma = np.full(len(ids_), -1), np.zeros(len(ids_))
                dist[source], sigma[source] = 0, 1
                order_, front, parents = [source], [source], {}
                while front:
                    nxt = []
                    for u in front:
                        for v in targets[offsets[u] : offsets[u + 1]].tolist():
                            if dist[v] < 0:
                                dist[v] = dist[u] + 1
                                nxt.append(v)
                            if dist[v] == dist[u] + 1:
                                sigma[v] += sigma[u]
                                parents.setdefault(v, []).append(u)
                    order_ += nxt
                    front = nxt
                far = dist[dist > 0].sum()
                near.append((ids_[source], (dist > 0).sum() / far if far else 0.0))
                if between:
                    delta = np.zeros(len(ids_))
                    for v in reversed(order_):
                        for u in parents.get(v, ()):
                            delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
                        if v != source:
                            total[v] += delta[v]
        yield pd.DataFrame({"id": ids_, "betweenness": total, "closeness": 0.0})
        yield pd.DataFrame({"id": [i for i, _ in near], "betweenness": 0.0, "closeness": [c for _, c in near]}).astype({"id": "int64"})

    out = work.mapInPandas(run, schema).groupBy("id").agg((F.sum("betweenness") * (n / used)).alias("betweenness"), F.max("closeness").alias("closeness"))
    return out.select("id", F.round("betweenness", 6).alias("betweenness"), F.round("closeness", 6).alias("closeness"))


def sampled_centralities(nodes: DataFrame, edges: DataFrame, sources: int = 500, at_once: int = 50) -> DataFrame:
    """The same from ``sources`` nodes, the least by hash: shortest paths from all sources of a group at once, level by level, each
    level written; then dependencies back up the levels (Brandes 2001). No task holds more than its share of a level."""
    edges = by_source(edges)
    chosen = [r.id for r in nodes.select("id").orderBy(F.xxhash64("id"), "id").limit(sources).collect()]
    total, near, n = None, None, nodes.count()
    for i in range(0, len(chosen), at_once):
        few = nodes.sparkSession.createDataFrame([(c,) for c in chosen[i : i + at_once]], "s long")
        level = stored(few.select("s", F.col("s").alias("v"), F.lit(1.0).alias("sigma")), "paths")
        levels, seen = [level], level.select("s", "v")
        while True:
            step = level.join(edges, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
            level = stored(step.join(seen, ["s", "v"], "left_anti"), "paths")
            if level.isEmpty():
                break
            levels.append(level)
            seen = reduce(DataFrame.unionAll, [x.select("s", "v") for x in levels])
        reach = reduce(DataFrame.unionAll, [x.groupBy("s").agg(F.count("*").alias("k"), F.sum(F.lit(d)).alias("far")) for d, x in enumerate(levels) if d] + [few.select("s", F.lit(0).alias("k"), F.lit(0).alias("far"))])
        reach = stored(reach.groupBy("s").agg(F.sum("k").alias("k"), F.sum("far").alias("far")), "reach")
        after, parts = None, []
        for x in reversed(levels):
            if after is None:
                here = x.select("s", "v", "sigma", F.lit(0.0).alias("delta"))
            else:
                w = after.select(F.col("s").alias("_s"), F.col("v").alias("_w"), ((1 + F.col("delta")) / F.col("sigma")).alias("part"))
                back = x.join(edges, F.col("v") == F.col("src")).join(w, (F.col("s") == F.col("_s")) & (F.col("dst") == F.col("_w"))).groupBy("s", "v").agg(F.sum("part").alias("part"))
                here = x.join(back, ["s", "v"], "left").select("s", "v", "sigma", (F.col("sigma") * F.coalesce("part", F.lit(0.0))).alias("delta"))
            after = stored(here, "dependencies")
            parts.append(after.where(F.col("v") != F.col("s")).select("v", "delta"))
        sums = reduce(DataFrame.unionAll, parts).groupBy("v").agg(F.sum("delta").alias("delta"))
        sums = sums if total is None else total.unionAll(sums).groupBy("v").agg(F.sum("delta").alias("delta"))
        before, total = total, stored(sums, "betweenness")
        near = reach if near is None else near.unionAll(reach)
        discard(before, *levels)
    near = near.select(F.col("s").alias("_s"), F.when(F.col("far") > 0, F.col("k") / F.col("far")).otherwise(0.0).alias("c"))
    out = nodes.select("id").join(total, F.col("id") == F.col("v"), "left").join(near, F.col("id") == F.col("_s"), "left")
    return out.select("id", F.round(F.coalesce("delta", F.lit(0.0)) * (n / len(chosen)), 6).alias("betweenness"), F.round("c", 6).alias("closeness"))


def suggestions(targets: DataFrame, sources: DataFrame, edges: DataFrame, vectors: DataFrame | None = None, max_in: int = 3, most_targets: int = 200, most_sources: int = 500, k: int = 50) -> DataFrame:
    """Links worth adding: targets (id, in_degree, page_rank, depth) by least in-degree, sources (id, page_rank, depth) by
    greatest rank, minus what is linked. Both sides are top lists, so the pairs are bounded. With vectors (id, v) pairs of
    cosine outside 0.3 to 0.85 drop out. Score of 20 or more stays."""
    t = targets.where(F.col("in_degree") <= max_in).orderBy("in_degree", F.desc("page_rank"), "id").limit(most_targets).select(F.col("id").alias("target"), "in_degree", "page_rank", F.col("depth").alias("t_depth"))
    s = sources.orderBy(F.desc("page_rank"), "id").limit(most_sources).select(F.col("id").alias("source"), F.col("page_rank").alias("s_rank"), F.col("depth").alias("s_depth"))
    p = t.crossJoin(F.broadcast(s)).where(F.col("source") != F.col("target")).join(edges, (F.col("source") == F.col("src")) & (F.col("target") == F.col("dst")), "left_anti")
    if vectors is not None:
        a, b = vectors.select(F.col("id").alias("_a"), F.col("v").alias("va")), vectors.select(F.col("id").alias("_b"), F.col("v").alias("vb"))
        p = p.join(a, F.col("target") == F.col("_a")).join(b, F.col("source") == F.col("_b")).withColumn("sim", cosine(F.col("va"), F.col("vb"))).where(F.col("sim").between(0.3, 0.85))
        near = F.when(F.col("sim").between(0.4, 0.75), F.col("sim") * 33).otherwise(F.col("sim") * 20)
    else:
        near = F.lit(0.0)
    gain = F.greatest(F.lit(0), F.coalesce(F.col("t_depth") - F.col("s_depth") - 1, F.lit(0)))
    score = near + F.greatest(F.lit(0), 25 - 5 * F.col("in_degree")) + F.least(F.lit(25.0), 2.5 * F.col("s_rank")) + F.least(F.lit(25), 8 * gain)
    why = reason(F.col("sim") if vectors is not None else None, F.col("in_degree"), F.col("t_depth"), gain, F.col("page_rank"))
    return p.withColumn("score", F.round(score, 1)).where(F.col("score") >= 20).select("source", "target", "score", "in_degree", why.alias("reason")).orderBy(F.desc("score"), "source", "target").limit(k)


def reason(similarity: Column | None, in_degree: Column, depth: Column, gain: Column, rank: Column) -> Column:
    """Why a link is suggested, in words."""
    known = F.when(F.round(similarity, 6) >= 0.4, F.concat(F.lit("related by topic ("), F.round(similarity * 100).cast("int").cast("string"), F.lit(" %)"))) if similarity is not None else F.lit(None).cast("string")
    few = F.when(in_degree == 1, "one link leads to the target").when(in_degree <= 3, F.concat(in_degree.cast("string"), F.lit(" links lead to the target")))
    parts = (known, few, F.when(gain >= 2, F.concat(gain.cast("string"), F.lit(" clicks nearer"))), F.when(depth > 3, F.concat(F.lit("target is "), depth.cast("string"), F.lit(" clicks deep"))), F.when(rank >= 5, F.concat(F.lit("target has rank "), F.format_number(rank, 1))))
    said = F.concat_ws("; ", *parts)
    return F.when(said == "", "worth a link").otherwise(said)

def cosine(a, b):
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def semantic_links(edges: DataFrame, vectors: DataFrame, weak: float = 0.15, strong: float = 0.6, k: int = 50) -> DataFrame:
    """The k least and the k most similar linked pairs, under ``weak`` and over ``strong``; vectors null or holding null have no links."""
    vectors = vectors.where(F.forall("v", F.isnotnull))
    a, b = vectors.select(F.col("id").alias("_a"), F.col("v").alias("va")), vectors.select(F.col("id").alias("_b"), F.col("v").alias("vb"))
    e = edges.join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b")).select("src", "dst", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("similarity"))
    low = e.where(F.col("similarity") < weak).orderBy("similarity", "src", "dst").limit(k).withColumn("kind", F.lit("weak"))
    return low.unionByName(e.where(F.col("similarity") > strong).orderBy(F.desc("similarity"), "src", "dst").limit(k).withColumn("kind", F.lit("strong")))


# --- what is drawn and listed --------------------------------------------------------------------------------------

#: Nodes that are drawn, edges beyond which they are sampled, and edges kept of a node then.
DRAWN_NODES, MANY_EDGES, KEPT_EDGES = 50_000, 5_000, 15


def attached(pages: DataFrame, scores: DataFrame, key: str = "k") -> DataFrame:
    """pages with the columns of scores (id, ..); pages without one have null."""
    return pages.join(scores.withColumnRenamed("id", "_id"), F.col(key) == F.col("_id"), "left").drop("_id")


def drawn_nodes(nodes: DataFrame, edges: DataFrame, most: int = DRAWN_NODES) -> DataFrame:
    """nodes (id, page_rank, ..) with degrees: the ``most`` of greatest rank, then in-degree, then least id."""
    d = degrees(nodes, edges).withColumnRenamed("id", "_i")
    return nodes.join(d, F.col("id") == F.col("_i")).drop("_i").orderBy(F.desc("page_rank"), F.desc("in_degree"), "id").limit(most)


def drawn_edges(edges: DataFrame, kept: DataFrame, many: int = MANY_EDGES, each: int = KEPT_EDGES) -> DataFrame:
    """Edges between kept (id) nodes; of a graph of over ``many`` edges the first ``each`` of every source, by target."""
    e = by_source(edges)
    if e.count() > many:
        e = e.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("_r") <= each).drop("_r")
    return e.join(kept.select(F.col("id").alias("_i")), F.col("src") == F.col("_i"), "left_semi").join(kept.select(F.col("id").alias("_j")), F.col("dst") == F.col("_j"), "left_semi")


def drawn_summary(nodes: DataFrame, edges: DataFrame, most: int = DRAWN_NODES, many: int = MANY_EDGES) -> DataFrame:
    """One row: nodes, edges, greatest depth and in-degree, whether nodes or edges are cut."""
    d = degrees(nodes, edges).agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.max("in_degree").alias("max_in_degree"))
    return d.crossJoin(nodes.agg(F.max("depth").alias("max_depth"))).select("nodes", "edges", "max_in_degree", "max_depth", (F.col("nodes") > most).alias("nodes_cut"), (F.col("edges") > many).alias("edges_cut"))  # one row each


def subgraph_nodes(nodes: DataFrame, edges: DataFrame, root: int, hops: int, cap: int = 500) -> DataFrame:
    """Nodes of a subgraph with their columns, hop, in-degree inside it, all their links out and whether more lies behind."""
    edges = by_source(edges)
    near = stored(subgraph(edges, root, hops, cap).withColumnRenamed("depth", "hop"), "subgraph")
    inner = subgraph_edges(edges, near).groupBy(F.col("dst").alias("_d")).agg(F.count("*").alias("in_degree"))
    out = edges.groupBy(F.col("src").alias("_s")).agg(F.count("*").alias("out_degree"))
    n = near.join(nodes.withColumnRenamed("id", "_n"), F.col("id") == F.col("_n"), "left").drop("_n")
    return n.join(inner, F.col("id") == F.col("_d"), "left").join(out, F.col("id") == F.col("_s"), "left").drop("_d", "_s").withColumns({"in_degree": F.coalesce("in_degree", F.lit(0)), "out_degree": F.coalesce("out_degree", F.lit(0))})


def subgraph_edges(edges: DataFrame, near: DataFrame) -> DataFrame:
    return edges.join(near.select(F.col("id").alias("_i")), F.col("src") == F.col("_i"), "left_semi").join(near.select(F.col("id").alias("_j")), F.col("dst") == F.col("_j"), "left_semi").select("src", "dst")


def raw_subgraph(links: DataFrame, root: str, hops: int, cap: int = 500) -> DataFrame:
    """url, hop, expandable of the urls within so many links of root, unresolved targets too: links (src, dst) are followed as they
    stand. The nearest ``cap``, then the least urls; a url whose own links were not read, or lead out, is expandable."""
    l = stored(links.select("src", "dst").distinct().repartition("src"), "raw-links")
    seen = links.sparkSession.createDataFrame([(root, 0)], "url string, hop int")
    front = seen
    for hop in range(1, hops + 1):
        step = front.join(l, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        front = stored(step.join(seen.select(F.col("url").alias("_u")), F.col("url") == F.col("_u"), "left_anti").withColumn("hop", F.lit(hop)), "raw-front")
        seen = seen.unionByName(front)
    seen = stored(seen.orderBy("hop", "url").limit(cap), "raw-seen")
    out = l.join(seen.select(F.col("url").alias("_u")), F.col("src") == F.col("_u"), "left_semi").join(seen.select(F.col("url").alias("_v")), F.col("dst") == F.col("_v"), "left_anti").select(F.col("src").alias("_o")).distinct()
    return seen.join(out, F.col("url") == F.col("_o"), "left").select("url", "hop", (F.col("_o").isNotNull() | (F.col("hop") == hops)).alias("expandable"))


def search(nodes: DataFrame, text: str, k: int = 20) -> DataFrame:
    """Nodes (url, title, ..) whose url or title holds the text, letter case aside; the first k by id."""
    low = F.lit(text.lower())
    return nodes.where(F.contains(F.lower("url"), low) | F.contains(F.lower(F.coalesce("title", F.lit(""))), low)).orderBy("id").limit(k)


def leaders(scores: DataFrame, columns: dict[str, str], k: int = 20) -> DataFrame:
    """kind, id, score: the k highest of each column of scores (id, ..), as of authorities, hubs and bridges."""
    tops = [scores.select(F.lit(kind).alias("kind"), "id", F.col(c).alias("score")).orderBy(F.desc("score"), "id").limit(k) for kind, c in columns.items()]
    return reduce(DataFrame.unionByName, tops)


def home(pages: DataFrame, url: str) -> DataFrame:
    """One row, the page (k, url, depth) that stands for the home url: the url itself, with or without a closing slash, with or without
    ``www.``, else the least page of depth 0."""
    slash = lambda u: u[:-1] if u.endswith("/") else u + "/"
    head, _, rest = url.partition("://")
    other = f"{head}://{rest[4:] if rest.startswith('www.') else 'www.' + rest}"
    ranks = {u: i for i, u in reversed(list(enumerate((url, slash(url), other, slash(other)))))}
    rank = F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*[x for u, i in ranks.items() for x in (F.lit(u), F.lit(i))]), lambda u, _: u == F.col("url"))), 0), F.when(F.col("depth") == 0, 4))
    return pages.withColumn("_rank", rank).where(F.col("_rank").isNotNull()).orderBy("_rank", "k").limit(1).drop("_rank")


#: Pages beyond which HITS is left out, beyond which it makes fewer rounds, and those rounds.
HITS_MOST, HITS_FEWER, HITS_ROUNDS = 200_000, 100_000, 30


def intelligence(pages: DataFrame, links: DataFrame, seed: str, centrality: bool = True) -> dict[str, DataFrame | None]:
    """All link measures of pages (k, url, final_url, depth, status_code, page_rank) and links, phase by phase: edges, home, depths,
    near orphans, dilution, HITS (none beyond HITS_MOST pages, fewer rounds beyond HITS_FEWER), centralities, leaders,
    suggestions. A phase that is left out is None."""
    nodes, edges = pages.select(F.col("k").alias("id")), by_source(build(pages, links))
    n, root = nodes.count(), home(pages, seed).first()
    depths = click_depths(edges, root.k) if root else None
    ok = pages.where(F.col("status_code") == 200).select(F.col("k").alias("id"))
    both = stored(hits(nodes, edges, HITS_ROUNDS if n > HITS_FEWER else 100, 1e-6), "intelligence") if n <= HITS_MOST else None
    central = stored(centralities(nodes, edges), "intelligence") if centrality else None
    d = degrees(nodes, edges).join(pages.select(F.col("k").alias("_k"), "page_rank", "depth"), F.col("id") == F.col("_k")).drop("_k")
    tops = [leaders(both, {"authority": "authority", "hub": "hub"})] if both is not None else []
    tops += [leaders(central, {"bridge": "betweenness"})] if central is not None else []
    return {"edges": edges, "depths": depths, "near_orphans": near_orphans(edges, ok, depths) if depths is not None else None, "dilution": dilution(edges), "hits": both, "centralities": central, "leaders": reduce(DataFrame.unionByName, tops) if tops else None, "suggestions": suggestions(d, d, edges, k=20)}
