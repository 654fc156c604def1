"""Link-graph, vector and fingerprint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checkpoints import stored
from ..operators import graph as G
from ..operators import simhash as S
from ..tables import table
from . import adapters as A
from .registry import query

_EDGES = A.PAGES_SQL + """, l AS (SELECT DISTINCT src, dst FROM links WHERE internal), own AS (SELECT url, min(k) AS k FROM p GROUP BY 1), fin AS (SELECT final_url AS url, min(k) AS k FROM p WHERE final_url <> url GROUP BY 1), sl AS (SELECT t, min(k) AS k FROM p GROUP BY 1),
edges AS (SELECT DISTINCT src, dst FROM (SELECT s.k AS src, coalesce(o.k, f.k, x.k) AS dst FROM l JOIN own s ON s.url = l.src LEFT JOIN own o ON o.url = l.dst LEFT JOIN fin f ON f.url = l.dst LEFT JOIN sl x ON x.t = rtrim(l.dst, '/')) WHERE src <> dst AND dst IS NOT NULL)
"""
HOME = 1


def _graph(spark, sf_dir):
    p = A.pages(spark, sf_dir)
    return p.select(F.col("k").alias("id")), G.build(p, A.links(spark, sf_dir))


@query(_EDGES + "SELECT src, dst FROM edges")
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@query(_EDGES + "SELECT k AS id, (SELECT count(*) FROM edges WHERE src = k) AS out_degree, (SELECT count(*) FROM edges WHERE dst = k) AS in_degree FROM p")
def graph_degrees(spark, sf_dir):
    return G.degrees(*_graph(spark, sf_dir))


_RANK = _EDGES.replace("WITH", "WITH RECURSIVE", 1) + ", n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM p), dg AS (SELECT src, count(*) AS d FROM edges GROUP BY 1), r0 AS (SELECT k AS id, 1 / n AS r FROM p, n)" + "".join(f", r{i} AS (SELECT k AS id, 0.15 / n + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM dg)) / n + 0.85 * coalesce(g, 0) AS r FROM p CROSS JOIN n LEFT JOIN (SELECT dst, sum(r / d) AS g FROM edges JOIN dg USING (src) JOIN r{i - 1} ON id = src GROUP BY 1) ON dst = k)" for i in range(1, 4))


@query(_RANK + " SELECT id, round(r / (SELECT max(r) FROM r3) * 10, 2) AS score FROM r3")
def graph_pagerank_three_rounds(spark, sf_dir):
    return G.pagerank(*_graph(spark, sf_dir), rounds=3, epsilon=0.0)


_HITS = _EDGES + ", v0 AS (SELECT k AS id, 1.0::DOUBLE AS a, 1.0::DOUBLE AS h FROM p)" + "".join(f", w{i} AS (SELECT id, coalesce((SELECT sum(y.h) FROM edges e JOIN v{i - 1} y ON y.id = e.src WHERE e.dst = v.id), 0) AS a, coalesce((SELECT sum(y.a) FROM edges e JOIN v{i - 1} y ON y.id = e.dst WHERE e.src = v.id), 0) AS h FROM v{i - 1} v), v{i} AS (SELECT id, a / (SELECT sqrt(sum(a * a)) FROM w{i}) AS a, h / (SELECT sqrt(sum(h * h)) FROM w{i}) AS h FROM w{i})" for i in range(1, 3))


@query(_HITS + " SELECT id, round(a / (SELECT max(a) FROM v2) * 10, 2) AS authority, round(h / (SELECT max(h) FROM v2) * 10, 2) AS hub FROM v2")
def graph_hits_two_rounds(spark, sf_dir):
    return G.hits(*_graph(spark, sf_dir), rounds=2, epsilon=0.0)


_DEPTH = _EDGES.replace("WITH", "WITH RECURSIVE", 1) + f", b AS (SELECT CAST({HOME} AS BIGINT) AS id, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN edges e ON e.src = b.id WHERE b.depth < 12), z AS (SELECT id, min(depth) AS depth FROM b GROUP BY 1) "


@query(_DEPTH + "SELECT id, CAST(depth AS INTEGER) AS depth FROM z")
def graph_click_depths(spark, sf_dir):
    return G.click_depths(_graph(spark, sf_dir)[1], HOME, 12)


@query(_DEPTH + "SELECT dst AS id, count(*) AS in_degree, CASE WHEN max(coalesce(depth, 999)) <> 999 THEN CAST(max(coalesce(depth, 999)) AS INTEGER) END AS worst_depth FROM edges LEFT JOIN z ON z.id = src WHERE dst IN (SELECT k FROM p WHERE status_code = 200) GROUP BY 1 HAVING count(*) <= 25 AND max(coalesce(depth, 999)) >= 2")
def graph_near_orphans(spark, sf_dir):
    p = A.pages(spark, sf_dir)
    edges = _graph(spark, sf_dir)[1]
    return G.near_orphans(edges, p.where("status_code = 200").select(F.col("k").alias("id")), G.click_depths(edges, HOME, 12), most=25, deep=2)


@query("WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem) SELECT src AS id, count(*) AS out_degree, round(1 / log2(count(*) + 1), 6) AS equity, CASE WHEN round(1 / log2(count(*) + 1), 6) < 0.13 THEN 'excessive' WHEN round(1 / log2(count(*) + 1), 6) < 0.15 THEN 'high' WHEN round(1 / log2(count(*) + 1), 6) < 0.18 THEN 'moderate' ELSE 'none' END AS warning FROM e GROUP BY 1 HAVING count(*) >= 20")
def graph_dilution(spark, sf_dir):
    return G.dilution(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct())


query(None, "graph_centralities")(lambda spark, sf_dir: G.centralities(*_graph(spark, sf_dir)))
_RANKS = _RANK[: _RANK.index(", r1 AS")].replace("r0 AS (", "r0 AS MATERIALIZED (").replace("dg AS (", "dg AS MATERIALIZED (").replace("edges AS (", "edges AS MATERIALIZED (") + "".join(f", r{i} AS MATERIALIZED (SELECT k AS id, 0.15 / n + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM dg)) / n + 0.85 * coalesce(g, 0) AS r FROM p CROSS JOIN n LEFT JOIN (SELECT dst, sum(r / d) AS g FROM edges JOIN dg USING (src) JOIN r{i - 1} ON id = src GROUP BY 1) ON dst = k)" for i in range(1, 13))
query(_RANKS + " SELECT id, round(r / (SELECT max(r) FROM r12) * 10, 2) AS score FROM r12", "graph_pagerank")(lambda spark, sf_dir: G.pagerank(*_graph(spark, sf_dir), rounds=12, epsilon=0.0))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


@query("""WITH e AS (SELECT DISTINCT vec_id AS src, (vec_id * 7 + 3) % 500 AS dst FROM embeddings WHERE vec_id < 500), s AS (SELECT src, dst, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM e JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst)
(SELECT src, dst, similarity, 'weak' AS kind FROM s WHERE similarity < 0.15 ORDER BY similarity, src, dst LIMIT 50) UNION ALL (SELECT src, dst, similarity, 'strong' AS kind FROM s WHERE similarity > 0.6 ORDER BY similarity DESC, src, dst LIMIT 50)""")
def vector_semantic_links(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    n = v.agg(F.count("*").alias("_n"))  # one row
    return G.semantic_links(v.crossJoin(F.broadcast(n)).select(F.col("id").alias("src"), ((F.col("id") * 7 + 3) % F.col("_n")).alias("dst")).distinct(), v)


_PRINTS = r"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\s\x{85}\x{a0}]+'), lambda w: w <> '') AS w FROM documents WHERE len(regexp_split_to_array(trim(text), '\s+')) >= 30),
g AS (SELECT doc_id, ('0x' || left(md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), 16))::UBIGINT AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
b AS (SELECT doc_id, i, 2 * sum((n >> ((7 - i // 8) * 8 + i % 8)) & 1) > count(*) AS up FROM g, (SELECT unnest(range(64)) AS i) GROUP BY 1, 2),
f AS MATERIALIZED (SELECT doc_id AS id, CAST(u - CASE WHEN u >= 9223372036854775808 THEN 18446744073709551616::HUGEINT ELSE 0 END AS BIGINT) AS f FROM (SELECT doc_id, sum(CASE WHEN up THEN (1::HUGEINT << i) ELSE 0 END) AS u FROM b GROUP BY 1)),
q AS MATERIALIZED (SELECT a.f AS a, b.f AS b, bit_count(xor(a.f, b.f)) AS d FROM (SELECT DISTINCT f FROM f) a JOIN (SELECT DISTINCT f FROM f) b ON a.f < b.f AND bit_count(xor(a.f, b.f)) <= 6)
"""


@query(_PRINTS + "SELECT a, b, CAST(d AS INTEGER) AS distance, (64 - CAST(d AS BIGINT)) * 100 // 64 AS similarity FROM q")
def near_duplicate_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return S.near_pairs(S.fingerprints(docs))


@query(_PRINTS + ", e AS (SELECT a, b FROM q UNION SELECT b, a FROM q), r AS (SELECT DISTINCT f, f AS g FROM f UNION SELECT r.f, e.b FROM r JOIN e ON e.a = r.g) SELECT f.id, (SELECT min(g) FROM r WHERE r.f = f.f) AS group_id FROM f")
def near_duplicate_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    prints = stored(S.fingerprints(docs), "prints")  # texts are read and hashed once
    groups = G.components(S.near_pairs(prints).select("a", "b"))
    return prints.join(groups.withColumnRenamed("id", "_f").hint("merge"), F.col("fingerprint") == F.col("_f"), "left").select("id", F.coalesce("root", "fingerprint").alias("group_id"))


@query(None)
def near_duplicate_greedy(spark, sf_dir):
    return S.greedy_groups(S.fingerprints(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")))
