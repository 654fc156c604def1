"""Queries over metric joins and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..tables import table
from . import adapters as A
from .registry import query

_DAILY = {"url": "'https://e.example/' || CAST(user_id % 40 AS STRING)", "day": "CAST(ts AS DATE)", "impressions": "event_id % 50", "clicks": "event_id % 50 % 7", "sum_position": "CAST(event_id % 50 * (event_id % 9) AS DOUBLE)", "query": "event_type || ' ' || CAST(user_id % 25 AS STRING)", "position": "CAST(event_id % 64 AS DOUBLE) / 4"}
_SEEN = "WITH d AS (SELECT " + ", ".join(f"{x} AS {c}" for c, x in _DAILY.items()) + " FROM events) "


def _daily(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*[f"{x} AS {c}" for c, x in _DAILY.items()])


query(_SEEN + "SELECT url, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, round(coalesce(sum(clicks) / nullif(sum(impressions), 0), 0), 6) AS ctr, round(sum(sum_position) / nullif(sum(impressions), 0), 6) AS position FROM d WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1", "metric_rollup")(lambda spark, sf_dir: M.search_rollup(_daily(spark, sf_dir), "2024-01-05", "2024-01-20"))
query(_SEEN + "SELECT url, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, count(*) AS queries, round(coalesce(sum(clicks) / nullif(sum(impressions), 0), 0), 6) AS ctr FROM d GROUP BY 1 ORDER BY clicks DESC, url LIMIT 50", "ai_pages")(lambda spark, sf_dir: M.ai_pages(_daily(spark, sf_dir)))
query(_SEEN + "SELECT query, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, round(sum(position * impressions) / nullif(sum(impressions), 0), 6) AS position, round(coalesce(sum(clicks) / nullif(sum(impressions), 0), 0), 6) AS ctr FROM d GROUP BY 1 ORDER BY clicks DESC, query LIMIT 50", "ai_queries")(lambda spark, sf_dir: M.ai_queries(_daily(spark, sf_dir)))
query(A.PAGES_SQL + ", m AS (SELECT rtrim(lower(url), '/') AS key, sum(k) AS m_k FROM p WHERE k % 3 = 0 GROUP BY 1) SELECT url, CAST(m_k AS BIGINT) AS m_k FROM p LEFT JOIN m ON key = rtrim(lower(url), '/')", "metric_enrichment")(lambda spark, sf_dir: M.enriched(A.pages(spark, sf_dir), A.pages(spark, sf_dir).where("k % 3 = 0").select("url", "k"), ["k"]).select("url", "m_k"))
query(A.PAGES_SQL + "SELECT count(*) AS pages, round(avg(richness), 6) AS mean, count(*) FILTER (richness < 0.2) AS low, count(*) FILTER (richness > 0.7) AS high FROM p WHERE status_code = 200", "page_richness")(lambda spark, sf_dir: M.score_summary(A.pages(spark, sf_dir), "richness", 0.2, 0.7))
query("SELECT count(DISTINCT CASE WHEN s_suppkey % 3 > 0 THEN s_name END) AS authors, round(count(*) FILTER (s_suppkey % 3 > 0) * 100 / count(*), 4) AS author_coverage, bool_or(s_suppkey % 7 = 0) AS about, bool_or(s_suppkey % 5 = 0) AS contact, CAST(sum(s_suppkey % 4) AS BIGINT) AS citations FROM supplier", "page_trust")(lambda spark, sf_dir: M.trust_summary(table(spark, sf_dir, "supplier").selectExpr("CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS author", "s_suppkey % 7 = 0 AS has_about", "s_suppkey % 5 = 0 AS has_contact", "s_suppkey % 4 AS citations")))


_TERMS = "list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: length(x) >= 2)"
_SHARE = lambda x: f"round(coalesce(len(list_filter({x}, lambda y: list_contains(bs, y))) / nullif(len({x}), 0), 0), 3)"
_ALIKE = lambda x, y: f"round(coalesce(len(list_intersect({x}, {y})) / nullif(len(list_distinct(list_concat({x}, {y}))), 0), 0), 3)"
_TOPICS = f"""WITH d AS (SELECT doc_id, text, array_to_string(string_split(text, ' ')[1:6], ' ') AS title, array_to_string(string_split(text, ' ')[4:9], ' ') AS h1 FROM documents),
t AS (SELECT doc_id, {_TERMS.format(t='title')} AS ts, {_TERMS.format(t='h1')} AS hs, list_distinct({_TERMS.format(t='text')}) AS bs FROM d WHERE title <> '' AND len(list_filter(regexp_split_to_array(text, '[\\s\\x{{85}}\\x{{a0}}]+'), lambda w: w <> '')) >= 30),
m AS (SELECT CAST(doc_id AS VARCHAR) AS url, {_SHARE('ts')} AS title_body, {_ALIKE('ts', 'hs')} AS title_h1, {_SHARE('list_distinct(ts)')} AS heading_body, {_ALIKE('ts', 'ts')} AS anchor_title FROM t),
f AS (SELECT *, round(0.3::DOUBLE * title_body + 0.2::DOUBLE * title_h1 + 0.2::DOUBLE * heading_body, 3) AS body_only, round(0.3::DOUBLE * title_body + 0.2::DOUBLE * title_h1 + 0.2::DOUBLE * heading_body + 0.3::DOUBLE * anchor_title, 3) AS consistency FROM m) """


def _topics(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    first = F.array_join(F.slice(F.split("text", " "), 1, 6), " ")
    return M.topicality(d.select(F.col("doc_id").cast("string").alias("url"), first.alias("title"), F.array_join(F.slice(F.split("text", " "), 4, 6), " ").alias("h1"), first.alias("headings"), F.col("text").alias("body"), first.alias("anchor")))


query(_TOPICS + "SELECT * FROM f", "page_topicality")(_topics)
query(_TOPICS + "SELECT count(*) AS pages, round(avg(title_body), 6) AS title_body, round(avg(title_h1), 6) AS title_h1, round(avg(consistency), 6) AS consistency, count(*) FILTER (consistency < 0.3) AS low, count(*) FILTER (consistency >= 0.9) AS full FROM f", "report_topicality")(lambda spark, sf_dir: M.topicality_summary(_topics(spark, sf_dir)))


@query(_TOPICS + """, w AS (SELECT f.*, CAST(url AS BIGINT) AS id FROM f), g AS (SELECT id, ts FROM (SELECT doc_id AS id, ts FROM t)), n AS (SELECT a.id, round(avg(len(list_filter(b.ts, lambda y: list_contains(a.ts, y))) / len(b.ts)), 3) AS r FROM g a JOIN g b ON b.id = a.id OR b.id = a.id + 1 WHERE len(a.ts) > 0 AND len(b.ts) > 0 GROUP BY 1)
SELECT url, coalesce(r, anchor_title) AS anchor_title, CASE WHEN r IS NULL THEN consistency ELSE round(0.3::DOUBLE * title_body + 0.2::DOUBLE * title_h1 + 0.2::DOUBLE * heading_body + 0.3::DOUBLE * r, 3) END AS consistency FROM w LEFT JOIN n ON n.id = w.id""")
def page_topicality_anchors(spark, sf_dir):
    """Each page is linked to by itself and by the page of the next id, with their titles as link texts."""
    t = _topics(spark, sf_dir)
    d = table(spark, sf_dir, "documents").where(F.size(T.fields(F.col("text"))) >= 30)
    title = F.array_join(F.slice(F.split("text", " "), 1, 6), " ")
    titles = d.select(F.col("doc_id").cast("string").alias("url"), title.alias("title")).where("title <> ''")
    said = d.select(F.explode(F.array(F.col("doc_id").cast("string"), (F.col("doc_id") - 1).cast("string"))).alias("href"), title.alias("text")).where("text <> ''")
    return M.with_anchors(t, titles, said).select("url", "anchor_title", "consistency")


_LANG = "WITH h AS (SELECT 'https://e.example/' || CAST(o_orderkey AS VARCHAR) AS url, CASE o_orderkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'x-default' ELSE 'de' END AS lang, 'https://e.example/' || CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE o_orderkey * 7 % 9000 END AS VARCHAR) AS href FROM orders UNION ALL SELECT 'https://e.example/' || CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 5 = 0 THEN 'x-default' ELSE 'it' END, 'https://e.example/' || CAST(o_orderkey + o_orderkey % 2 AS VARCHAR) FROM orders) "


@query(_LANG + "SELECT DISTINCT url, 'missing-self' AS issue FROM h GROUP BY url HAVING NOT bool_or(href = url) UNION SELECT url, 'missing-x-default' FROM h GROUP BY url HAVING NOT bool_or(lang = 'x-default') UNION SELECT a.url, 'missing-return-link' FROM h a WHERE a.href <> a.url AND a.href IN (SELECT url FROM h) AND NOT EXISTS (SELECT 1 FROM h b WHERE b.url = a.href AND b.href = a.url)")
def hreflang_issues(spark, sf_dir):
    o, u = table(spark, sf_dir, "orders"), "'https://e.example/' || CAST({} AS STRING) AS {}"
    h = o.selectExpr(u.format("o_orderkey", "url"), "CASE o_orderkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'x-default' ELSE 'de' END AS lang", u.format("CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE o_orderkey * 7 % 9000 END", "href"))
    h = h.unionByName(o.selectExpr(u.format("o_orderkey", "url"), "CASE WHEN o_orderkey % 5 = 0 THEN 'x-default' ELSE 'it' END AS lang", u.format("o_orderkey + o_orderkey % 2", "href")))
    return M.hreflang_issues(h)


query(A.HITS_SQL + ", x AS (SELECT method, response_time, row_number() OVER (PARTITION BY method ORDER BY ts DESC, seq DESC) AS r, count(*) OVER (PARTITION BY method) AS n FROM hits) SELECT method, round(sum(CASE WHEN r = n THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, r - 1) END * response_time), 6) AS ema, count(*) AS hits FROM x GROUP BY 1", "log_response_ema")(lambda spark, sf_dir: M.response_ema(A.hits(spark, sf_dir), "method"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.4 ORDER BY similarity DESC, a, b LIMIT 100", "vector_similar_pairs")(lambda spark, sf_dir: M.similar_pairs(_vectors(spark, sf_dir), 0.4))
_GROUPS = """WITH RECURSIVE v AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id), q AS MATERIALIZED (SELECT * FROM v WHERE s >= 0.45), e AS (SELECT a, b FROM q UNION SELECT b, a FROM q),
r AS (SELECT DISTINCT a AS f, a AS g FROM e UNION SELECT r.f, e.b FROM r JOIN e ON e.a = r.g), c AS (SELECT f, min(g) AS root FROM r GROUP BY 1), n AS (SELECT root, count(*) AS size FROM c GROUP BY 1)
SELECT root AS group_id, size, round((SELECT sum(s) FROM q JOIN c ON c.f = q.a WHERE c.root = n.root) / (size * (size - 1) / 2), 4) AS mean_similarity FROM n ORDER BY size DESC, group_id LIMIT 50"""
query(_GROUPS, "vector_similar_groups")(lambda spark, sf_dir: M.similar_groups(M.similar_pairs(_vectors(spark, sf_dir), 0.45, None)))
