"""Crawl-report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as P
from . import adapters as A
from .registry import query


def _on(name: str, fn, sql: str | None) -> None:
    """fn takes pages, or pages and links by its number of arguments."""
    both = fn.__code__.co_argcount == 2
    query(A.PAGES_SQL + sql if sql else None, name)(lambda spark, sf_dir: fn(A.pages(spark, sf_dir), A.links(spark, sf_dir)) if both else fn(A.pages(spark, sf_dir)))


LIVE = "NOT robots_blocked"
GENERIC = "(" + ", ".join(f"'{g}'" for g in P.GENERIC_ANCHORS) + ")"

_on("page_indexability", lambda p: P.indexability(p).groupBy("reason").agg(F.count("*").alias("pages")), "SELECT reason, count(*) AS pages FROM p GROUP BY 1")
_on("page_classification", lambda p: P.classified(p).groupBy("classification").agg(F.count("*").alias("pages")), "SELECT classification, count(*) AS pages FROM p GROUP BY 1")
_on("page_counters", lambda p: P.counters(p), f"""SELECT count(*) AS pages, count(*) FILTER (robots_blocked) AS blocked,
count(*) FILTER ({LIVE} AND coalesce(title, '') = '') AS no_title, count(*) FILTER ({LIVE} AND coalesce(description, '') = '') AS no_description, count(*) FILTER ({LIVE} AND h1_count = 0) AS no_h1, count(*) FILTER ({LIVE} AND h1_count > 1) AS many_h1,
count(*) FILTER ({LIVE} AND length(title) > 60) AS long_titles, count(*) FILTER ({LIVE} AND length(title) BETWEEN 1 AND 29) AS short_titles, count(*) FILTER ({LIVE} AND length(description) > 160) AS long_descriptions,
count(*) FILTER ({LIVE} AND status_code >= 400) AS broken, count(*) FILTER ({LIVE} AND NOT starts_with(url, 'https://')) AS not_https, count(*) FILTER ({LIVE} AND mixed_content) AS mixed, count(*) FILTER ({LIVE} AND status_code = 200 AND word_count > 0 AND word_count < 200) AS thin, count(*) FILTER ({LIVE} AND has_schema) AS with_schema,
CAST(sum(CASE WHEN {LIVE} THEN images ELSE 0 END) AS BIGINT) AS images, CAST(sum(CASE WHEN {LIVE} THEN images_missing_alt ELSE 0 END) AS BIGINT) AS images_missing_alt FROM p""")
_on("page_status_histogram", lambda p: P.histogram(p, "status_code"), "SELECT status_code, count(*) AS pages FROM p GROUP BY 1")
_on("page_depth_histogram", lambda p: P.histogram(p, "depth"), "SELECT depth, count(*) AS pages FROM p GROUP BY 1")
_on("page_templates", lambda p: P.histogram(p, "template"), "SELECT template, count(*) AS pages FROM p GROUP BY 1")
_on("page_word_buckets", lambda p: P.bucketed(p, "word_count", [0, 100, 300, 500, 1000, 2000]), "SELECT CAST(CASE WHEN word_count >= 2000 THEN 2000 WHEN word_count >= 1000 THEN 1000 WHEN word_count >= 500 THEN 500 WHEN word_count >= 300 THEN 300 WHEN word_count >= 100 THEN 100 ELSE 0 END AS BIGINT) AS bucket, count(*) AS pages FROM p GROUP BY 1")
_on("page_rank_buckets", lambda p: P.bucketed(p, "page_rank", [0, 1, 3, 5, 10]), "SELECT CAST(CASE WHEN page_rank >= 10 THEN 10 WHEN page_rank >= 5 THEN 5 WHEN page_rank >= 3 THEN 3 WHEN page_rank >= 1 THEN 1 ELSE 0 END AS BIGINT) AS bucket, count(*) AS pages FROM p GROUP BY 1")
_on("page_response_times", lambda p: P.response_times(p), f"SELECT round(quantile_cont(response_ms, 0.5), 4) AS p50, round(quantile_cont(response_ms, 0.9), 4) AS p90, round(quantile_cont(response_ms, 0.99), 4) AS p99, count(*) FILTER (response_ms < 500) AS fast, count(*) FILTER (response_ms >= 500 AND response_ms < 1000) AS medium, count(*) FILTER (response_ms >= 1000 AND response_ms < 2000) AS slow, count(*) FILTER (response_ms >= 2000) AS slowest FROM p WHERE {LIVE}")
for _column in ("title", "description"):
    _sql = f"SELECT {_column} AS value, count(*) AS pages FROM p WHERE status_code = 200 AND coalesce({_column}, '') <> '' GROUP BY 1 HAVING count(*) > 1"
    query(A.PAGES_SQL + _sql, f"page_duplicate_{_column}s")(lambda spark, sf_dir, c=_column: P.duplicates(A.pages(spark, sf_dir), c))
_on("page_duplicate_content", lambda p: P.duplicate_groups(p), "SELECT content_hash, count(*) AS pages, string_agg(url, '|' ORDER BY url) FILTER (r <= 10) AS urls FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY url) AS r FROM p WHERE status_code = 200) GROUP BY 1 HAVING count(*) > 1")
_on("page_originality", lambda p: P.originality(p), "SELECT url, CASE WHEN n <= 1 THEN 127 WHEN n = 2 THEN 80 WHEN n <= 5 THEN 40 ELSE 10 END AS score FROM (SELECT url, count(*) OVER (PARTITION BY content_hash) AS n FROM p WHERE status_code = 200)")
_on("page_slowest", lambda p: P.top(p.select("url", "response_ms"), "response_ms", 50), "SELECT url, response_ms FROM p ORDER BY response_ms DESC, url LIMIT 50")
_on("page_thinnest", lambda p: P.top(p.where("status_code = 200 and word_count > 0 and word_count < 200").select("url", "word_count"), "word_count", 50, descending=False), "SELECT url, word_count FROM p WHERE status_code = 200 AND word_count > 0 AND word_count < 200 ORDER BY word_count, url LIMIT 50")
_on("page_heaviest", lambda p: P.top(p.where("status_code = 200 and bytes is not null").select("url", "bytes"), "bytes", 20), "SELECT url, bytes FROM p WHERE status_code = 200 AND bytes IS NOT NULL ORDER BY bytes DESC, url LIMIT 20")
_on("page_weights", lambda p: P.weights(p), "SELECT CAST(sum(bytes) // count(*) AS BIGINT) AS mean_bytes, count(*) FILTER (bytes > 3145728) AS oversized, count(*) FILTER (body_bytes > 2097152) AS truncation_risk FROM p WHERE status_code = 200 AND bytes IS NOT NULL")
_on("page_readability", lambda p: P.readability(p), """SELECT round(avg(readability), 4) AS mean, count(*) FILTER (readability < 30) AS difficult, count(*) FILTER (readability > 80) AS very_easy, count(*) FILTER (q >= 70) AS tier1, count(*) FILTER (q >= 40 AND q < 70) AS tier2, count(*) FILTER (q < 40) AS tier3
FROM (SELECT *, CASE WHEN readability BETWEEN 4 AND 14 THEN 35 WHEN readability < 4 THEN 25 ELSE 0 END + CASE WHEN word_count >= 300 THEN 25 WHEN word_count >= 100 THEN 15 ELSE 0 END + CASE WHEN richness >= 0.3 THEN 20 ELSE 0 END + CASE WHEN h2_count >= 2 THEN 20 WHEN h1_count > 0 THEN 10 ELSE 0 END AS q FROM p WHERE status_code = 200 AND readability IS NOT NULL)""")
_on("page_text_to_code", lambda p: P.text_to_code(p), "SELECT round(avg(text_ratio), 6) AS mean, count(*) FILTER (text_ratio < 0.1) AS poor FROM p WHERE status_code = 200 AND text_ratio > 0")
_on("page_images", lambda p: P.image_audit(p), f"SELECT CAST(sum(images) AS BIGINT) AS images, CAST(sum(images_missing_alt) AS BIGINT) AS missing_alt, round(sum(images_missing_alt) / sum(images), 6) AS share FROM p WHERE {LIVE}")
_on("page_vitals", lambda p: P.vitals(p), "SELECT " + ", ".join(f"round(avg({c}), 4) AS {c}_mean, count(*) FILTER ({c} <= {g}) AS {c}_good, count(*) FILTER ({c} > {b}) AS {c}_poor" for c, g, b in (("lcp", 2500, 4000), ("inp", 200, 500), ("cls", 0.1, 0.25))) + " FROM p")
_on("page_vital_classes", lambda p: p.groupBy(P.vital_class(F.col("lcp"), 2500, 4000).alias("assessment")).agg(F.count("*").alias("pages")), "SELECT CASE WHEN lcp <= 2500 THEN 'good' WHEN lcp <= 4000 THEN 'needs-improvement' ELSE 'poor' END AS assessment, count(*) AS pages FROM p GROUP BY 1")
_on("page_search_totals", lambda p: P.search_totals(p), "SELECT count(*) AS pages, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, round(sum(clicks) / sum(impressions), 6) AS ctr, round(avg(position), 6) AS position, count(*) FILTER (impressions > 0 AND clicks = 0) AS zombies FROM p WHERE impressions IS NOT NULL")
_on("page_session_totals", lambda p: P.sessions_totals(p), "SELECT count(*) AS pages, CAST(sum(sessions) AS BIGINT) AS sessions, count(*) FILTER (sessions = 0) AS no_traffic, CAST(sum(coalesce(visitors, 0)) AS BIGINT) AS visitors FROM p WHERE sessions IS NOT NULL")
_FUNNEL = "count(*) AS crawled, count(*) FILTER (status_code BETWEEN 200 AND 299) AS renderable, count(*) FILTER (classification IN ('indexable', 'visible', 'active')) AS indexable, count(*) FILTER (classification {v}) AS visible, count(*) FILTER (classification = 'active') AS active, count(*) FILTER (classification = 'non-indexable') AS non_indexable, round(count(*) FILTER (classification IN ('visible', 'active')) * 100 / count(*), 6) AS pct_visible, round(count(*) FILTER (classification = 'active') * 100 / count(*), 6) AS pct_active, round(count(*) FILTER (classification IN ('indexable', 'visible', 'active')) * 100 / count(*), 6) AS pct_indexable"
_on("page_funnel", lambda p: P.funnel(p), "SELECT " + _FUNNEL.format(v="= 'visible'") + f" FROM p WHERE {LIVE}")
_on("page_funnel_by_template", lambda p: P.funnel(p, "template"), "SELECT template, " + _FUNNEL.format(v="IN ('visible', 'active')") + f" FROM p WHERE {LIVE} GROUP BY 1")
_on("page_freshness", lambda p: P.freshness(p), "SELECT CASE WHEN age_days IS NULL THEN 'undated' WHEN age_days <= 30 THEN '30' WHEN age_days <= 90 THEN '90' WHEN age_days <= 365 THEN '365' WHEN age_days <= 730 THEN '730' ELSE 'older' END AS bucket, count(*) AS pages FROM p GROUP BY 1")
_H = r"regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)"
_S = r"regexp_extract({x}, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)"
_on("page_canonicals", lambda p: P.canonicals(p), f"""SELECT count(*) FILTER (h) AS with_canonical, count(*) FILTER (NOT h) AS without, count(*) FILTER (h AND canonical_count > 1) AS multiple, count(*) FILTER (h AND own) AS self_referencing, count(*) FILTER (h AND NOT own) AS canonicalized, count(*) FILTER (h AND s <> 200) AS to_non_200, count(*) FILTER (h AND NOT i) AS to_non_indexable, count(*) FILTER (h AND {_H.format(x='url')} <> {_H.format(x='c')}) AS cross_domain, count(*) FILTER (h AND {_S.format(x='url')} <> {_S.format(x='c')}) AS scheme_mismatch, count(*) FILTER (h AND contains(c, '?')) AS with_query
FROM (SELECT p.*, coalesce(p.canonical, '') AS c, coalesce(p.canonical, '') <> '' AS h, rtrim(coalesce(p.canonical, ''), '/') IN (p.t, rtrim(p.final_url, '/')) AS own, q.status_code AS s, q.indexable AS i FROM p LEFT JOIN p q ON q.url = p.canonical WHERE NOT p.robots_blocked AND p.status_code = 200)""")
_on("page_canonical_targets", lambda p: P.canonical_targets(p), f"SELECT canonical AS url, count(*) AS pages FROM p WHERE {LIVE} AND status_code = 200 AND coalesce(canonical, '') <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
_on("page_canonical_chains", lambda p: P.canonical_chains(p), """, s AS (SELECT url AS u, canonical AS c FROM p WHERE coalesce(canonical, '') <> '' AND canonical <> url),
w1 AS (SELECT u AS url, c AS tail, 1 AS n, false AS l FROM s)""" + "".join(f", w{i} AS (SELECT url, coalesce(c, tail) AS tail, n + CASE WHEN c IS NOT NULL THEN 1 ELSE 0 END AS n, l OR coalesce(c = url, false) AS l FROM w{i - 1} LEFT JOIN s ON tail = u AND NOT l)" for i in range(2, 11)) + " SELECT url, n AS steps, l AS loop FROM w10 WHERE n > 1")
_on("page_segments", lambda p: P.segments(p, [("blog", "/blog/"), ("secure", "^https:"), ("shop", "/(product|listing)/")]), "SELECT segment, count(*) AS pages, count(*) FILTER (status_code = 200) AS ok, count(*) FILTER (indexable) AS indexable, round(avg(word_count), 4) AS words, round(avg(response_ms), 4) AS response_ms, CAST(sum(coalesce(clicks, 0)) AS BIGINT) AS clicks FROM p JOIN (VALUES ('blog', '/blog/'), ('secure', '^https:'), ('shop', '/(product|listing)/')) v(segment, r) ON regexp_matches(url, r) GROUP BY 1")
_PATH = "split_part(regexp_replace(url, '^[a-zA-Z]+://[^/]*', ''), '?', 1)"
_on("page_directory_tree", lambda p: P.directory_tree(p), f"SELECT directory, count(*) AS pages, count(*) FILTER (status_code = 200) AS ok, count(*) FILTER (status_code >= 400) AS errors, CAST(sum(word_count) AS BIGINT) AS words FROM (SELECT *, '/' || array_to_string(seg[1:i], '/') AS directory FROM (SELECT *, unnest(range(0, least(len(seg), 15) + 1)) AS i FROM (SELECT *, list_filter(string_split({_PATH}, '/'), lambda s: s <> '') AS seg FROM p))) GROUP BY 1")
_on("page_directory_children", lambda p: P.directory_children(p, 5), f", d AS (SELECT split_part({_PATH}, '/', 2) AS directory, count(*) AS pages FROM p GROUP BY 1), k AS (SELECT directory FROM d ORDER BY pages DESC, directory LIMIT 5) SELECT CASE WHEN directory IN (SELECT directory FROM k) THEN directory ELSE 'other' END AS directory, CAST(sum(pages) AS BIGINT) AS pages FROM d GROUP BY 1")
_on("page_issue_counts", lambda p: P.issue_counts(p), ", q AS (SELECT *, count(*) OVER (PARTITION BY title) AS tn, count(*) OVER (PARTITION BY description) AS dn FROM p) " + " UNION ALL ".join(f"SELECT '{n}' AS issue, count(*) FILTER ({c}) AS pages FROM q" for n, c in {"5xx": "status_code >= 500", "missing-title": "coalesce(title, '') = ''", "missing-description": "coalesce(description, '') = ''", "missing-h1": "h1_count = 0", "multiple-h1": "h1_count > 1", "title-too-long": "length(title) > 60", "title-too-short": "length(title) BETWEEN 1 AND 29", "desc-too-long": "length(description) > 160", "deep": "depth > 4", "missing-canonical": "canonical IS NULL", "duplicate-titles": "title <> '' AND tn > 1", "duplicate-descriptions": "description <> '' AND dn > 1"}.items()))
_on("page_query", lambda p: P.query(p, search="PRODUCT", status="2xx", indexable="yes", classification="visible", sort="word_count", descending=True, offset=5, limit=40).select("url", "word_count", "classification"), "SELECT url, word_count, classification FROM p WHERE contains(lower(url), 'product') AND status_code BETWEEN 200 AND 299 AND indexable AND classification IN ('visible', 'active') ORDER BY word_count DESC, url LIMIT 40 OFFSET 5")
_on("page_query_duplicates", lambda p: P.query(p, problem="duplicate-titles", template="article", robots_blocked="no", limit=500).select("url", "title"), "SELECT url, title FROM (SELECT *, count(*) OVER (PARTITION BY title) AS n FROM p) WHERE n > 1 AND title <> '' AND template = 'article' AND NOT robots_blocked ORDER BY url LIMIT 500")
_on("link_orphans", lambda p, links: P.orphans(p, links, A.SEED), f"SELECT url FROM p WHERE status_code = 200 AND t <> '{A.SEED.rstrip('/')}' AND t NOT IN (SELECT t FROM links)")
_on("link_broken", lambda p, links: P.broken_links(p, links), "SELECT url, status_code, count(*) AS referrers, string_agg(src, '|' ORDER BY src) FILTER (r <= 10) AS sample FROM (SELECT url, status_code, src, row_number() OVER (PARTITION BY url ORDER BY src) AS r FROM (SELECT DISTINCT src, dst FROM links) l JOIN p ON p.url = l.dst AND status_code >= 400) GROUP BY 1, 2")
_on("link_non_indexable", lambda p, links: P.links_to_non_indexable(p, links), "SELECT DISTINCT src, dst, reason, nofollow FROM links JOIN p USING (t) WHERE internal AND NOT indexable ORDER BY src, dst, reason, nofollow LIMIT 50")
_on("link_analysis", lambda p, links: P.link_analysis(p, links), "SELECT (SELECT count(*) FROM links WHERE internal AND NOT nofollow) AS followed, (SELECT count(*) FROM links WHERE internal AND nofollow) AS nofollowed, count(*) AS dead_ends FROM p WHERE status_code = 200 AND url NOT IN (SELECT src FROM links WHERE internal)")
_on("link_positions", lambda p, links: P.link_positions(links), "SELECT place, count(*) AS links, count(DISTINCT src) AS pages FROM links WHERE internal GROUP BY 1")
_on("link_no_content", lambda p, links: P.without_content_links(links), "SELECT src FROM links WHERE internal GROUP BY 1 HAVING count(*) FILTER (place = 'content') = 0")
_IN = ", c AS (SELECT p.url, coalesce(n, 0) AS n FROM p LEFT JOIN (SELECT t, count(DISTINCT src) AS n FROM links WHERE internal AND rtrim(src, '/') <> t GROUP BY 1) USING (t)) "
_on("link_inlinks", lambda p, links: P.inlink_counts(p, links), _IN + "SELECT url, n FROM c")
_on("link_inlink_buckets", lambda p, links: P.inlink_buckets(P.inlink_counts(p, links)), _IN + "SELECT CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '20+' END AS bucket, count(*) AS pages FROM c GROUP BY 1")
_on("link_anchor_health", lambda p, links: P.anchor_health(p, links), f""", l AS (SELECT t, lower(trim(coalesce(anchor, ''))) AS a FROM links WHERE internal AND src IN (SELECT url FROM p WHERE status_code = 200)),
per AS (SELECT t, a, a = '' OR a IN {GENERIC} AS g, regexp_matches(a, '^https?://') AS k, count(*) AS n FROM l GROUP BY 1, 2),
tot AS (SELECT t, sum(n) AS links, count(*) FILTER (a <> '') AS texts, coalesce(sum(n) FILTER (g), 0) AS generic, coalesce(sum(n) FILTER (k), 0) AS naked FROM per GROUP BY 1)
SELECT url, round(texts / links, 6) AS diversity, CAST(generic AS BIGINT) AS generic, CAST(naked AS BIGINT) AS naked, (SELECT count(*) FROM per WHERE per.t = tot.t AND NOT g AND NOT k AND links - generic - naked > 3 AND n > 0.5 * (links - generic - naked)) AS over_optimised FROM tot JOIN p USING (t) WHERE status_code = 200""")
_on("link_anchor_cloud", lambda p, links: P.anchor_cloud(links), f"SELECT trim(coalesce(anchor, '')) AS text, count(*) AS links, bool_or(internal) AS internal, lower(trim(coalesce(anchor, ''))) IN {GENERIC} AS generic FROM links WHERE length(trim(coalesce(anchor, ''))) BETWEEN 2 AND 80 GROUP BY trim(coalesce(anchor, '')), lower(trim(coalesce(anchor, ''))) IN {GENERIC} ORDER BY links DESC, text LIMIT 300")
query(A.PAGES_SQL + "SELECT count(*) FILTER (m AND c) AS both, count(*) FILTER (c AND NOT m) AS crawled_only, count(*) FILTER (m AND NOT c) AS sitemap_only, count(*) FILTER (c AND NOT m AND i) AS missing_from_sitemap, count(*) FILTER (c AND m AND NOT i) AS non_indexable_in_sitemap FROM (SELECT s.t IS NOT NULL AS m, q.t IS NOT NULL AS c, i FROM sitemap s FULL JOIN (SELECT t, bool_or(indexable) AS i FROM p WHERE status_code = 200 GROUP BY 1) q ON s.t = q.t)", "sitemap_coverage")(lambda spark, sf_dir: P.sitemap_coverage(A.pages(spark, sf_dir), A.sitemap(spark, sf_dir)))
query(A.PAGES_SQL + "SELECT status_code, count(*) AS pages FROM p WHERE t IN (SELECT t FROM sitemap) GROUP BY 1", "sitemap_status")(lambda spark, sf_dir: P.sitemap_status(A.pages(spark, sf_dir), A.sitemap(spark, sf_dir)))
_on("sitemap_files", lambda p: P.sitemap_entries(p, 100), "SELECT url, CAST((row_number() OVER (ORDER BY url) - 1) // 100 + 1 AS BIGINT) AS file FROM p WHERE status_code = 200 AND indexable AND (coalesce(canonical, '') = '' OR rtrim(canonical, '/') = t)")
query(A.PAGES_SQL + f", h AS (SELECT h.*, final_url FROM hops h JOIN p ON p.url = h.url WHERE code IN (301, 302, 307, 308)) SELECT (SELECT count(DISTINCT url) FROM hops) AS redirects, (SELECT count(*) FROM hops) AS hops, (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM hops GROUP BY url)) AS mean_chain, (SELECT max(n) FROM (SELECT count(*) AS n FROM hops GROUP BY url)) AS longest, (SELECT count(*) FROM (SELECT count(*) AS n FROM hops GROUP BY url) WHERE n > 2) AS diluted, count(*) FILTER (starts_with(hop_url, 'http://') AND starts_with(final_url, 'https://')) AS http_to_https, count(*) FILTER (starts_with({_H.format(x='hop_url')}, 'www.') <> starts_with({_H.format(x='final_url')}, 'www.')) AS www_change, count(*) FILTER ({_H.format(x='hop_url')} <> {_H.format(x='final_url')}) AS cross_domain, count(*) FILTER (code IN (302, 307)) AS temporary FROM h", "redirect_stats")(lambda spark, sf_dir: P.redirects(A.pages(spark, sf_dir), A.hops(spark, sf_dir)))
query(A.PAGES_SQL + "SELECT url, count(*) AS n, count(DISTINCT hop_url) < count(*) AS loop, count(*) FILTER (hop_url = url) > 1 AS self_redirect FROM hops GROUP BY 1", "redirect_loops")(lambda spark, sf_dir: P.redirect_loops(A.hops(spark, sf_dir)))
_INPUTS = f""", x AS (SELECT count(*) AS total, count(*) FILTER (indexable AND {LIVE}) AS indexable, count(*) FILTER (status_code BETWEEN 200 AND 299) AS ok, count(*) FILTER (status_code >= 400) AS errors, count(*) FILTER (status_code >= 500) AS server_errors, count(*) FILTER (NOT starts_with(url, 'https://') OR mixed_content) AS insecure, count(*) FILTER ({LIVE} AND coalesce(title, '') = '') AS no_title, count(*) FILTER ({LIVE} AND coalesce(description, '') = '') AS no_description, count(*) FILTER ({LIVE} AND h1_count = 0) AS no_h1, count(*) FILTER ({LIVE} AND has_schema) AS with_schema, sum(CASE WHEN {LIVE} THEN images ELSE 0 END) AS images, sum(CASE WHEN {LIVE} THEN images_missing_alt ELSE 0 END) AS images_missing_alt,
(SELECT count(*) FROM p WHERE status_code = 200 AND url NOT IN (SELECT src FROM links WHERE internal)) AS dead_ends, quantile_cont(response_ms, 0.9) FILTER ({LIVE}) AS p90, (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM p WHERE status_code = 200 GROUP BY content_hash HAVING count(*) > 1)) AS duplicates,
(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM p WHERE status_code = 200 AND title <> '' GROUP BY title HAVING count(*) > 1)) AS duplicate_titles, (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM p WHERE status_code = 200 AND description <> '' GROUP BY description HAVING count(*) > 1)) AS duplicate_descriptions,
round(count(*) FILTER ({LIVE} AND classification IN ('indexable', 'visible', 'active')) * 100 / count(*) FILTER ({LIVE}), 6) AS pct_indexable, round(count(*) FILTER ({LIVE} AND classification = 'active') * 100 / count(*) FILTER ({LIVE}), 6) AS pct_active, (SELECT count(*) FROM p WHERE status_code = 200 AND t NOT IN (SELECT t FROM links)) AS orphans FROM p) """
_on("report_health", lambda p, links: P.health(P.health_inputs(p, links)), _INPUTS + "SELECT round(indexable / total * 15 + ok / total * 15 + (1 - no_title / total) * 10 + (1 - no_description / total) * 8 + (1 - no_h1 / total) * 7 + (1 - least(duplicates / total, 1)) * 10 + (1 - least(dead_ends / total, 1)) * 10 + CASE WHEN p90 > 3000 THEN 0 WHEN p90 > 1000 THEN 10 * (1 - (p90 - 1000) / 2000) ELSE 10 END + (1 - least(insecure / total, 1)) * 5 + with_schema / total * 5 + (1 - images_missing_alt / images) * 5, 1) AS score FROM x")
_on("report_alerts", lambda p, links: P.alerts(P.health_inputs(p, links)), _INPUTS + "SELECT id, severity, round(v, 4) AS value FROM (" + " UNION ALL ".join(f"SELECT '{i}' AS id, '{s}' AS severity, CAST({v} AS DOUBLE) AS v, {op} AS fires FROM x" for i, s, v, op in (("high-error-rate", "critical", "errors / total * 100", "errors / total * 100 > 10"), ("high-5xx-rate", "critical", "server_errors / total * 100", "server_errors / total * 100 > 2"), ("low-indexability", "warning", "pct_indexable", "pct_indexable < 70"), ("slow-response-time", "warning", "p90", "p90 > 3000"), ("duplicate-titles", "warning", "duplicate_titles / total * 100", "duplicate_titles / total * 100 > 10"), ("duplicate-descriptions", "warning", "duplicate_descriptions / total * 100", "duplicate_descriptions / total * 100 > 10"), ("missing-titles", "warning", "no_title / total * 100", "no_title / total * 100 > 5"), ("missing-descriptions", "info", "no_description / total * 100", "no_description / total * 100 > 10"), ("orphan-pages", "warning", "orphans / total * 100", "orphans / total * 100 > 5"), ("low-active-rate", "info", "pct_active", "pct_active < 5"))) + ") WHERE fires")
