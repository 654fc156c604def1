"""Comparison, merge, URL and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.stopwords import stopwords
from ..operators import compare as C
from ..operators import logs as L
from ..operators import merge as M
from ..operators import ngrams as N
from ..operators import pages as P
from ..tables import table
from . import adapters as A
from .logs import GROUP_SQL
from .registry import query


def _pair(name: str, fn, sql: str | None) -> None:
    query(A.BOTH_SQL + sql if sql else None, name)(lambda spark, sf_dir: fn(A.pages(spark, sf_dir, 0), A.pages(spark, sf_dir, 1)))


_SAME = " || ".join(f"CASE WHEN coalesce(CAST(a.{c} AS VARCHAR), '') <> coalesce(CAST(b.{c} AS VARCHAR), '') THEN ',{name}' ELSE '' END" for name, c in C.FIELDS.items())
_pair("diff_pages", C.diff, f"SELECT coalesce(b.url, a.url) AS url, CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed' WHEN ({_SAME}) <> '' THEN 'changed' ELSE 'unchanged' END AS state, CASE WHEN a.url IS NULL OR b.url IS NULL THEN '' ELSE substr({_SAME}, 2) END AS fields FROM a FULL JOIN b ON a.url = b.url")
_pair("diff_fields", C.field_changes, " UNION ALL ".join(f"SELECT a.url, '{name}' AS field, coalesce(CAST(a.{c} AS VARCHAR), '') AS old_value, coalesce(CAST(b.{c} AS VARCHAR), '') AS new_value FROM a JOIN b ON a.url = b.url WHERE coalesce(CAST(a.{c} AS VARCHAR), '') <> coalesce(CAST(b.{c} AS VARCHAR), '')" for name, c in C.FIELDS.items()))
_pair("diff_lifecycle", C.lifecycle, "SELECT CASE WHEN final_url <> url THEN 'redirected' WHEN status_code >= 500 THEN 'server-error' WHEN status_code >= 400 THEN 'client-error' WHEN NOT indexable THEN 'non-indexable' ELSE 'removed' END AS reason, count(*) AS pages, count(*) FILTER (greatest(coalesce(clicks, 0), coalesce(impressions, 0), coalesce(sessions, 0), coalesce(visitors, 0)) > 0) AS with_traffic, CAST(sum(coalesce(clicks, 0)) AS BIGINT) AS clicks FROM a WHERE url NOT IN (SELECT url FROM b) GROUP BY 1")
_G = lambda t: GROUP_SQL.replace("status", f"{t}.status_code")
_pair("diff_status", C.status_migrations, f"SELECT from_group, to_group, count(*) AS pages, string_agg(url, '|' ORDER BY url) FILTER (r <= 10) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY from_group, to_group ORDER BY url) AS r FROM (SELECT a.url, {_G('a')} AS from_group, {_G('b')} AS to_group FROM a JOIN b ON a.url = b.url) WHERE from_group <> to_group) GROUP BY 1, 2")
_pair("diff_indexability", C.indexability_flips, "SELECT CASE WHEN b.indexable THEN 'became-indexable' ELSE 'became-non-indexable' END AS change, b.reason AS reason, count(*) AS pages FROM a JOIN b ON a.url = b.url WHERE a.indexable <> b.indexable GROUP BY 1, 2")
_pair("diff_content", C.content_changes, "SELECT count(*) FILTER (a.content_hash <> b.content_hash) AS modified, count(*) FILTER (a.content_hash = b.content_hash) AS unchanged FROM a JOIN b ON a.url = b.url")
for _name, _column, _least in (("diff_rank_movers", "page_rank", 0.1), ("diff_click_movers", "clicks", 0)):
    _m = f", m AS (SELECT a.url, round(b.{_column} - a.{_column}, 4) AS delta FROM a JOIN b ON a.url = b.url WHERE a.{_column} IS NOT NULL AND b.{_column} IS NOT NULL) "
    _pair(_name, lambda o, n, c=_column, x=_least: C.movers(o, n, c, x), _m + f"(SELECT url, delta, 'gain' AS kind FROM m WHERE delta > {_least} ORDER BY delta DESC, url LIMIT 20) UNION ALL (SELECT url, delta, 'loss' AS kind FROM m WHERE delta < -{_least} ORDER BY delta, url LIMIT 20)")
_LIVE = "NOT robots_blocked"
_METRICS = {"pages": "count(*)", "blocked": "count(*) FILTER (robots_blocked)", "no_title": f"count(*) FILTER ({_LIVE} AND coalesce(title, '') = '')", "no_description": f"count(*) FILTER ({_LIVE} AND coalesce(description, '') = '')", "no_h1": f"count(*) FILTER ({_LIVE} AND h1_count = 0)", "many_h1": f"count(*) FILTER ({_LIVE} AND h1_count > 1)", "long_titles": f"count(*) FILTER ({_LIVE} AND length(title) > 60)", "short_titles": f"count(*) FILTER ({_LIVE} AND length(title) BETWEEN 1 AND 29)", "long_descriptions": f"count(*) FILTER ({_LIVE} AND length(description) > 160)", "thin": f"count(*) FILTER ({_LIVE} AND status_code = 200 AND word_count > 0 AND word_count < 200)", "broken": f"count(*) FILTER ({_LIVE} AND status_code >= 400)", "not_https": f"count(*) FILTER ({_LIVE} AND NOT starts_with(url, 'https://'))", "mixed": f"count(*) FILTER ({_LIVE} AND mixed_content)", "with_schema": f"count(*) FILTER ({_LIVE} AND has_schema)", "images": f"sum(images) FILTER ({_LIVE})", "images_missing_alt": f"sum(images_missing_alt) FILTER ({_LIVE})", "crawled": f"count(*) FILTER ({_LIVE})", "renderable": f"count(*) FILTER ({_LIVE} AND status_code BETWEEN 200 AND 299)", "indexable": f"count(*) FILTER ({_LIVE} AND classification IN ('indexable', 'visible', 'active'))", "visible": f"count(*) FILTER ({_LIVE} AND classification = 'visible')", "active": f"count(*) FILTER ({_LIVE} AND classification = 'active')", "non_indexable": f"count(*) FILTER ({_LIVE} AND classification = 'non-indexable')", "p50": f"quantile_cont(response_ms, 0.5) FILTER ({_LIVE})", "p90": f"quantile_cont(response_ms, 0.9) FILTER ({_LIVE})", "p99": f"quantile_cont(response_ms, 0.99) FILTER ({_LIVE})", "impressions": "sum(impressions)", "clicks": "sum(clicks)", "internal_links": "sum(internal_links)", "external_links": "sum(external_links)", "mean_depth": "round(avg(depth), 4)"}
_DELTAS = ", d AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, round((SELECT CAST({x} AS DOUBLE) FROM a), 2) AS old_value, round((SELECT CAST({x} AS DOUBLE) FROM b), 2) AS new_value, round((SELECT CAST({x} AS DOUBLE) FROM b) - (SELECT CAST({x} AS DOUBLE) FROM a), 2) AS delta" for m, x in _METRICS.items()) + ") "
_pair("compare_deltas", C.deltas, _DELTAS + "SELECT * FROM d")
_W = ", w AS (SELECT " + ", ".join(f"max(delta) FILTER (metric = '{m}') AS {m}_d, max(old_value) FILTER (metric = '{m}') AS {m}_o" for m in _METRICS) + f""" FROM d), g AS (SELECT count(*) AS gone, coalesce(sum(coalesce(clicks, 0)), 0) AS gone_clicks FROM a WHERE url NOT IN (SELECT url FROM b)),
v AS (SELECT count(*) FILTER (f = '2xx' AND t IN ('4xx', '5xx')) AS worse, count(*) FILTER (f IN ('4xx', '5xx') AND t = '2xx') AS fixed FROM (SELECT {_G('a')} AS f, {_G('b')} AS t FROM a JOIN b ON a.url = b.url)), x AS (SELECT * FROM w, g, v) """
_FINDINGS = (
    ("coverage", "gone > 0", "CASE WHEN gone / greatest(pages_o, 1) * 100 > 10 THEN 'critical' WHEN gone / greatest(pages_o, 1) * 100 > 5 THEN 'warning' ELSE 'info' END", "gone"),
    ("coverage-traffic", "gone_clicks > 0", "'critical'", "gone_clicks"),
    ("status-worse", "worse > 0", "'critical'", "worse * 10"),
    ("status-fixed", "fixed > 0", "'info'", "fixed"),
    ("indexability", "indexable_d < 0", "'warning'", "-indexable_d * 5"),
    ("titles", "no_title_d > 0", "'warning'", "no_title_d * 3"),
    ("descriptions", "no_description_d > 0", "'warning'", "no_description_d * 2"),
    ("thin-content", "thin_d > 0", "'warning'", "thin_d"),
    ("response-time", "abs(p90_d) > 500", "CASE WHEN p90_d > 0 THEN 'warning' ELSE 'info' END", "trunc(abs(p90_d) / 100)"),
    ("clicks-lost", "clicks_d < 0", "CASE WHEN -clicks_d / greatest(clicks_o, 1) * 100 > 10 THEN 'critical' ELSE 'warning' END", "-clicks_d"),
    ("clicks-gained", "clicks_d > 0", "'info'", "clicks_d"),
    ("mixed-content", "mixed_d > 0", "'warning'", "mixed_d"),
)
_pair("compare_findings", lambda o, n: C.findings(o, n), _DELTAS + _W + " UNION ALL ".join(f"SELECT '{s}' AS section, {v} AS severity, CAST({i} AS BIGINT) AS impact FROM x WHERE {c}" for s, c, v, i in _FINDINGS))
_RULES = [("blog", "/blog/"), ("secure", "^https:")]
_SEG = "(SELECT segment, count(*) AS pages, sum(coalesce(clicks, 0)) AS clicks FROM {t} JOIN (VALUES ('blog', '/blog/'), ('secure', '^https:')) v(segment, r) ON regexp_matches(url, r) GROUP BY 1)"
_pair("compare_segments", lambda o, n: C.segment_comparison(o, n, _RULES), f"SELECT coalesce(x.segment, y.segment) AS segment, coalesce(x.pages, 0) AS old_pages, CAST(coalesce(x.clicks, 0) AS BIGINT) AS old_clicks, coalesce(y.pages, 0) AS new_pages, CAST(coalesce(y.clicks, 0) AS BIGINT) AS new_clicks FROM {_SEG.format(t='a')} x FULL JOIN {_SEG.format(t='b')} y ON x.segment = y.segment")
_MAP = [("^http:", "https:"), ("//example[.]com", "//www.example.com")]
_MAPPED = "SELECT * REPLACE (regexp_replace(regexp_replace(url, '^http:', 'https:'), '//example[.]com', '//www.example.com') AS url) FROM "
_pair("diff_mapped", lambda o, n: C.diff(C.mapped(o, _MAP), C.mapped(n, _MAP)).groupBy("state").agg(F.count("*").alias("pages")), f", a2 AS ({_MAPPED}a), b2 AS ({_MAPPED}b) SELECT state, count(*) AS pages FROM (SELECT CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed' WHEN ({_SAME}) <> '' THEN 'changed' ELSE 'unchanged' END AS state FROM a2 a FULL JOIN b2 b ON a.url = b.url) GROUP BY 1")


# --- log x crawl --------------------------------------------------------------------------------------------------

_LOG_URL = "'https://www.example.com' || (CASE o_orderkey % 6 WHEN 0 THEN '/api/v1/users/' || CAST(o_orderkey AS STRING) WHEN 1 THEN '/tag/seo/' || CAST(o_orderkey AS STRING) || '/' WHEN 2 THEN '/docs/a/b/' || CAST(o_orderkey AS STRING) WHEN 3 THEN '/p/' || CAST(o_orderkey AS STRING) WHEN 4 THEN '/search?q=test' || CAST(o_orderkey AS STRING) ELSE '/only/' || CAST(o_orderkey AS STRING) END)"
_CRAWL = A.page_columns(0) | {"url": _LOG_URL, "final_url": f"CASE WHEN o_orderkey % 50 IN (1, 3) THEN 'https://www.example.com/elsewhere' ELSE {_LOG_URL} END", "canonical": "CASE WHEN o_orderkey % 50 = 8 THEN 'https://www.example.com/other' END", "status_code": "CASE o_orderkey % 50 WHEN 5 THEN 404 WHEN 6 THEN 301 ELSE 200 END", "meta_robots": "CASE WHEN o_orderkey % 50 = 7 THEN 'noindex' END", "x_robots": "CAST(NULL AS STRING)"}
_GROUP = "CASE WHEN {x} >= 500 THEN 5 WHEN {x} >= 400 THEN 4 WHEN {x} >= 300 THEN 3 WHEN {x} >= 200 THEN 2 ELSE 0 END"
_MERGE = A.HITS_SQL + ", " + A.snapshot_sql(_CRAWL, "orders", "c") + r""", cp AS (SELECT *, substr(url, 24) AS cp FROM c),
kk AS (SELECT cp AS key, 0 AS rank, * FROM cp UNION ALL SELECT CASE WHEN ends_with(cp, '/') THEN cp[:-2] ELSE cp || '/' END, 1, * FROM cp),
best AS (SELECT * FROM kk WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank, url) = 1),
u AS (SELECT u.*, a.url IS NOT NULL AS whole, coalesce(a.url, b.url) AS curl FROM urls u LEFT JOIN best a ON a.key = u.path LEFT JOIN best b ON b.key = split_part(u.path, '?', 1)),
met AS (SELECT u.path, u.hits, u.bot_hits, u.status AS log_status, cp.* EXCLUDE (cp), cp.cp AS crawl_path FROM u LEFT JOIN cp ON cp.url = u.curl),
merged AS (SELECT path, true AS in_logs, url IS NOT NULL AS in_crawl, hits, bot_hits, log_status, status_code AS crawl_status, CASE WHEN url IS NULL THEN 'orphan_crawled' WHEN status_code BETWEEN 300 AND 399 OR final_url <> url THEN 'redirect_waste' WHEN status_code >= 400 THEN 'error_pages' WHEN NOT indexable THEN CASE WHEN bot_hits > 0 THEN 'crawl_waste' ELSE 'crawled_not_indexed' END WHEN coalesce(canonical, '') <> '' AND substr(canonical, 24) <> crawl_path AND bot_hits > 0 THEN 'crawl_waste' ELSE 'healthy' END AS segment,
 coalesce(log_status > 0 AND """ + _GROUP.format(x="log_status") + " <> " + _GROUP.format(x="status_code") + r""", false) AS mismatch FROM met
UNION ALL SELECT cp, false, true, 0, 0, NULL, arg_min(status_code, url), 'uncrawled_indexable', false FROM cp WHERE cp NOT IN (SELECT crawl_path FROM met WHERE crawl_path IS NOT NULL) GROUP BY 1)
"""


def _merged(spark, sf_dir):
    return M.merged(L.url_stats(A.hits(spark, sf_dir)), A.snapshot(spark, sf_dir, _CRAWL, "orders"))


query(_MERGE + "SELECT * FROM merged", "merge_rows")(lambda spark, sf_dir: _merged(spark, sf_dir).drop("reason"))
query(_MERGE + "SELECT segment, count(*) AS pages, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(bot_hits) AS BIGINT) AS bot_hits, count(*) FILTER (mismatch) AS mismatches FROM merged GROUP BY 1", "merge_summary")(lambda spark, sf_dir: M.summary(_merged(spark, sf_dir)))
query(_MERGE + "SELECT * FROM merged WHERE contains(path, 'p') AND in_logs AND in_crawl ORDER BY bot_hits DESC, path LIMIT 50", "merge_query")(lambda spark, sf_dir: M.query(_merged(spark, sf_dir), search="p", coverage="both", limit=50).drop("reason"))
query(_MERGE + ", r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY bot_hits DESC, hits DESC, path) AS n FROM merged) SELECT segment, path, bot_hits FROM r WHERE n <= CASE segment WHEN 'crawl_waste' THEN 200 WHEN 'orphan_crawled' THEN 200 WHEN 'uncrawled_indexable' THEN 200 WHEN 'redirect_waste' THEN 100 ELSE 50 END", "merge_samples")(lambda spark, sf_dir: M.samples(_merged(spark, sf_dir)).select("segment", "path", "bot_hits"))
query(_MERGE + "SELECT CASE segment WHEN 'orphan_crawled' THEN 'bots reach this url, the crawl found no link to it' WHEN 'uncrawled_indexable' THEN 'in the crawl, no bot came in the time of the logs' WHEN 'error_pages' THEN 'the crawler was answered with HTTP ' || crawl_status ELSE segment END AS kind, count(*) AS pages FROM merged GROUP BY 1", "merge_reasons")(lambda spark, sf_dir: _merged(spark, sf_dir).groupBy(F.when(F.col("segment").isin("orphan_crawled", "uncrawled_indexable", "error_pages"), F.col("reason")).otherwise(F.col("segment")).alias("kind")).agg(F.count("*").alias("pages")))


# --- urls ---------------------------------------------------------------------------------------------------------

_ALL = r"'^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
_URLS = f"WITH u AS (SELECT url, regexp_extract(url, {_ALL}, 1) AS s, lower(regexp_extract(url, {_ALL}, 2)) AS h, regexp_extract(url, {_ALL}, 3) AS p, regexp_extract(url, {_ALL}, 4) AS q, regexp_extract(url, {_ALL}, 5) AS f FROM (SELECT url FROM pages UNION ALL SELECT {A.page_url('o_orderkey')} FROM orders))\n"


def _urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url").unionByName(table(spark, sf_dir, "orders").selectExpr(f"{A.page_url('o_orderkey')} AS url"))


@query(_URLS + "SELECT url, s AS scheme, h AS host, CAST(len(list_filter(string_split(p, '/'), lambda x: x <> '')) AS INTEGER) AS depth, CAST(len(list_distinct(list_filter(list_transform(string_split(q, '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> ''))) AS INTEGER) AS parameters, f <> '' AS has_fragment, length(p) > 1 AND ends_with(p, '/') AS trailing_slash, CASE WHEN lower(regexp_extract(p, '\\.([^./]+)/*$', 1)) IN ('html','htm','php','asp','aspx','jsp','cgi','xml','json','pdf','js','css') THEN regexp_extract(p, '\\.([^./]+)/*$', 1) ELSE '' END AS extension FROM u")
def url_structure(spark, sf_dir):
    u = F.col("url")
    p = U.raw_path(u)
    return _urls(spark, sf_dir).select("url", U.scheme(u).alias("scheme"), U.hostname(u).alias("host"), F.size(U.segments(p)).alias("depth"), F.size(U.parameters(U.query(u))).alias("parameters"), (U.fragment(u) != "").alias("has_fragment"), ((F.length(p) > 1) & F.endswith(p, F.lit("/"))).alias("trailing_slash"), U.extension(u).alias("extension"))


@query(_URLS + "SELECT count(*) AS urls, round(avg(d), 6) AS mean_depth, max(d) AS max_depth, count(*) FILTER (q <> '' ) AS with_parameters, count(*) FILTER (length(p) > 1 AND ends_with(p, '/')) AS with_slash FROM (SELECT *, CAST(len(list_filter(string_split(p, '/'), lambda x: x <> '')) AS INTEGER) AS d FROM u)")
def url_structure_stats(spark, sf_dir):
    s = url_structure(spark, sf_dir)
    return s.agg(F.count("*").alias("urls"), F.round(F.avg("depth"), 6).alias("mean_depth"), F.max("depth").alias("max_depth"), F.count_if(F.col("parameters") > 0).alias("with_parameters"), F.count_if("trailing_slash").alias("with_slash"))


@query(_URLS + "SELECT directory, count(*) AS urls FROM (SELECT '/' || list_filter(string_split(p, '/'), lambda x: x <> '')[1] || '/' AS directory FROM u) WHERE directory IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def url_top_directories(spark, sf_dir):
    d = _urls(spark, sf_dir).select(F.concat(F.lit("/"), F.get(U.segments(U.raw_path(F.col("url"))), 0), F.lit("/")).alias("directory")).where(F.col("directory").isNotNull())
    return d.groupBy("directory").agg(F.count("*").alias("urls")).orderBy(F.desc("urls"), "directory").limit(15)


@query(_URLS + "SELECT parameter, count(*) AS urls FROM (SELECT unnest(list_distinct(list_filter(list_transform(string_split(q, '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> ''))) AS parameter FROM u) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def url_top_parameters(spark, sf_dir):
    d = _urls(spark, sf_dir).select(F.explode(U.parameters(U.query(F.col("url")))).alias("parameter"))
    return d.groupBy("parameter").agg(F.count("*").alias("urls")).orderBy(F.desc("urls"), "parameter").limit(15)


@query(_URLS + """SELECT issue, count(*) AS urls FROM (SELECT unnest(list_filter([CASE WHEN regexp_matches(p, '[A-Z]') THEN 'uppercase-in-path' END, CASE WHEN contains(p, ' ') THEN 'spaces-in-url' END, CASE WHEN contains(p, '_') THEN 'underscores-in-path' END, CASE WHEN contains(p, '//') THEN 'double-slashes' END, CASE WHEN strlen(url) > 200 THEN 'url-too-long' END,
CASE WHEN regexp_matches('&' || q, '&(utm_source|utm_medium|utm_campaign|utm_term|utm_content|fbclid|gclid|msclkid)(=|&|$)') THEN 'tracking-parameters' END, CASE WHEN len(string_split(trim(p, '/'), '/')) > 5 THEN 'deep-path' END], lambda x: x IS NOT NULL)) AS issue FROM u) GROUP BY 1""")
def url_issues(spark, sf_dir):
    return _urls(spark, sf_dir).select(F.explode(U.issues(F.col("url"))).alias("issue")).groupBy("issue").agg(F.count("*").alias("urls"))


_SORTED = "array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '')), '&')"


@query(_URLS + f"SELECT url, s || '://' || regexp_replace(h, CASE WHEN s = 'http' THEN ':80$' ELSE ':443$' END, '') || CASE WHEN length(p) <= 1 OR rtrim(p, '/') = '' THEN '/' ELSE rtrim(p, '/') END || CASE WHEN {_SORTED} <> '' THEN '?' || {_SORTED} ELSE '' END AS frontier, regexp_replace(regexp_replace(h, ':[0-9]*$', ''), '^www\\.', '') || CASE WHEN length(p) <= 1 THEN '/' ELSE rtrim(p, '/') END || CASE WHEN {_SORTED} <> '' THEN '?' || {_SORTED} ELSE '' END AS comparison, rtrim(regexp_replace(lower(url), '#.*$', ''), '/') AS metric_key FROM u")
def url_normal_forms(spark, sf_dir):
    u = F.col("url")
    return _urls(spark, sf_dir).select("url", U.frontier_form(u).alias("frontier"), U.comparison_form(u).alias("comparison"), U.metric_key(u).alias("metric_key"))


_T = {t: "0" for t in U.ORDER}
for _t, _p, _n in U.TEMPLATES:
    _T[_t] += f" + CASE WHEN regexp_matches(url, '{_p}') THEN {_n} ELSE 0 END"
for _t, _p, _n in U.HEADINGS:
    _T[_t] += f" + CASE WHEN regexp_matches(coalesce(h1, ''), '{_p}') THEN {_n} ELSE 0 END"
for _t, _x in (("article", "CASE WHEN word_count > 800 THEN 2 WHEN word_count > 400 THEN 1 ELSE 0 END + CASE WHEN external_links > 3 AND word_count > 500 THEN 1 ELSE 0 END + CASE WHEN h1_count = 1 AND h2_count >= 3 THEN 2 ELSE 0 END"), ("listing", "CASE WHEN word_count < 300 AND internal_links > 15 THEN 2 ELSE 0 END + CASE WHEN internal_links > 30 THEN 2 WHEN internal_links > 15 THEN 1 ELSE 0 END + CASE WHEN internal_links > 20 AND word_count > 0 AND word_count < internal_links * 30 THEN 2 ELSE 0 END"), ("homepage", "CASE WHEN internal_links > 30 THEN 1 ELSE 0 END"), ("product", "CASE WHEN word_count BETWEEN 100 AND 600 AND images >= 2 THEN 1 ELSE 0 END"), ("ad_detail", "CASE WHEN word_count BETWEEN 100 AND 800 AND images >= 5 THEN 1 ELSE 0 END"), ("legal", "CASE WHEN internal_links < 5 AND word_count > 200 THEN 1 ELSE 0 END"), ("faq", "CASE WHEN h2_count >= 5 THEN 1 ELSE 0 END"), ("login", "CASE WHEN word_count < 100 AND depth > 1 THEN 1 ELSE 0 END"), ("search", "CASE WHEN word_count < 100 AND depth > 1 THEN 1 ELSE 0 END")):
    _T[_t] += f" + {_x}"


@query(A.PAGES_SQL + ", s AS (SELECT url, [" + ", ".join(f"({x})" for x in _T.values()) + "] AS v FROM p) SELECT template, count(*) AS pages FROM (SELECT CASE WHEN list_max(v) < 2 THEN 'other' ELSE [" + ", ".join(f"'{t}'" for t in _T) + "][list_position(v, list_max(v))] END AS template FROM s) GROUP BY 1")
def url_templates(spark, sf_dir):
    c = F.col
    return A.pages(spark, sf_dir).select(U.template(c("url"), c("h1"), c("word_count"), c("depth"), c("h1_count"), c("h2_count"), c("internal_links"), c("external_links"), c("images")).alias("template")).groupBy("template").agg(F.count("*").alias("pages"))


ROBOTS = "User-agent: *\nDisallow: /blog/\nAllow: /blog/1\nCrawl-delay: 2\n\nUser-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\nAllow: /faq\n\nSitemap: https://www.example.com/sitemap.xml\n"


@query(A.PAGES_SQL + ", r AS (SELECT '/' || array_to_string(string_split(split_part(url, '?', 1), '/')[4:], '/') AS path FROM p) SELECT 'Googlebot' AS agent, NOT starts_with(path, '/blog/') OR starts_with(path, '/blog/1') AS allowed, count(*) AS pages FROM r GROUP BY 1, 2 UNION ALL SELECT 'GPTBot' AS agent, starts_with(path, '/faq') AS allowed, count(*) AS pages FROM r GROUP BY 1, 2")
def url_robots(spark, sf_dir):
    p = A.pages(spark, sf_dir)
    out = [p.select(F.lit(a).alias("agent"), U.robots_allowed(F.col("url"), ROBOTS, a).alias("allowed")) for a in ("Googlebot", "GPTBot")]
    return out[0].unionByName(out[1]).groupBy("agent", "allowed").agg(F.count("*").alias("pages"))


@query(A.PAGES_SQL + "SELECT verdict, count(*) AS pages FROM (SELECT CASE WHEN NOT regexp_matches(url, '/(blog|product|faq)/') THEN 'not-included' WHEN regexp_matches(url, '/1[0-9]/') THEN 'excluded:/1[0-9]/' WHEN regexp_matches(url, '[?&]page(=|&|$)') THEN 'excluded:[?&]page(=|&|$)' ELSE 'kept' END AS verdict FROM p) GROUP BY 1")
def url_frontier_filter(spark, sf_dir):
    """Include and exclude patterns; what is excluded counts for its first pattern."""
    v = U.frontier_verdict(F.col("url"), ["/(blog|product|faq)/"], ["/1[0-9]/"], ["page"])
    return A.pages(spark, sf_dir).select(v.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("pages"))


@query(A.PAGES_SQL + "SELECT internal, count(*) AS links FROM (SELECT regexp_extract(dst, '^[a-z]+://([^/?#:]*)', 1) IN ('www.example.com', 'other.example.org') AS internal FROM links) GROUP BY 1")
def url_internal(spark, sf_dir):
    return A.links(spark, sf_dir).groupBy(U.is_internal(F.col("dst"), A.SEED, ("other.example.org",)).alias("internal")).agg(F.count("*").alias("links"))


@query(A.PAGES_SQL + ", q AS (SELECT k, CASE WHEN starts_with(x, '/blog/8/') THEN '/blog/8/' WHEN starts_with(x, '/blog/') THEN '/blog/' WHEN starts_with(x, '/faq/') THEN '/faq/' END AS rule FROM (SELECT k, regexp_replace(url, '^[a-z]+://[^/]*', '') AS x FROM p)) SELECT rule, count(*) AS pages, least(count(*), CASE rule WHEN '/faq/' THEN 7 ELSE 25 END) AS kept, (SELECT k FROM (SELECT k, rule AS r, row_number() OVER (PARTITION BY rule ORDER BY k) AS n FROM q) WHERE r = q.rule AND n = least((SELECT count(*) FROM q z WHERE z.rule = q.rule), CASE q.rule WHEN '/faq/' THEN 7 ELSE 25 END)) AS last_kept FROM q WHERE rule IS NOT NULL GROUP BY 1")
def url_path_budget(spark, sf_dir):
    """The first urls of each rule's prefix up to its budget, the longest prefix first."""
    return P.budgeted(A.pages(spark, sf_dir), {"/blog/": 25, "/blog/8/": 25, "/faq/": 7}, "k")


# --- texts --------------------------------------------------------------------------------------------------------

_FIELDS = "list_filter(regexp_split_to_array({t}, '[\\s\\x{{85}}\\x{{a0}}]+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, text, {_FIELDS.format(t='lower(text)')} AS ws FROM documents),
s AS (SELECT doc_id, len(ws) AS words, greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS sentences, list_sum(list_transform(ws, lambda x: CASE WHEN strlen(x) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(x, 'e$', ''), '[aeiouy]+'))) END)) AS syllables FROM w)
SELECT doc_id, CAST(words AS INTEGER) AS words, CAST(sentences AS INTEGER) AS sentences, CAST(syllables AS INTEGER) AS syllables, CASE WHEN words > 0 THEN floor((0.39 * (words / sentences) + 11.8 * (syllables / words) - 15.59) * 100 + 0.5000001) / 100 END AS grade FROM s WHERE words > 0""")
def text_readability(spark, sf_dir):
    t = F.col("text")
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(T.fields(t)).alias("words"), T.sentences(t).alias("sentences"), T.syllable_count(t).alias("syllables"))
    return d.where("words > 0").withColumn("grade", T.grade(F.col("words"), F.col("sentences"), F.col("syllables")))


_STOP = "[" + ", ".join(f"'{w}'" for w in stopwords()) + "]"
_TOKENS = f"""WITH t AS (SELECT doc_id, list_filter(list_transform({_FIELDS.format(t="regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s''-]', ' ', 'g')")}, lambda w: trim(w, '''-')), lambda w: strlen(w) >= 2 AND NOT list_contains({_STOP}, w) AND NOT regexp_matches(w, '^\\p{{Nd}}+$')) AS w FROM documents WHERE strlen(text) >= 50), d AS (SELECT * FROM t WHERE len(w) >= 3)"""


def _grams(n: int) -> str:
    term = "w[i]" if n == 1 else "w[i] || " + " || ".join(f"' ' || w[i + {k}]" for k in range(1, n))
    return _TOKENS + f", g AS (SELECT doc_id, {term} AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d)), c AS (SELECT term, count(*) AS count, count(DISTINCT doc_id) AS pages FROM g GROUP BY 1) SELECT term, count, pages, round(count / (SELECT sum(len(w)) FROM d) * ln((SELECT count(*) FROM d) / pages), 5) AS weight FROM c WHERE pages >= 2 ORDER BY count DESC, term LIMIT 100"


for _n, _name in ((1, "unigrams"), (2, "bigrams"), (3, "trigrams")):
    query(_grams(_n), f"text_{_name}")(lambda spark, sf_dir, n=_n: N.ngrams(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), n))


@query("SELECT md5(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def text_exact_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("SELECT CASE WHEN w < 100 THEN 0 WHEN w < 300 THEN 100 WHEN w < 500 THEN 300 WHEN w < 1000 THEN 500 WHEN w < 2000 THEN 1000 ELSE 2000 END AS bucket, lang, count(*) AS texts FROM (SELECT lang, len(" + _FIELDS.format(t="text") + ") AS w FROM documents) GROUP BY 1, 2")
def text_word_histogram(spark, sf_dir):
    w = F.size(T.fields(F.col("text")))
    return table(spark, sf_dir, "documents").groupBy(F.when(w < 100, 0).when(w < 300, 100).when(w < 500, 300).when(w < 1000, 500).when(w < 2000, 1000).otherwise(2000).alias("bucket"), "lang").agg(F.count("*").alias("texts"))


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, max(turn) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def text_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.max("turn").alias("last_turn"), F.sum(F.char_length("text")).alias("chars"))


_LIST = "SELECT term, count, pages FROM (" + _grams(2).replace(" LIMIT 100", " LIMIT 200").replace("FROM documents WHERE", "FROM documents WHERE lang = '{x}' AND") + ")"
_ONE = "(SELECT '{kind}' AS kind, term, count, pages FROM {a} WHERE term NOT IN (SELECT term FROM {b}) ORDER BY count DESC, term LIMIT 30)"


@query("WITH o AS (" + _LIST.replace("{x}", "en") + "), n AS (" + _LIST.replace("{x}", "fr") + ") " + _ONE.format(kind="emerging", a="n", b="o") + " UNION ALL " + _ONE.format(kind="declining", a="o", b="n"))
def ngram_changes(spark, sf_dir):
    return N.changes(*[N.ngrams(table(spark, sf_dir, "documents").where(F.col("lang") == x).select(F.col("doc_id").alias("id"), "text"), 2, k=200) for x in ("en", "fr")])
