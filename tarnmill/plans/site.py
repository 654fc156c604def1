"""Report parts, exports, page stores and graph views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import graph as G
from ..operators import logs as L
from ..operators import metrics as M
from ..operators import pages as P
from ..operators import reports as R
from ..sources import stores
from ..tables import table
from . import adapters as A
from . import facts
from .content import ROBOTS
from .graphs import _DEPTH, _EDGES, HOME
from .pages import _INPUTS, LIVE, _on
from .registry import query

# --- scores and summaries -------------------------------------------------------------------------------------------

_OF = {"Indexability": "indexable / total", "HTTP Health": "ok / total", "Title Coverage": "1 - no_title / total", "Description Coverage": "1 - no_description / total", "H1 Coverage": "1 - no_h1 / total", "Duplicate Content": "1 - least(duplicates / total, 1)", "Internal Linking": "1 - least(dead_ends / total, 1)", "Response Time": "CASE WHEN p90 > 3000 THEN 0 WHEN p90 > 1000 THEN 1 - (p90 - 1000) / 2000 ELSE 1 END", "Security": "1 - least(insecure / total, 1)", "Structured Data": "with_schema / total", "Image Accessibility": "1 - images_missing_alt / images"}
_on("report_score_parts", lambda p, links: R.score_parts(P.health_inputs(p, links)), _INPUTS + " UNION ALL ".join(f"SELECT '{n}' AS part, CAST({w} AS DOUBLE) AS weight, round(({_OF[n]}) * 100, 1) AS score FROM x" for n, w in R.PARTS))
_RT = f"(SELECT count(*) FROM p WHERE {LIVE} AND response_ms {{}})"
_OWN = f"(SELECT count(*) FROM p WHERE {LIVE} AND status_code = 200 AND coalesce(canonical, '') <> '')"


def _score_inputs(p, links):
    return P.health_inputs(p, links).withColumn("broken", F.col("errors")).crossJoin(P.response_times(p).drop("p90")).crossJoin(P.canonicals(p).select("with_canonical", "self_referencing", "canonicalized"))  # one row each


_on("report_page_score", lambda p, links: R.page_score(_score_inputs(p, links)), _INPUTS + f"SELECT CAST(round(greatest(0, least(100, 25 * indexable / total + 15 * (total - no_title) / total + 15 * (total - no_description) / total + 10 * (total - no_h1) / total + 10 * {_RT.format('< 1000')} / total + greatest(0, 10 - errors * 0.5) + 10 * {_OWN} / total + greatest(0, 5 - orphans * 0.25)))) AS INTEGER) AS score FROM x")
_on("report_card_score", lambda p, links: M.card_score(_score_inputs(p, links)), _INPUTS + f"SELECT CAST(round(least(1, indexable / total) * 25 + least(1, (total - no_title) / total) * 15 + least(1, (total - no_description) / total) * 15 + least(1, (total - no_h1) / total) * 10 + {_RT.format('< 500')} * 10 / {_RT.format('IS NOT NULL')} + greatest(0, 10 - errors * 0.5) + least(1, {_OWN} / total) * 10 + greatest(0, 5 - orphans * 0.25)) AS INTEGER) AS score FROM x")
_on("report_issue_cards", lambda p, links: M.issue_cards(P.health_inputs(p, links)), _INPUTS + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS issue, '{s}' AS severity, '{g}' AS category, CAST({n} AS BIGINT) AS pages FROM x" for n, s, g in M.CARDS) + ") WHERE pages > 0")

_VISITS = {"visits": "visitors + k % 3", "pageviews": "visitors * 2 + k % 5", "bounce_rate": "CAST(k % 128 AS DOUBLE) / 128", "visit_duration": "CAST(k % 300 AS DOUBLE)"}
_on("report_visits", lambda p: R.visit_totals(p.selectExpr("*", *[f"{x} AS {c}" for c, x in _VISITS.items()])), "SELECT count(*) AS pages, CAST(sum(visitors) AS BIGINT) AS visitors, CAST(sum(visitors + k % 3) AS BIGINT) AS visits, CAST(sum(visitors * 2 + k % 5) AS BIGINT) AS pageviews, round(avg(CAST(k % 128 AS DOUBLE) / 128), 6) AS bounce_rate, round(avg(k % 300), 6) AS visit_duration FROM p WHERE visitors IS NOT NULL")

_RES = {"url": A.page_url("l_orderkey"), "src": "'https://cdn.example/' || CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING)", "kind": "CASE l_linenumber % 3 WHEN 0 THEN 'script' ELSE 'image' END", "bytes": "CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_partkey * 977 % 300000 END"}
_RES_SQL = "WITH r AS (SELECT " + ", ".join(f"{x} AS {c}" for c, x in _RES.items()) + " FROM lineitem) "


def _resources(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{x} AS {c}" for c, x in _RES.items()])


query(_RES_SQL + "SELECT url, src, bytes FROM r WHERE kind = 'image' AND bytes > 102400", "report_large_images")(lambda spark, sf_dir: R.large_images(_resources(spark, sf_dir)))
query(_RES_SQL + "SELECT count(*) AS images, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (bytes > 102400) AS large FROM r WHERE kind = 'image' AND bytes IS NOT NULL", "report_image_bytes")(lambda spark, sf_dir: R.image_bytes(_resources(spark, sf_dir)))
query(_RES_SQL + "SELECT url, kind, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM r GROUP BY 1, 2", "page_resource_weights")(lambda spark, sf_dir: P.resource_weights(_resources(spark, sf_dir)))

# --- projections and exports ----------------------------------------------------------------------------------------

_on("page_light", lambda p: R.light(p), f"SELECT {', '.join(R.LIGHT)} FROM p")
_on("page_export", lambda p: R.exported(p, template="article", status="2xx"), "SELECT " + ", ".join(f"coalesce({c}, '') AS {n}" if c in ("title", "description", "h1", "canonical") else f"{c} AS {n}" for n, c in R.EXPORT.items()) + " FROM p WHERE template = 'article' AND status_code BETWEEN 200 AND 299")
_on("report_filtered", lambda p: R.filtered_counters(p, template="product").select("pages", "no_title", "thin", "images"), f"SELECT count(*) AS pages, count(*) FILTER ({LIVE} AND coalesce(title, '') = '') AS no_title, count(*) FILTER ({LIVE} AND status_code = 200 AND word_count > 0 AND word_count < 200) AS thin, CAST(sum(CASE WHEN {LIVE} THEN images ELSE 0 END) AS BIGINT) AS images FROM p WHERE template = 'product'")
_LISTS = "CASE WHEN status_code >= 400 THEN 'broken' WHEN word_count < 200 THEN 'thin' WHEN starts_with(url, 'http:') THEN 'plain' END"
_on("report_capped", lambda p: R.capped(p.selectExpr(f"{_LISTS.replace('starts_with', 'startswith')} AS list", "url").where("list IS NOT NULL"), 7).select("list", "total", F.concat_ws("|", "items").alias("items")), f"SELECT list, count(*) AS total, string_agg(url, '|' ORDER BY url) FILTER (r <= 7) AS items FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY url) AS r FROM (SELECT {_LISTS} AS list, url FROM p) WHERE list IS NOT NULL) GROUP BY 1")


@query("WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT 'https://e.com/p/' || k AS url, CASE k % 4 WHEN 0 THEN '301:https://e.com/a -> 302:https://e.com/b' WHEN 1 THEN '308:https://e.com/c' ELSE '' END AS redirect_chain, CASE k % 4 WHEN 0 THEN 'mixed' WHEN 1 THEN 'permanent' ELSE '' END AS redirect_type, 'T' || k AS title, CAST(length('T' || k) AS VARCHAR) AS title_length, CASE WHEN k % 5 > 0 THEN CAST(k % 5 AS VARCHAR) ELSE '0' END AS h2_count, CAST(CASE WHEN k % 14 = 0 THEN 2 ELSE 0 END AS VARCHAR) AS images_count, CAST(CASE WHEN k % 14 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS images_missing_alt, 'true' AS is_https, CAST(CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS structured_data_count, CAST(k % 7 AS VARCHAR) || '.50' AS page_rank FROM o")
def crawl_rows(spark, sf_dir):
    """Some of the 45 columns of the crawl file."""
    hop = "named_struct('code', {}, 'url', 'https://e.com/{}')"
    p = facts.pages(spark, sf_dir).selectExpr("url", "url AS final_url", "200 AS status_code", f"CASE k % 4 WHEN 0 THEN array({hop.format(301, 'a')}, {hop.format(302, 'b')}) WHEN 1 THEN array({hop.format(308, 'c')}) ELSE array() END AS hops", "k AS response_ms", "1 AS canonical_count", "CAST(NULL AS STRING) AS x_robots", "1 AS depth", "'0' AS simhash", "true AS indexable", "'' AS reason", "CAST(NULL AS DOUBLE) AS readability", "array('a') AS url_issues", "false AS soft_404", "'' AS error", "'other' AS template", "3 AS inlinks", "k % 7 + 0.5 AS page_rank", "false AS robots_blocked", "'active' AS classification", "page")
    return R.crawl_rows(p).select("url", "redirect_chain", "redirect_type", "title", "title_length", "h2_count", "images_count", "images_missing_alt", "is_https", "structured_data_count", "page_rank")


_HEAD = {c: "CAST(NULL AS STRING)" for c in R.HEAD} | {"url": "'https://e.com/' || CAST(o_orderkey AS STRING)", "final_url": "'https://e.com/'", "status_code": "CAST(200 + o_orderkey % 3 AS INT)", "response_time_ms": "o_orderkey % 90", "content_length": "CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END", "hsts": "o_orderkey % 2 = 0", "csp": "false"}


@query("SELECT " + ", ".join(f"'{'1' if c.endswith('length') else '301:https://e.com/r'}' AS {c}" if c.startswith("redirect") else f"coalesce(CAST({_HEAD[c]} AS VARCHAR), '') AS {c}" for c in R.HEAD) + " FROM orders")
def head_rows(spark, sf_dir):
    r = table(spark, sf_dir, "orders").selectExpr(*[f"{x} AS {c}" for c, x in _HEAD.items() if not c.startswith("redirect")], "array(named_struct('code', 301, 'url', 'https://e.com/r')) AS hops")
    return R.head_rows(r)


# --- stores ---------------------------------------------------------------------------------------------------------

_on("store_page_index", lambda p: stores.page_index(p), "SELECT url, status_code, indexable, coalesce(canonical, '') AS canonical, depth, inlinks, word_count, coalesce(title, '') AS title, contains(lower(concat_ws(' ', meta_robots, x_robots)), 'noindex') AS has_noindex, status_code BETWEEN 300 AND 399 OR final_url <> url AS is_redirect FROM p")
_on("store_lookup", lambda p, links: stores.lookup(stores.page_index(p), links.select(F.col("dst").alias("url"))).select("url", "status_code"), "SELECT url, status_code FROM p WHERE url IN (SELECT dst FROM links)")
query("SELECT 'https://e.com/p/' || k AS src, u AS dst FROM (SELECT o_orderkey AS k, unnest(list_filter([CASE WHEN o_orderkey % 10 = 0 THEN 'https://e.com/about-us/' END], lambda x: x IS NOT NULL)) AS u FROM orders)", "store_edges")(lambda spark, sf_dir: stores.edges(facts.pages(spark, sf_dir).select("url", F.col("page.internal_links").alias("internal_links"))))
_CACHE = {"url": "'https://e.com/' || CAST(o_custkey AS STRING)", "etag": "CASE WHEN o_orderkey % 3 = 0 THEN 'e' || CAST(o_orderkey AS STRING) ELSE '' END", "last_modified": "CASE WHEN o_orderkey % 5 = 0 THEN 'm' || CAST(o_orderkey AS STRING) END", "seq": "o_orderkey", "status_code": "CASE WHEN o_orderkey % 2 = 0 THEN 304 ELSE 200 END", "content_hash": "CAST(o_orderkey % 4 AS STRING)"}
_ANSWERS = "WITH a AS (SELECT " + ", ".join(f"{x} AS {c}" for c, x in _CACHE.items()) + " FROM orders), c AS (SELECT url, etag, coalesce(last_modified, '') AS last_modified FROM a WHERE etag <> '' OR last_modified IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1) "


def _answers(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*[f"{x} AS {c}" for c, x in _CACHE.items()])


query(_ANSWERS + "SELECT * FROM c", "store_cache_entries")(lambda spark, sf_dir: stores.cache_entries(_answers(spark, sf_dir)))


@query(_ANSWERS + ", h AS (SELECT 'https://e.com/' || c_custkey AS url, CAST(c_custkey % 4 AS VARCHAR) AS h FROM customer WHERE c_nationkey > 4) SELECT state, count(*) AS pages FROM (SELECT CASE WHEN a.status_code = 304 AND c.url IS NOT NULL AND h IS NOT NULL THEN 'not-modified' WHEN h IS NULL THEN 'new' WHEN h = content_hash THEN 'unchanged' ELSE 'changed' END AS state FROM a LEFT JOIN c USING (url) LEFT JOIN h USING (url)) GROUP BY 1")
def store_revalidated(spark, sf_dir):
    a = _answers(spark, sf_dir)
    before = table(spark, sf_dir, "customer").where("c_nationkey > 4").selectExpr("'https://e.com/' || CAST(c_custkey AS STRING) AS url", "CAST(c_custkey % 4 AS STRING) AS content_hash")
    return stores.revalidated(a, stores.cache_entries(a), before).groupBy("state").agg(F.count("*").alias("pages"))


_on("sitemap_discovered", lambda p: stores.discovered(p.select("url").unionByName(p.select(F.concat("url", F.lit("#x")).alias("url"))), A.SEED), "SELECT min(url) AS url FROM p WHERE contains(url, '//www.example.com/') GROUP BY regexp_replace(regexp_replace(url, '/$', ''), '\\?utm_source=x&page=2$', '?')")
_on("sitemap_index", lambda p: stores.sitemap_index(P.sitemap_entries(p, 100), "https://e.com"), ", e AS (SELECT CAST((row_number() OVER (ORDER BY url) - 1) // 100 + 1 AS BIGINT) AS file FROM p WHERE status_code = 200 AND indexable AND (coalesce(canonical, '') = '' OR rtrim(canonical, '/') = t)) SELECT DISTINCT file, '<sitemap><loc>https://e.com/sitemap-' || file || '.xml</loc></sitemap>' AS value FROM e")


@query("SELECT '*' AS agent, 2.0::DOUBLE AS delay FROM region WHERE r_regionkey = 0")
def url_robots_delays(spark, sf_dir):
    delays, _ = U.robots_extras(ROBOTS)
    return spark.createDataFrame(list(delays.items()), "agent string, delay double")


# --- hits -----------------------------------------------------------------------------------------------------------


@query("WITH h AS (SELECT event_id AS seq, 100.0 + user_id % 50 AS delay, CASE event_id % 7 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 ELSE 200 END AS status, CAST(event_id % 900 AS DOUBLE) AS ms, event_id % 6 AS answers, event_id % 3 AS streak, event_id % 2 AS reset_s, event_id % 25 AS remaining, event_id % 4 = 0 AS recent FROM events) SELECT seq, least(1000.0, CASE WHEN status = 429 THEN greatest(delay * 2, reset_s * 1000.0) WHEN status = 503 THEN delay * least(2.0, 1.5 + 0.5 * streak) WHEN status = 200 THEN CASE WHEN answers < 3 THEN delay ELSE greatest(50.0, CASE WHEN ms > 800 THEN delay * 1.3 WHEN (ms < 200 AND NOT recent) OR remaining > 10 THEN delay * 0.9 ELSE delay END) END ELSE delay END)::DOUBLE AS delay FROM h")
def log_next_delay(spark, sf_dir):
    c = F.col
    h = table(spark, sf_dir, "events").selectExpr("event_id AS seq", "CAST(100 + user_id % 50 AS DOUBLE) AS delay", "CASE event_id % 7 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 ELSE 200 END AS status", "CAST(event_id % 900 AS DOUBLE) AS ms", "event_id % 6 AS answers", "event_id % 3 AS streak", "event_id % 2 AS reset_s", "event_id % 25 AS remaining", "event_id % 4 = 0 AS recent")
    return h.select("seq", M.next_delay(c("delay"), c("status"), c("ms"), F.lit(400.0), c("answers"), c("streak"), c("reset_s"), c("remaining"), c("recent"), 50.0, 1000.0).alias("delay"))


_SIX = "CASE event_id % 3 WHEN 0 THEN '2001:db8::' || printf('%x', CAST(user_id AS INT)) WHEN 1 THEN '2001:db8:' || printf('%x', CAST(user_id % 9 AS INT)) || '::1' ELSE '10.1.2.' || CAST(user_id % 250 AS {T}) END"


@query(f"SELECT range, count(*) AS hits FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'doc' WHEN event_id % 3 = 1 THEN CASE WHEN user_id % 9 <= 3 THEN CASE WHEN user_id % 9 = 0 THEN 'doc' ELSE 'low' END END WHEN user_id % 250 < 128 THEN 'four' END AS range FROM events) GROUP BY 1")
def log_ip6_ranges(spark, sf_dir):
    h = table(spark, sf_dir, "events").selectExpr(_SIX.replace("{T}", "STRING") + " AS ip")
    return L.in_ranges(h, [("2001:db8::/48", "doc"), ("2001:db8::/46", "low"), ("10.1.2.0/25", "four")]).groupBy("range").agg(F.count("*").alias("hits"))


# --- comparison -----------------------------------------------------------------------------------------------------


def _both_maps(spark, sf_dir):
    s = A.sitemap(spark, sf_dir)
    return s, s.where("NOT endswith(url, '7')")


_MAPS = "sa AS (SELECT DISTINCT rtrim(url, '/') AS t FROM (SELECT {u} AS url FROM orders WHERE o_orderkey % 3 > 0)), sb AS (SELECT DISTINCT rtrim(url, '/') AS t FROM (SELECT {u} AS url FROM orders WHERE o_orderkey % 3 > 0) WHERE NOT ends_with(url, '7'))".format(u=A.page_url("(o_orderkey + 40)"))
_HOPS = "ha AS (SELECT url, count(*) AS n FROM ({h}) GROUP BY 1), hb AS (SELECT url, count(*) AS n FROM ({h}) WHERE code <> 307 GROUP BY 1)".format(h="SELECT " + ", ".join(f"{x} AS {c}" for c, x in A.HOPS.items()) + " FROM lineitem WHERE l_orderkey % 20 IN (1, 3)")
_MISSING = "(SELECT count(*) FROM (SELECT t, bool_or(indexable) AS i FROM {p} WHERE status_code = 200 GROUP BY 1) WHERE i AND t NOT IN (SELECT t FROM {s}))"
_BAD = "(SELECT count(*) FROM (SELECT t, bool_or(indexable) AS i FROM {p} WHERE status_code = 200 GROUP BY 1) WHERE NOT i AND t IN (SELECT t FROM {s}))"
_SECTIONS = (
    ("redirects", "redirect_chains", "(SELECT count(*) FROM {h})"),
    ("redirects", "long_chains", "(SELECT count(*) FROM {h} WHERE n > 2)"),
    ("sitemap", "sitemap_urls", "(SELECT count(*) FROM {s})"),
    ("sitemap", "missing_from_sitemap", _MISSING),
    ("sitemap", "non_indexable_in_sitemap", _BAD),
)


@query(A.BOTH_SQL + ", " + _MAPS + ", " + _HOPS + ", m AS (" + " UNION ALL ".join(f"SELECT '{s}' AS section, '{m}' AS metric, CAST({x.format(p='a', s='sa', h='ha')} AS DOUBLE) AS o, CAST({x.format(p='b', s='sb', h='hb')} AS DOUBLE) AS n" for s, m, x in _SECTIONS) + ") SELECT section, metric, o AS old_value, n AS new_value, n - o AS delta FROM m UNION ALL SELECT 'lifecycle', 'pages', (SELECT count(*) FROM a WHERE url NOT IN (SELECT url FROM b)), (SELECT count(*) FROM b WHERE url NOT IN (SELECT url FROM a)), (SELECT count(*) FROM b WHERE url NOT IN (SELECT url FROM a)) - (SELECT count(*) FROM a WHERE url NOT IN (SELECT url FROM b))")
def compare_sections(spark, sf_dir):
    """The sections of the whole report that are not page counters."""
    a, b = A.pages(spark, sf_dir, 0), A.pages(spark, sf_dir, 1)
    old_map, new_map = _both_maps(spark, sf_dir)
    h = A.hops(spark, sf_dir)
    out = R.comparison(a, b, {"redirects": (R.redirect_measures(h), R.redirect_measures(h.where("code <> 307"))), "sitemap": (R.sitemap_measures(a, old_map), R.sitemap_measures(b, new_map))})
    return out.where("section <> 'counters' AND metric <> 'clicks'")


_HSQL = _INPUTS + "SELECT round(indexable / total * 15 + ok / total * 15 + (1 - no_title / total) * 10 + (1 - no_description / total) * 8 + (1 - no_h1 / total) * 7 + (1 - least(duplicates / total, 1)) * 10 + (1 - least(dead_ends / total, 1)) * 10 + CASE WHEN p90 > 3000 THEN 0 WHEN p90 > 1000 THEN 10 * (1 - (p90 - 1000) / 2000) ELSE 10 END + (1 - least(insecure / total, 1)) * 5 + with_schema / total * 5 + (1 - images_missing_alt / images) * 5, 1) AS score FROM x"
_HALF = "(WITH {pages}, links AS (SELECT *, rtrim(dst, '/') AS t FROM (" + A._sql(A.LINKS, "lineitem") + ")) " + _HSQL.lstrip() + ")"


@query("SELECT 'health' AS section, 'health_score' AS metric, CAST(o AS DOUBLE) AS old_value, CAST(n AS DOUBLE) AS new_value, round(n - o, 2) AS delta FROM (SELECT " + _HALF.replace("{pages}", A._pages_sql(0, "p")) + " AS o, " + _HALF.replace("{pages}", A._pages_sql(1, "p")) + " AS n)")
def compare_health(spark, sf_dir):
    links = A.links(spark, sf_dir)
    out = R.section("health", *[R.health_measures(A.pages(spark, sf_dir, v), links) for v in (0, 1)])
    return out.where("metric = 'health_score'")


# --- graph views ----------------------------------------------------------------------------------------------------


def _graph(spark, sf_dir):
    p = A.pages(spark, sf_dir)
    return p.select(F.col("k").alias("id"), "url", "title", "depth", "page_rank"), G.build(p, A.links(spark, sf_dir))


_DRAWN = _EDGES + ", d AS (SELECT k AS id, page_rank, (SELECT count(*) FROM edges WHERE dst = k) AS in_degree, (SELECT count(*) FROM edges WHERE src = k) AS out_degree, depth FROM p), kept AS (SELECT * FROM d ORDER BY page_rank DESC, in_degree DESC, id LIMIT 200) "
query(_DRAWN + "SELECT id, page_rank, in_degree, out_degree FROM kept", "graph_drawn_nodes")(lambda spark, sf_dir: (lambda n, e: G.drawn_nodes(n, e, 200).select("id", "page_rank", "in_degree", "out_degree"))(*_graph(spark, sf_dir)))
query(_DRAWN + ", e AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM edges) SELECT src, dst FROM e WHERE r <= 2 AND src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)", "graph_drawn_edges")(lambda spark, sf_dir: (lambda n, e: G.drawn_edges(e, G.drawn_nodes(n, e, 200), 100, 2))(*_graph(spark, sf_dir)))
query(_DRAWN + "SELECT count(*) AS nodes, CAST(sum(out_degree) AS BIGINT) AS edges, max(in_degree) AS max_in_degree, max(depth) AS max_depth, count(*) > 50000 AS nodes_cut, sum(out_degree) > 5000 AS edges_cut FROM d", "graph_drawn_summary")(lambda spark, sf_dir: G.drawn_summary(*_graph(spark, sf_dir)))
_NEAR = _DEPTH.replace("b.depth < 12", "b.depth < 2") + ", near AS (SELECT id, CAST(depth AS INTEGER) AS depth FROM z ORDER BY depth, id LIMIT 100) "
query(_NEAR + "SELECT id, depth, id IN (SELECT src FROM edges WHERE dst NOT IN (SELECT id FROM near)) AS expandable FROM near", "graph_subgraph")(lambda spark, sf_dir: G.subgraph(_graph(spark, sf_dir)[1], HOME, 2, 100))
query(_NEAR + "SELECT n.id, n.depth AS hop, title, (SELECT count(*) FROM edges WHERE dst = n.id AND src IN (SELECT id FROM near)) AS in_degree, (SELECT count(*) FROM edges WHERE src = n.id) AS out_degree FROM near n JOIN p ON k = n.id", "graph_subgraph_nodes")(lambda spark, sf_dir: (lambda n, e: G.subgraph_nodes(n, e, HOME, 2, 100).select("id", "hop", "title", "in_degree", "out_degree"))(*_graph(spark, sf_dir)))
query(_NEAR + "SELECT src, dst FROM edges WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)", "graph_subgraph_edges")(lambda spark, sf_dir: (lambda e: G.subgraph_edges(e, G.subgraph(e, HOME, 2, 100)))(_graph(spark, sf_dir)[1]))
_ROOT = "https://www.example.com/product/1/1"
query(A.PAGES_SQL.replace("WITH", "WITH RECURSIVE", 1) + f", l AS (SELECT DISTINCT src, dst FROM links), b AS (SELECT '{_ROOT}' AS url, 0 AS hop UNION SELECT l.dst, b.hop + 1 FROM b JOIN l ON l.src = b.url WHERE b.hop < 2), z AS (SELECT url, min(hop) AS hop FROM b GROUP BY 1), near AS (SELECT url, hop FROM z ORDER BY hop, url LIMIT 40) SELECT url, CAST(hop AS INTEGER) AS hop, hop = 2 OR url IN (SELECT src FROM l WHERE dst NOT IN (SELECT url FROM near)) AS expandable FROM near", "graph_raw_subgraph")(lambda spark, sf_dir: G.raw_subgraph(A.links(spark, sf_dir), _ROOT, 2, 40))
_on("graph_search", lambda p: G.search(p.select(F.col("k").alias("id"), "url", "title"), "FAQ/3", 25), "SELECT k AS id, url, title FROM p WHERE contains(lower(url), 'faq/3') OR contains(lower(coalesce(title, '')), 'faq/3') ORDER BY k LIMIT 25")
_on("graph_leaders", lambda p: G.leaders(p.select(F.col("k").alias("id"), "page_rank", "inlinks"), {"authority": "page_rank", "hub": "inlinks"}), "(SELECT 'authority' AS kind, k AS id, page_rank AS score FROM p ORDER BY score DESC, id LIMIT 20) UNION ALL (SELECT 'hub' AS kind, k AS id, inlinks AS score FROM p ORDER BY score DESC, id LIMIT 20)")
_on("graph_home", lambda p: G.home(p, "http://example.com/absent").select("k", "url"), "SELECT k, url FROM p WHERE depth = 0 ORDER BY k LIMIT 1")
_on("graph_attached", lambda p: G.attached(p.select("k", "url"), p.where("k % 2 = 0").select(F.col("k").alias("id"), F.col("page_rank").alias("score"))), "SELECT k, url, CASE WHEN k % 2 = 0 THEN page_rank END AS score FROM p")


@query(_EDGES + """, d AS MATERIALIZED (SELECT k AS id, coalesce(n, 0) AS in_degree, page_rank, depth FROM p LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY 1) ON dst = k), t AS (SELECT * FROM d WHERE in_degree <= 3 ORDER BY in_degree, page_rank DESC, id LIMIT 200), s AS (SELECT * FROM d ORDER BY page_rank DESC, id LIMIT 500),
c AS (SELECT s.id AS source, t.id AS target, t.in_degree, t.depth, t.page_rank, greatest(0, t.depth - s.depth - 1) AS gain, s.page_rank AS r FROM t, s WHERE s.id <> t.id AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = s.id AND e.dst = t.id)),
x AS (SELECT *, round(CAST(greatest(0, 25 - 5 * in_degree) + least(25.0, 2.5 * r) + least(25, 8 * gain) AS DOUBLE), 1) AS score FROM c)
SELECT source, target, score, in_degree, concat_ws('; ', CASE WHEN in_degree = 1 THEN 'one link leads to the target' ELSE in_degree || ' links lead to the target' END, CASE WHEN gain >= 2 THEN gain || ' clicks nearer' END, CASE WHEN depth > 3 THEN 'target is ' || depth || ' clicks deep' END, CASE WHEN page_rank >= 5 THEN 'target has rank ' || printf('%.1f', page_rank) END) AS reason FROM x WHERE score >= 20 ORDER BY score DESC, source, target LIMIT 50""")
def graph_suggestions(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    d = G.degrees(nodes, edges).withColumnRenamed("id", "_i")
    both = nodes.join(d, F.col("id") == F.col("_i")).drop("_i")
    return G.suggestions(both, both, edges)
