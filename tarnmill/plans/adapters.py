"""The driver's tables read as crawl snapshots and access logs.

The tables hold neither, so each adapter derives a plain, deterministic one; its expressions are valid
in Spark SQL and in DuckDB, and both sides of a query use the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bots import GENERIC, OTHER, SIGNATURES
from ..operators import logs
from ..tables import table

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_AGENTS = (
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "Mozilla/5.0 (Linux; Android 6.0) Mobile Safari/537.36 (compatible; Googlebot/2.1)",
    "GPTBot/1.2",
    "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36",
    "Mozilla/5.0 (compatible; bingbot/2.0)",
    "Mozilla/5.0 (iPhone) Mobile Safari/604.1",
    "PerplexityBot/1.0",
    "SomeCrawler/3.1",
    "AhrefsBot/7.0",
)
_PATHS = ("'/products?color=red&size=' || CAST({k} AS STRING)", "'/page?p=' || CAST({k} AS STRING)", "'/checkout?sid=abc' || CAST({k} AS STRING)", "'/search?q=test' || CAST({k} AS STRING)", "'/blog/2024/03/'", "'/assets/s' || CAST({k} AS STRING) || '.css'", "'/api/v1/users/' || CAST({k} AS STRING)", "'/tag/seo/' || CAST({k} AS STRING)", "'/about'", "'/'", "'/docs/a/b/' || CAST({k} AS STRING) || '/'", "'/p/' || CAST({k} AS STRING) || '?utm_source=x&page=2'")

HITS = {
    "seq": "event_id",
    "ip": "'10.' || CAST(user_id % 250 AS STRING) || '.' || CAST(user_id % 7 AS STRING) || '.' || CAST(event_id % 3 AS STRING)",
    "ts": "ts",
    "method": "CASE WHEN event_id % 17 = 0 THEN 'POST' ELSE 'GET' END",
    "path": "CASE " + " ".join(f"WHEN (event_id + user_id) % {len(_PATHS)} = {i} THEN {p.format(k=_K)}" for i, p in enumerate(_PATHS)) + " END",
    "status": "CASE event_id % 23 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 301 WHEN 3 THEN 302 WHEN 4 THEN 403 ELSE 200 END",
    "bytes": "CAST(floor(abs(value) * 100) AS BIGINT)",
    "referer": "CASE WHEN event_id % 5 = 0 THEN 'https://ref.example/' || event_type ELSE '' END",
    "user_agent": "CASE event_type " + " ".join(f"WHEN '{t}' THEN (CASE event_id % 2 WHEN 0 THEN '{a}' ELSE '{b}' END)" for t, a, b in (("view", _AGENTS[3], _AGENTS[5]), ("click", _AGENTS[0], _AGENTS[1]), ("purchase", _AGENTS[2], _AGENTS[6]), ("signup", _AGENTS[4], _AGENTS[8]))) + f" ELSE '{_AGENTS[7]}' END",
    "response_time": "CAST(event_id % 900 AS DOUBLE) / 100",
}


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return logs.with_bot(e.selectExpr(*[f"{x} AS {c}" for c, x in HITS.items()]))


def _case(what: int) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(user_agent), '{s[0]}') THEN '{s[what]}'" for s in SIGNATURES) + " WHEN " + " OR ".join(f"contains(lower(user_agent), '{g}')" for g in GENERIC) + f" THEN '{OTHER[what]}' END"


#: DuckDB's view of the same: WITH hits AS (...), urls AS (...)
HITS_SQL = f"""WITH raw AS (SELECT {", ".join(f"{x} AS {c}" for c, x in HITS.items())} FROM events),
hits AS (SELECT *, {_case(1)} AS bot, {_case(2)} AS category, coalesce(contains(lower(user_agent), 'mobile') AND category = 'search_engine', false) AS mobile, strftime(ts, '%Y-%m-%d') AS day FROM raw),
votes AS (SELECT path, bot, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, bot) AS r FROM hits WHERE bot IS NOT NULL GROUP BY path, bot),
urls AS (SELECT h.path, count(*) AS hits, count(bot) AS bot_hits, count(*) - count(bot) AS human_hits, CAST(sum(bytes) AS BIGINT) AS bytes, arg_max(status, seq + 1000000000 * epoch(ts)) AS status FROM hits h GROUP BY h.path)
"""
WASTE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(path), '{p}') THEN '{n}'" for n, p in logs.WASTE) + " ELSE '' END"


# --- crawl snapshots from orders and lineitem -------------------------------------------------------------------

SEED = "https://www.example.com/"


def page_url(k: str) -> str:
    sections = ("blog", "product", "listing", "faq", "contact", "Legal_Notes", "search", "a//b")
    cases = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(sections))
    return f"(CASE WHEN {k} % 31 = 0 THEN 'http://' ELSE 'https://' END || CASE WHEN {k} % 13 = 0 THEN 'example.com/' ELSE 'www.example.com/' END || CASE {k} % 8 {cases} END || '/' || CAST({k} % 40 AS STRING) || '/' || CAST({k} AS STRING) || CASE WHEN {k} % 10 = 0 THEN '/' WHEN {k} % 12 = 0 THEN '?utm_source=x&page=2' ELSE '' END)"


def page_columns(v: int = 0) -> dict[str, str]:
    """Snapshot 0 is the old one, 1 the new."""
    k, url = "o_orderkey", page_url("o_orderkey")
    return {
        "k": k,
        "url": url,
        "final_url": f"CASE WHEN {k} % 20 IN (1, 3) THEN {page_url(f'({k} + 8)')} ELSE {url} END",
        "status_code": f"CASE ({k} + {v} * (CASE WHEN {k} % 37 = 0 THEN 1 ELSE 0 END)) % 20 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 500 WHEN 3 THEN 302 ELSE 200 END",
        "depth": f"CAST({k} % 7 AS INT)",
        "response_ms": f"{k} * 37 % 4000 + {v * 20}",
        "word_count": f"{k} * 13 % 2500 + {v} * (CASE WHEN {k} % 17 = 0 THEN 10 ELSE 0 END)",
        "title": f"CASE WHEN {k} % 11 = 0 THEN NULL WHEN {k} % 9 = 0 THEN 'Home' ELSE 'Title ' || CAST({k} % (500 + {v}) AS STRING) || repeat('x', CAST({k} % 70 AS INT)) END",
        "description": f"CASE WHEN {k} % 6 = 0 THEN NULL WHEN {k} % 21 = 0 THEN '' ELSE 'About ' || CAST({k} % 700 AS STRING) || repeat('y', CAST({k} % 180 AS INT)) END",
        "h1": f"CASE WHEN {k} % 15 = 0 THEN NULL ELSE 'Heading ' || CAST({k} % 90 AS STRING) END",
        "h1_count": f"CAST(CASE WHEN {k} % 15 = 0 THEN 0 ELSE 1 + {k} % 2 END AS INT)",
        "h2_count": f"CAST({k} % 5 AS INT)",
        "canonical": f"CASE WHEN {k} % 4 = 0 THEN NULL WHEN {k} % 14 = 0 THEN {page_url(f'({k} + 16)')} ELSE {url} END",
        "canonical_count": f"CAST(CASE WHEN {k} % 3 = 2 THEN 2 ELSE 1 END AS INT)",
        "meta_robots": f"CASE WHEN {k} % 18 = 0 THEN 'NOINDEX, follow' END",
        "x_robots": f"CASE WHEN {k} % 33 = 0 THEN 'noindex' END",
        "robots_blocked": f"{k} % 41 = 0",
        "content_hash": f"md5(CAST(CASE WHEN {k} % 5 = 0 THEN {k} % 60 ELSE {k} + {v} * (CASE WHEN {k} % 16 = 0 THEN 1 ELSE 0 END) END AS STRING))",
        "inlinks": f"CAST({k} % 25 AS INT)",
        "page_rank": f"CAST(({k} * 7 + {v} * ({k} % 9)) % 1000 AS DOUBLE) / 100",
        "readability": f"CASE WHEN {k} % 8 = 0 THEN NULL ELSE CAST({k} % 100 AS DOUBLE) END",
        "text_ratio": f"CAST({k} % 64 AS DOUBLE) / 128",
        "richness": f"CAST({k} % 8 AS DOUBLE) / 8",
        "has_schema": f"{k} % 3 = 0",
        "mixed_content": f"{k} % 43 = 0",
        "lcp": f"CAST({k} * 11 % 6000 AS DOUBLE)",
        "inp": f"CAST({k} * 3 % 700 AS DOUBLE)",
        "cls": f"CAST({k} % 32 AS DOUBLE) / 64",
        "impressions": f"CASE WHEN {k} % 5 = 0 THEN NULL ELSE {k} * 7 % 300 END",
        "clicks": f"CASE WHEN {k} % 5 = 0 THEN NULL ELSE ({k} * 7 + {v} * 3) % 300 % 9 END",
        "position": f"CASE WHEN {k} % 5 = 0 THEN NULL ELSE CAST({k} % 256 AS DOUBLE) / 4 END",
        "sessions": f"CASE WHEN {k} % 7 < 3 THEN {k} % 4 END",
        "visitors": f"CASE WHEN {k} % 9 = 1 THEN {k} % 6 END",
        "bytes": f"CASE WHEN {k} % 22 = 0 THEN NULL ELSE {k} * 9973 % 5000000 END",
        "body_bytes": f"{k} * 7919 % 3000000",
        "template": f"CASE {k} % 4 WHEN 0 THEN 'article' WHEN 1 THEN 'product' WHEN 2 THEN 'listing' ELSE 'other' END",
        "age_days": f"CASE WHEN {k} % 5 = 2 THEN NULL ELSE {k} * 3 % 1000 END",
        "images": f"{k} % 12",
        "images_missing_alt": f"CASE WHEN {k} % 12 > 4 THEN {k} % 3 ELSE 0 END",
        "internal_links": f"{k} % 30 + {v} * (CASE WHEN {k} % 50 = 0 THEN 1 ELSE 0 END)",
        "external_links": f"{k} % 6",
    }


_KEPT = ("o_orderkey % 23 <> 0", "o_orderkey % 19 <> 0")
_DST = "((l_partkey * 31 + l_suppkey * 7 + l_linenumber * 3) % 2000)"
LINKS = {
    "src": page_url("l_orderkey"),
    "dst": f"CASE WHEN l_linenumber % 6 = 0 THEN 'https://other.example.org/' || CAST(l_suppkey AS STRING) WHEN l_linenumber % 5 = 0 THEN {page_url(_DST)} || '/' ELSE {page_url(_DST)} END",
    "anchor": "CASE l_partkey % 7 WHEN 0 THEN 'Click here' WHEN 1 THEN '' WHEN 2 THEN 'https://www.example.com/x' WHEN 3 THEN NULL WHEN 4 THEN ' more ' ELSE 'Part ' || CAST(l_partkey % 50 AS STRING) END",
    "nofollow": "l_linenumber % 4 = 0",
    "place": "CASE l_linenumber % 3 WHEN 0 THEN 'navigation' WHEN 1 THEN 'content' ELSE 'footer' END",
    "internal": "l_linenumber % 6 <> 0",
}
HOPS = {"url": page_url("l_orderkey"), "hop": "l_linenumber", "hop_url": f"CASE WHEN l_linenumber = 1 THEN {page_url('l_orderkey')} ELSE 'http://example.com/r/' || CAST((l_orderkey + l_linenumber % 3) AS STRING) END", "code": "CASE l_linenumber % 5 WHEN 0 THEN 302 WHEN 1 THEN 301 WHEN 2 THEN 307 WHEN 3 THEN 308 ELSE 200 END"}


def _sql(columns: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(f'{x} AS {c}' for c, x in columns.items())} FROM {source}"


def _read(spark: SparkSession, sf_dir: str, columns: dict[str, str], source: str, where: str = "true") -> DataFrame:
    return table(spark, sf_dir, source).where(where).selectExpr(*[f"{x} AS {c}" for c, x in columns.items()])


def pages(spark: SparkSession, sf_dir: str, v: int = 0) -> DataFrame:
    return _read(spark, sf_dir, page_columns(v), "orders", _KEPT[v])


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, LINKS, "lineitem")


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, HOPS, "lineitem", "l_orderkey % 20 IN (1, 3)")


def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, {"url": page_url("(o_orderkey + 40)")}, "orders", "o_orderkey % 3 > 0")


_COMPARE = r"regexp_replace(regexp_replace(regexp_replace({x}, '^https?://(www\.)?', ''), '#.*$', ''), '/+$', '')"


def snapshot(spark: SparkSession, sf_dir: str, columns: dict[str, str], source: str) -> DataFrame:
    """A snapshot of one's own columns."""
    return _read(spark, sf_dir, columns, source)


def snapshot_sql(columns: dict[str, str], source: str, name: str, where: str = "true") -> str:
    i = f"CASE WHEN status_code NOT BETWEEN 200 AND 299 THEN 'HTTP ' || status_code WHEN contains(lower(coalesce(meta_robots, '')), 'noindex') THEN 'meta robots noindex' WHEN contains(lower(coalesce(x_robots, '')), 'noindex') THEN 'X-Robots-Tag noindex' WHEN coalesce(canonical, '') <> '' AND {_COMPARE.format(x='canonical')} <> {_COMPARE.format(x='final_url')} THEN 'canonicalized' ELSE '' END"
    c = "CASE WHEN robots_blocked THEN 'robots-blocked' WHEN reason <> '' THEN 'non-indexable' WHEN clicks > 0 OR sessions > 0 OR visitors > 0 THEN 'active' WHEN impressions > 0 THEN 'visible' ELSE 'indexable' END"
    return f"{name}0 AS ({_sql(columns, source)} WHERE {where}), {name}1 AS (SELECT *, {i} AS reason FROM {name}0), {name} AS (SELECT *, reason = '' AS indexable, {c} AS classification, rtrim(url, '/') AS t FROM {name}1)"


def _pages_sql(v: int, name: str) -> str:
    return snapshot_sql(page_columns(v), "orders", name, _KEPT[v])


PAGES_SQL = f"WITH {_pages_sql(0, 'p')}, links AS (SELECT *, rtrim(dst, '/') AS t FROM ({_sql(LINKS, 'lineitem')})), hops AS ({_sql(HOPS, 'lineitem')} WHERE l_orderkey % 20 IN (1, 3)), sitemap AS (SELECT DISTINCT rtrim(url, '/') AS t FROM ({_sql({'url': page_url('(o_orderkey + 40)')}, 'orders')} WHERE o_orderkey % 3 > 0))\n"
BOTH_SQL = f"WITH {_pages_sql(0, 'a')}, {_pages_sql(1, 'b')}\n"
