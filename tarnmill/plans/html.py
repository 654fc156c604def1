"""Extraction queries over the pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import schema_org as J
from ..operators import reports as R
from ..sources import log_lines
from ..tables import table
from . import adapters as A
from .registry import query

_CLEAN = "regexp_replace(html, '(?is)<(script|style|noscript|svg)\\b[^>]*>.*?</(script|style|noscript|svg)\\s*>', ' ', 'g')"


@query(f"SELECT page_id, trim(regexp_extract({_CLEAN}, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CAST(len(regexp_extract_all({_CLEAN}, '(?i)<h1[\\s>]')) AS INTEGER) AS h1_count, trim(regexp_replace(regexp_extract({_CLEAN}, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) AS h1, regexp_extract(html, '(?i)<html[^>]*\\blang=[\"'']?([A-Za-z-]+)', 1) AS lang, md5(html) AS hash, strlen(html) AS bytes FROM pages")
def html_heads(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", H.title(h).alias("title"), H.heading_count(h).alias("h1_count"), H.first_heading(h).alias("h1"), H.lang(h).alias("lang"), F.md5("html").alias("hash"), F.octet_length("html").cast("long").alias("bytes"))


@query(f"""SELECT target, count(*) AS links, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all({_CLEAN}, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS target FROM pages) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""")
def html_link_targets(spark, sf_dir):
    l = table(spark, sf_dir, "pages").select("page_id", F.explode(H.hrefs(F.col("html"))).alias("target"))
    return l.groupBy("target").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages")).orderBy(F.desc("links"), "target").limit(100)


def _documents(spark, sf_dir):
    return H.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


_TEXT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<head\\b.*?</head\\s*>', ' ', 'g'), '(?is)<(script|style|noscript|svg)\\b[^>]*>.*?</(script|style|noscript|svg)\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
_N = lambda part: f"len(regexp_extract_all({part}, '(?i)<a\\s+href=\"[^#\"][^\"]*\"'))"
_IN = lambda tag: _N(f"regexp_extract(c, '(?is)<{tag}\\b.*</{tag}>')")
_LINKS = f"WITH h AS (SELECT page_id, {_TEXT} AS t, regexp_replace({_CLEAN}, '(?is)<!--.*?-->', ' ', 'g') AS c FROM pages), n AS (SELECT page_id, t, {_N('c')} AS links, {_IN('nav')} AS nav, {_IN('footer')} AS foot, {_IN('article')} AS content FROM h) "


@query(_LINKS + "SELECT page_id, CAST(len(list_filter(regexp_split_to_array(t, '[\\s\\x{85}\\x{a0}]+'), lambda w: w <> '')) AS INTEGER) AS words, CAST(links AS INTEGER) AS anchors, false AS mixed_content FROM n")
def html_documents(spark, sf_dir):
    return _documents(spark, sf_dir).select("page_id", "page.words", F.size("page.anchors").alias("anchors"), "page.mixed_content")


@query(_LINKS + "SELECT place, CAST(sum(n) AS BIGINT) AS links FROM (SELECT 'navigation' AS place, nav AS n FROM n UNION ALL SELECT 'footer', foot FROM n UNION ALL SELECT 'content', content FROM n UNION ALL SELECT 'other', links - nav - foot - content FROM n) GROUP BY 1 HAVING sum(n) > 0")
def html_anchor_places(spark, sf_dir):
    return _documents(spark, sf_dir).select(F.explode("page.anchors").alias("a")).groupBy("a.place").agg(F.count("*").alias("links"))


@query("SELECT 'ads' AS rule, count(*) FILTER (contains(html, 'class=\"ad\"')) AS pages FROM pages UNION ALL SELECT 'track', count(*) FILTER (regexp_matches(html, 'track\\([0-9]+\\)')) FROM pages")
def html_searches(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(H.custom_search(F.col("html"), {"ads": 'class="ad"', "track": "/track\\([0-9]+\\)/"})).alias("rule", "found"))
    return found.groupBy("rule").agg(F.count_if("found").alias("pages"))


def _checked(spark, sf_dir):
    """JSON-LD made of parts, some of it faulty."""
    doc = F.expr("concat('{', case when p_partkey % 4 = 0 then '' else '\"@context\":\"https://schema.org\",' end, '\"@type\":\"', case p_partkey % 3 when 0 then 'Product' when 1 then 'Event' else 'FAQPage' end, '\", \"name\":\"', p_name, '\", \"startDate\":\"', case when p_partkey % 5 = 0 then 'soon' else '2024-01-02' end, '\"', case when p_partkey % 11 = 0 then '' else '}' end)")
    return J.validated(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("url"), F.array(doc).alias("json_ld")))


_FIXED = ("invalid JSON", "missing @context", "startDate is no ISO 8601 date", "missing location")


@query("""WITH s AS (SELECT p_partkey AS k, p_partkey % 11 <> 0 AS ok, CASE p_partkey % 3 WHEN 0 THEN 'Product' WHEN 1 THEN 'Event' ELSE 'FAQPage' END AS t FROM part),
i AS (SELECT 'Unknown' AS type, 'error' AS severity, 'invalid JSON' AS message FROM s WHERE NOT ok UNION ALL SELECT t, 'warning', 'missing @context' FROM s WHERE ok AND k % 4 = 0 UNION ALL SELECT t, 'warning', 'startDate is no ISO 8601 date' FROM s WHERE ok AND t = 'Event' AND k % 5 = 0 UNION ALL SELECT t, 'error', 'missing location' FROM s WHERE ok AND t = 'Event')
SELECT type, severity, message, count(*) AS n FROM i GROUP BY ALL""")
def schema_issues(spark, sf_dir):
    """The issues of four kinds, by type."""
    return _checked(spark, sf_dir).where(F.col("message").isin(*_FIXED)).groupBy("type", "severity", "message").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS pages_with_schema, count(*) FILTER (p_partkey % 11 = 0 OR p_partkey % 3 = 1 OR p_partkey % 3 = 2) AS pages_with_errors FROM part")
def schema_pages(spark, sf_dir):
    """Events lack a location, FAQ pages their questions."""
    return R.schema_measures(_checked(spark, sf_dir)).select("pages_with_schema", "pages_with_errors")


@query(A.HITS_SQL + "SELECT status, count(*) AS hits, CAST(sum(bytes) AS BIGINT) AS bytes, min(ts) AS first_seen FROM (SELECT status, bytes, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts FROM hits) GROUP BY 1")
def log_lines_round_trip(spark, sf_dir):
    """Hits written as combined log lines and parsed again."""
    h = A.hits(spark, sf_dir)
    line = F.concat(F.col("ip"), F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "'), F.col("method"), F.lit(" "), F.col("path"), F.lit(' HTTP/1.1" '), F.col("status").cast("string"), F.lit(" "), F.col("bytes").cast("string"), F.lit(' "'), F.col("referer"), F.lit('" "'), F.col("user_agent"), F.lit('"'))
    return log_lines.parse(h.select(line.alias("value")), "combined").groupBy("status").agg(F.count("*").alias("hits"), F.sum("bytes").alias("bytes"), F.min("ts").alias("first_seen"))
