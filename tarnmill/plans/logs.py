"""Access-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as L
from ..tables import table
from .adapters import HITS_SQL, WASTE_SQL, hits
from .registry import query

GROUP_SQL = "CASE WHEN status >= 500 THEN '5xx' WHEN status >= 400 THEN '4xx' WHEN status >= 300 THEN '3xx' WHEN status >= 200 THEN '2xx' ELSE 'other' END"


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS bot, count(*) AS hits, CAST(sum(CAST(floor(abs(value) * 100) AS BIGINT)) AS BIGINT) AS bytes, count(DISTINCT user_id) AS users
FROM events GROUP BY 1, 2
""")
def log_bot_daily(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(L.day(F.col("ts")).alias("day"), F.col("event_type").alias("bot")).agg(F.count("*").alias("hits"), F.sum(F.floor(F.abs("value") * 100)).alias("bytes"), F.countDistinct("user_id").alias("users"))


def _on_hits(name: str, fn, sql: str) -> None:
    query(HITS_SQL + sql, name)(lambda spark, sf_dir: fn(hits(spark, sf_dir)))


def _on_urls(name: str, fn, sql: str) -> None:
    query(HITS_SQL + sql, name)(lambda spark, sf_dir: fn(L.url_stats(hits(spark, sf_dir))))


_on_hits("log_overview", L.overview, "SELECT count(*) AS hits, count(bot) AS bot_hits, count(*) - count(bot) AS human_hits, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT ip) AS ips, count(DISTINCT path) AS urls, min(ts) AS first_seen, max(ts) AS last_seen FROM hits")
_on_hits("log_status", L.by_status, f"SELECT status, {GROUP_SQL} AS status_group, count(*) AS hits FROM hits GROUP BY 1, 2")
_on_hits("log_hourly", L.by_hour, "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS hits FROM hits GROUP BY 1")
_on_hits("log_heatmap", L.heatmap, "SELECT CAST(dayofweek(ts) AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS hits FROM hits GROUP BY 1, 2")
_on_hits("log_timeline", L.timeline, "SELECT strftime(ts, '%Y-%m-%dT%H') AS hour, count(*) AS hits, CAST(sum(bytes) AS BIGINT) AS bytes FROM hits GROUP BY 1")
_on_hits("log_daily", L.daily, "SELECT day, count(*) AS hits, count(bot) AS bot_hits, count(*) - count(bot) AS human_hits FROM hits GROUP BY 1")
_on_hits("log_bots", L.by_bot, "SELECT bot, category, count(*) AS hits, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (status >= 400) AS errors, count(DISTINCT path) AS urls, count(DISTINCT ip) AS ips, bool_or(mobile) AS mobile, min(ts) AS first_seen, max(ts) AS last_seen, round(count(*) / greatest((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 3600.0, 1.0), 6) AS hits_per_hour FROM hits WHERE bot IS NOT NULL GROUP BY 1, 2")
_on_hits("log_bot_status", L.by_bot_status, "SELECT bot, status, count(*) AS hits FROM hits WHERE bot IS NOT NULL GROUP BY 1, 2")
_on_hits("log_bot_day", L.by_bot_day, "SELECT bot, day, count(*) AS hits FROM hits WHERE bot IS NOT NULL GROUP BY 1, 2")
_on_hits("log_categories", L.by_category, "SELECT category, count(*) AS hits, count(DISTINCT bot) AS bots, CAST(sum(bytes) AS BIGINT) AS bytes FROM hits WHERE category IS NOT NULL GROUP BY 1")
_on_hits("log_category_day", L.by_category_day, "SELECT category, day, count(*) AS hits FROM hits WHERE category IS NOT NULL GROUP BY 1, 2")
_on_hits("log_ai_trend", L.ai_trend, "SELECT category, bot, day, count(*) AS hits FROM hits WHERE category LIKE 'ai\\_%' ESCAPE '\\' GROUP BY 1, 2, 3")
_on_urls("log_url_stats", lambda u: u, "SELECT urls.*, v.bot AS top_bot FROM urls LEFT JOIN votes v ON v.path = urls.path AND v.r = 1")
_on_urls("log_top_urls", lambda u: L.top(u.drop("top_bot"), "hits", 25, "path"), "SELECT * FROM urls ORDER BY hits DESC, path LIMIT 25")
_on_hits("log_top_bots_by_bytes", lambda h: L.top(h.where("bot is not null").groupBy("bot").agg(F.sum("bytes").alias("bytes")), "bytes", 10, "bot"), "SELECT bot, CAST(sum(bytes) AS BIGINT) AS bytes FROM hits WHERE bot IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_on_hits("log_crawl_budget", L.crawl_budget, "SELECT count(*) AS bot_hits, count(DISTINCT path) AS urls, round(count(DISTINCT path) / count(*), 6) AS efficiency, round(count(*) FILTER (status >= 400) / count(*), 6) AS error_rate, round(count(*) FILTER (mobile) / count(*), 6) AS mobile_share, round(count(*) FILTER (category LIKE 'ai%') / count(*), 6) AS ai_share FROM hits WHERE bot IS NOT NULL")
_on_urls("log_waste", L.waste, f"SELECT waste, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(bot_hits) AS BIGINT) AS bot_hits, count(*) AS urls, round(sum(bot_hits) / (SELECT sum(bot_hits) FROM urls), 6) AS share FROM (SELECT *, {WASTE_SQL} AS waste FROM urls) WHERE waste <> '' GROUP BY 1")
_on_urls("log_waste_samples", L.waste_samples, f"SELECT path, hits, waste, rank FROM (SELECT *, row_number() OVER (PARTITION BY waste ORDER BY hits DESC, path) AS rank FROM (SELECT path, hits, {WASTE_SQL} AS waste FROM urls) WHERE waste <> '') WHERE rank <= 5")
_on_hits("log_anomalies", L.anomalies, """
, per AS (SELECT bot, day, count(*) AS hits FROM hits WHERE bot IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT 'All Traffic', day, count(*) FROM hits GROUP BY 2),
s AS (SELECT bot, sum(hits) / n AS mean, sqrt(greatest(sum(hits * hits) / n - (sum(hits) / n) * (sum(hits) / n), 0)) AS sd, n FROM per, (SELECT count(DISTINCT day) AS n FROM hits) GROUP BY bot, n)
SELECT bot, day, hits, round(mean, 4) AS mean, round(sd, 4) AS sd, round((hits - mean) / sd, 4) AS z, CASE WHEN round((hits - mean) / sd, 4) > 3 THEN 'critical' ELSE 'warning' END AS severity
FROM per JOIN s USING (bot) WHERE n >= 3 AND (mean >= 1 OR bot = 'All Traffic') AND sd >= 1 AND round((hits - mean) / sd, 4) > 2 ORDER BY hits DESC, bot, day LIMIT 10""")
_on_urls("log_directories", L.by_directory, "SELECT '/' || split_part(split_part(path, '?', 1), '/', 2) AS directory, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(bot_hits) AS BIGINT) AS bot_hits, CAST(sum(human_hits) AS BIGINT) AS human_hits, count(*) AS urls, CAST(sum(bytes) AS BIGINT) AS bytes FROM urls GROUP BY 1")
_on_urls("log_parameters", L.by_parameter, "SELECT parameter, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(bot_hits) AS BIGINT) AS bot_hits, count(*) AS urls FROM (SELECT DISTINCT path, hits, bot_hits, split_part(p, '=', 1) AS parameter FROM (SELECT *, unnest(string_split(split_part(path, '?', 2), '&')) AS p FROM urls)) WHERE parameter <> '' AND length(parameter) <= 80 GROUP BY 1")
_on_urls("log_depths", L.by_depth, "SELECT CAST(len(list_filter(string_split(split_part(path, '?', 1), '/'), lambda s: s <> '')) AS INTEGER) AS depth, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(bot_hits) AS BIGINT) AS bot_hits, count(*) AS urls FROM urls GROUP BY 1")
_on_hits("log_search_variants", L.search_variants, "SELECT bot, count(*) AS hits, count(*) FILTER (mobile) AS mobile_hits, count(*) FILTER (NOT mobile) AS desktop_hits FROM hits WHERE contains(lower(bot), 'google') GROUP BY 1")
_on_hits("log_bot_heatmaps", L.bot_heatmaps, "SELECT bot, CAST(dayofweek(ts) AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS hits FROM hits WHERE bot IN (SELECT bot FROM hits WHERE bot IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, bot LIMIT 5) GROUP BY 1, 2, 3")
_on_hits("log_hour_summary", L.hour_summary, "SELECT (SELECT CAST(hour(ts) AS INTEGER) AS h FROM hits GROUP BY 1 ORDER BY count(*) DESC, h LIMIT 1) AS peak_hour, (SELECT count(*) FROM hits GROUP BY hour(ts) ORDER BY 1 DESC LIMIT 1) AS peak_hits, round(count(*) / 24, 4) AS mean_hits, round(count(bot) / count(*), 6) AS bot_ratio FROM hits")
_on_urls("log_url_table", lambda u: L.url_table(u.drop("top_bot"), "API", "2xx"), f"SELECT * FROM urls WHERE contains(lower(path), 'api') AND {GROUP_SQL} = '2xx' ORDER BY hits DESC, path LIMIT 200")
_on_hits("log_verified_bots", lambda h: L.verified_summary(h.where("bot is not null").select("bot", "ip", (F.col("range") == "trusted").alias("verified")).distinct().fillna(False)) if "range" in h.columns else L.verified_summary(L.in_ranges(h, [("10.0.0.0/10", "trusted")]).where("bot is not null").select("bot", "ip", F.coalesce(F.col("range") == "trusted", F.lit(False)).alias("verified")).distinct()), "SELECT bot, count(*) AS ips, count(*) FILTER (v) AS verified, count(*) FILTER (NOT v) AS spoofed, round(count(*) FILTER (v) / count(*), 6) AS share FROM (SELECT DISTINCT bot, ip, CAST(split_part(ip, '.', 2) AS INTEGER) < 64 AS v FROM hits WHERE bot IS NOT NULL) GROUP BY 1")
