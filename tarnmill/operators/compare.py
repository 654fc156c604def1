"""Two crawl snapshots against each other, joined on url."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pages as P
from .logs import status_group

#: Fields of a page diff and how each is read.
FIELDS = {"statusCode": "status_code", "title": "title", "metaDescription": "description", "h1": "h1", "wordCount": "word_count", "canonical": "canonical", "indexable": "indexable", "internalLinks": "internal_links", "externalLinks": "external_links", "depth": "depth"}


def paired(old: DataFrame, new: DataFrame, how: str = "full_outer") -> DataFrame:
    """One row a url, columns prefixed o_ and n_."""
    o = P.classified(old).select(*[F.col(c).alias(f"o_{c}") for c in P.classified(old).columns])
    n = P.classified(new).select(*[F.col(c).alias(f"n_{c}") for c in P.classified(new).columns])
    return o.join(n, F.col("o_url") == F.col("n_url"), how).withColumn("url", F.coalesce("n_url", "o_url"))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """url, state (added, removed, changed, unchanged) and the names of changed fields."""
    changed = F.array_compact(F.array(*[F.when(_text(F.col(f"o_{c}")) != _text(F.col(f"n_{c}")), name) for name, c in FIELDS.items()]))
    both = F.col("o_url").isNotNull() & F.col("n_url").isNotNull()
    p = paired(old, new).withColumn("f", F.when(both, changed))
    return p.select("url", F.when(F.col("o_url").isNull(), "added").when(F.col("n_url").isNull(), "removed").when(F.size("f") > 0, "changed").otherwise("unchanged").alias("state"), F.coalesce(F.array_join("f", ","), F.lit("")).alias("fields"))


def field_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """url, field, old_value, new_value of every changed field."""
    values = F.filter(F.array(*[F.struct(F.lit(name).alias("field"), _text(F.col(f"o_{c}")).alias("old_value"), _text(F.col(f"n_{c}")).alias("new_value")) for name, c in FIELDS.items()]), lambda x: x["old_value"] != x["new_value"])
    return paired(old, new, "inner").select("url", F.explode(values).alias("x")).select("url", "x.*")


def gone_reason(prefix: str = "o_") -> Column:
    c = lambda x: F.col(prefix + x)
    return F.when(c("final_url") != c("url"), "redirected").when(c("status_code") >= 500, "server-error").when(c("status_code") >= 400, "client-error").when(~c("indexable"), "non-indexable").otherwise("removed")


def lifecycle(old: DataFrame, new: DataFrame) -> DataFrame:
    """Disappeared urls by reason, and how many of them, with their clicks, had traffic."""
    gone = paired(old, new, "left").where(F.col("n_url").isNull())
    traffic = F.greatest(*[F.coalesce(F.col(f"o_{c}"), F.lit(0)) for c in ("clicks", "impressions", "sessions", "visitors")]) > 0
    return gone.groupBy(gone_reason().alias("reason")).agg(F.count("*").alias("pages"), F.count_if(traffic).alias("with_traffic"), F.sum(F.coalesce("o_clicks", F.lit(0))).cast("long").alias("clicks"))


def status_migrations(old: DataFrame, new: DataFrame, k: int = 10) -> DataFrame:
    """Pages whose status class changed: from, to, number and the k least urls."""
    p = paired(old, new, "inner").select("url", status_group(F.col("o_status_code")).alias("from_group"), status_group(F.col("n_status_code")).alias("to_group")).where(F.col("from_group") != F.col("to_group"))
    w = Window.partitionBy("from_group", "to_group").orderBy("url")
    few = p.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("from_group", "to_group").agg(F.concat_ws("|", F.array_sort(F.collect_list("url"))).alias("sample"))
    return p.groupBy("from_group", "to_group").agg(F.count("*").alias("pages")).join(few, ["from_group", "to_group"])


def indexability_flips(old: DataFrame, new: DataFrame) -> DataFrame:
    p = paired(old, new, "inner").where(F.col("o_indexable") != F.col("n_indexable"))
    return p.groupBy(F.when(F.col("n_indexable"), "became-indexable").otherwise("became-non-indexable").alias("change"), F.col("n_reason").alias("reason")).agg(F.count("*").alias("pages"))


def content_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    same = F.col("o_content_hash") == F.col("n_content_hash")
    return paired(old, new, "inner").agg(F.count_if(~same).alias("modified"), F.count_if(same).alias("unchanged"))


def movers(old: DataFrame, new: DataFrame, column: str, least: float, k: int = 20) -> DataFrame:
    """The k greatest gains and losses of a column, over ``least`` in size."""
    p = paired(old, new, "inner").where(F.col(f"o_{column}").isNotNull() & F.col(f"n_{column}").isNotNull()).select("url", F.round(F.col(f"n_{column}") - F.col(f"o_{column}"), 4).alias("delta")).where(F.abs("delta") > least)
    up = p.where(F.col("delta") > 0).orderBy(F.desc("delta"), "url").limit(k).withColumn("kind", F.lit("gain"))
    return up.unionByName(p.where(F.col("delta") < 0).orderBy("delta", "url").limit(k).withColumn("kind", F.lit("loss")))


def measures(p: DataFrame) -> DataFrame:
    """One row of the numbers that two crawls are compared by."""
    c = P.counters(p).select("pages", "blocked", "no_title", "no_description", "no_h1", "many_h1", "long_titles", "short_titles", "long_descriptions", "thin", "broken", "not_https", "mixed", "with_schema", "images", "images_missing_alt")
    f = P.funnel(p).select("crawled", "renderable", "indexable", "visible", "active", "non_indexable")
    t = P.response_times(p).select("p50", "p90", "p99")
    s = P.search_totals(p).select("impressions", "clicks")
    l = p.agg(F.sum("internal_links").alias("internal_links"), F.sum("external_links").alias("external_links"), F.round(F.avg("depth"), 4).alias("mean_depth"))
    return reduce(lambda a, b: a.crossJoin(b), [c, f, t, s, l])  # one row each


def deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """metric, old_value, new_value, delta in long form, two decimals."""
    o, n = measures(old), measures(new)
    names = o.columns
    long = lambda d, name: d.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "metric", name)
    return long(o, "old_value").join(long(n, "new_value"), "metric").select("metric", F.round("old_value", 2).alias("old_value"), F.round("new_value", 2).alias("new_value"), F.round(F.col("new_value") - F.col("old_value"), 2).alias("delta"))


def findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """section, severity and impact of what changed for the worse or the better, most severe first."""
    wide = deltas(old, new).groupBy().pivot("metric", measures(old).columns).agg(F.first("delta").alias("d"), F.first("old_value").alias("o"))
    d, o = lambda m: F.col(f"{m}_d"), lambda m: F.col(f"{m}_o")
    gone = paired(old, new, "left").where(F.col("n_url").isNull()).agg(F.count("*").alias("gone"), F.sum(F.coalesce("o_clicks", F.lit(0))).alias("gone_clicks"))
    moves = status_migrations(old, new, 1).agg(F.coalesce(F.sum(F.when((F.col("from_group") == "2xx") & F.col("to_group").isin("4xx", "5xx"), F.col("pages"))), F.lit(0)).alias("worse"), F.coalesce(F.sum(F.when(F.col("from_group").isin("4xx", "5xx") & (F.col("to_group") == "2xx"), F.col("pages"))), F.lit(0)).alias("fixed"))
    row = wide.crossJoin(gone).crossJoin(moves)  # one row each
    pct = F.col("gone") / F.greatest(o("pages"), F.lit(1.0)) * 100
    lost = -d("clicks") / F.greatest(o("clicks"), F.lit(1.0)) * 100
    # Thresholds, severities and factors of impact.
    rules = (
        ("coverage", F.col("gone") > 0, F.when(pct > 10, "critical").when(pct > 5, "warning").otherwise("info"), F.col("gone")),
        ("coverage-traffic", F.col("gone_clicks") > 0, F.lit("critical"), F.col("gone_clicks")),
        ("status-worse", F.col("worse") > 0, F.lit("critical"), F.col("worse") * 10),
        ("status-fixed", F.col("fixed") > 0, F.lit("info"), F.col("fixed")),
        ("indexability", d("indexable") < 0, F.lit("warning"), -d("indexable") * 5),
        ("titles", d("no_title") > 0, F.lit("warning"), d("no_title") * 3),
        ("descriptions", d("no_description") > 0, F.lit("warning"), d("no_description") * 2),
        ("thin-content", d("thin") > 0, F.lit("warning"), d("thin")),
        ("response-time", F.abs(d("p90")) > 500, F.when(d("p90") > 0, "warning").otherwise("info"), F.abs(d("p90")) / 100),
        ("clicks-lost", d("clicks") < 0, F.when(lost > 10, "critical").otherwise("warning"), -d("clicks")),
        ("clicks-gained", d("clicks") > 0, F.lit("info"), d("clicks")),
        ("mixed-content", d("mixed") > 0, F.lit("warning"), d("mixed")),
    )
    found = F.filter(F.array(*[F.when(fires, F.struct(F.lit(name).alias("section"), severity.alias("severity"), impact.cast("long").alias("impact"))) for name, fires, severity, impact in rules]), lambda x: x.isNotNull())
    out = row.select(F.explode(found).alias("x")).select("x.*")
    return out.orderBy(F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2), F.desc("impact"), "section")


def segment_comparison(old: DataFrame, new: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    o = P.segments(old, rules).select("segment", F.col("pages").alias("old_pages"), F.col("clicks").alias("old_clicks"))
    n = P.segments(new, rules).select("segment", F.col("pages").alias("new_pages"), F.col("clicks").alias("new_clicks"))
    return o.join(n, "segment", "full_outer").fillna(0)


def mapped(p: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Urls rewritten before a diff: (pattern, replacement), one after the other."""
    u = F.col("url")
    for pattern, replacement in rules:
        u = F.regexp_replace(u, pattern, replacement)
    return p.withColumn("url", u)
