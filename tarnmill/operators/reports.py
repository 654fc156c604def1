"""Whole reports: score parts, page projections for export and lists, section by section comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import compare as C
from . import metrics as M
from . import pages as P

#: Part of the health score and its weight.
PARTS = (("Indexability", 0.15), ("HTTP Health", 0.15), ("Title Coverage", 0.10), ("Description Coverage", 0.08), ("H1 Coverage", 0.07), ("Duplicate Content", 0.10), ("Internal Linking", 0.10), ("Response Time", 0.10), ("Security", 0.05), ("Structured Data", 0.05), ("Image Accessibility", 0.05))


def score_parts(c: DataFrame) -> DataFrame:
    """c: the row of health_inputs -> part, weight, score (0 to 100, one decimal) of each part of the health score."""
    total = F.col("total").cast("double")
    of = lambda x: F.coalesce(F.try_divide(F.col(x), total), F.lit(0.0))
    rest = lambda x: F.when(total > 0, 1 - F.least(of(x), F.lit(1.0))).otherwise(0.0)
    speed = F.when(F.col("p90") > 3000, 0.0).when(F.col("p90") > 1000, 1 - (F.col("p90") - 1000) / 2000).otherwise(1.0)
    alt = F.when(F.col("images") > 0, 1 - F.col("images_missing_alt") / F.col("images")).otherwise(1.0)
    values = (of("indexable"), of("ok"), rest("no_title"), rest("no_description"), rest("no_h1"), rest("duplicates"), rest("dead_ends"), speed, rest("insecure"), of("with_schema"), alt)
    parts = F.array(*[F.struct(F.lit(n).alias("part"), F.lit(w).alias("weight"), F.round(v * 100, 1).alias("score")) for (n, w), v in zip(PARTS, values, strict=True)])
    return c.select(F.explode(parts).alias("x")).select("x.*")


def page_score(c: DataFrame) -> DataFrame:
    """c: health_inputs with response classes, broken links and canonical counts -> the report page's own score, 0 to 100: indexable 25,
    titles 15, descriptions 15, first headings 10, answers up to a second 10, broken links 10, canonicals 10, orphans 5."""
    total = F.greatest(F.col("total"), F.lit(1)).cast("double")
    lost = lambda x, most, each: F.greatest(F.lit(0.0), most - F.col(x) * each)
    parts = (25 * F.col("indexable") / total, 15 * (total - F.col("no_title")) / total, 15 * (total - F.col("no_description")) / total, 10 * (total - F.col("no_h1")) / total, 10 * (F.col("fast") + F.col("medium")) / total, lost("broken", 10.0, 0.5), 10 * (F.col("self_referencing") + F.col("canonicalized")) / total, lost("orphans", 5.0, 0.25))
    return c.select(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), reduce(lambda a, b: a + b, parts)))).cast("int").alias("score"))


def visit_totals(p: DataFrame) -> DataFrame:
    """p (visitors, visits, pageviews, bounce_rate, visit_duration): sums and means over pages that have visitors' data."""
    v = p.where(F.col("visitors").isNotNull())
    return v.agg(F.count("*").alias("pages"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("visitors", "visits", "pageviews")], *[F.round(F.avg(c), 6).alias(c) for c in ("bounce_rate", "visit_duration")])


def large_images(resources: DataFrame, limit: int = 100 * 1024) -> DataFrame:
    """resources (url, kind, src, bytes) -> images of over ``limit`` bytes, heaviest first."""
    return resources.where((F.col("kind") == "image") & (F.col("bytes") > limit)).select("url", "src", "bytes").orderBy(F.desc("bytes"), "url", "src")


def image_bytes(resources: DataFrame, limit: int = 100 * 1024) -> DataFrame:
    """One row: images, their bytes, those of over ``limit``."""
    i = resources.where((F.col("kind") == "image") & F.col("bytes").isNotNull())
    return i.agg(F.count("*").alias("images"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(F.col("bytes") > limit).alias("large"))


def image_audit(images: DataFrame) -> DataFrame:
    """images (url, alt, has_alt, sized) -> one row: without alt attribute, with an empty one, with one of over 125 bytes, without
    width or height."""
    alt = F.trim(F.coalesce("alt", F.lit("")))
    return images.agg(F.count("*").alias("images"), F.count_if(~F.col("has_alt")).alias("no_alt"), F.count_if(F.col("has_alt") & (alt == "")).alias("empty_alt"), F.count_if(F.octet_length("alt") > 125).alias("long_alt"), F.count_if(~F.col("sized")).alias("no_size"))


#: Columns of the list view and of the export of filtered pages.
LIGHT = ("url", "status_code", "title", "description", "h1", "canonical", "depth", "word_count", "response_ms", "internal_links", "external_links", "inlinks", "page_rank", "indexable", "impressions", "clicks", "sessions", "readability", "richness", "age_days")
EXPORT = {"url": "url", "statusCode": "status_code", "title": "title", "metaDescription": "description", "h1": "h1", "wordCount": "word_count", "depth": "depth", "internalLinks": "internal_links", "externalLinks": "external_links", "inlinks": "inlinks", "canonical": "canonical", "indexable": "indexable"}
HEAVY = ("body", "html", "anchors", "resources", "images", "json_ld", "structured")


def light(p: DataFrame) -> DataFrame:
    """What lists and reports show of a page."""
    return P.indexability(p).select(*LIGHT)


def cached(p: DataFrame, heavy: tuple[str, ...] = HEAVY) -> DataFrame:
    """p without its heavy columns."""
    return p.drop(*[c for c in heavy if c in p.columns])


def exported(p: DataFrame, **filters) -> DataFrame:
    """The twelve columns of filtered pages, null texts empty: all of them, not a page of the list."""
    q = P.filtered(p, **filters)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in ("title", "description", "h1", "canonical") else F.col(c)
    return q.select(*[text(c).alias(name) for name, c in EXPORT.items()])


def filtered_counters(p: DataFrame, **filters) -> DataFrame:
    """The counters of the report over the pages that filters keep."""
    return P.counters(P.filtered(p, **filters).select(*p.columns))


def capped(lists: DataFrame, most: int = 200) -> DataFrame:
    """lists (list, url) -> list, total and its first ``most`` urls as ``items``: what an interface is sent of a long list."""
    first = lists.withColumn("_r", F.row_number().over(Window.partitionBy("list").orderBy("url"))).where(F.col("_r") <= most)
    items = first.groupBy(F.col("list").alias("_l")).agg(F.sort_array(F.collect_list("url")).alias("items"))
    return lists.groupBy("list").agg(F.count("*").alias("total")).join(items, F.col("list") == F.col("_l")).select("list", "total", "items")


# --- comparison, section by section ---------------------------------------------------------------------------------


def redirect_measures(hops: DataFrame) -> DataFrame:
    n = hops.groupBy("url").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("redirect_chains"), F.count_if(F.col("n") > 2).alias("long_chains"))


def schema_measures(checked: DataFrame) -> DataFrame:
    """checked (url, type, severity, eligible) as schema validation gives it."""
    per = checked.groupBy("url").agg(F.bool_or(F.col("severity") == "error").alias("bad"))
    rich = checked.where("eligible").select("url", "type").distinct().agg(F.count("*").alias("rich_eligible"))
    return per.agg(F.count("*").alias("pages_with_schema"), F.count_if(F.coalesce("bad", F.lit(False))).alias("pages_with_errors")).crossJoin(rich)  # one row each


def schema_stats(checked: DataFrame, k: int = 20) -> DataFrame:
    """kind, name, n: items by type, those that may show as rich results, and the k most frequent messages."""
    types = checked.select("url", "type", "eligible").groupBy("type").agg(F.countDistinct("url").alias("n"), F.countDistinct(F.when(F.col("eligible"), F.col("url"))).alias("rich"))
    messages = checked.where(F.col("message").isNotNull()).groupBy(F.col("message").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k)
    return types.select(F.lit("type").alias("kind"), F.col("type").alias("name"), "n").unionByName(types.where("rich > 0").select(F.lit("rich").alias("kind"), F.col("type").alias("name"), F.col("rich").alias("n"))).unionByName(messages.select(F.lit("message").alias("kind"), "name", "n"))


def sitemap_measures(p: DataFrame, sitemap: DataFrame) -> DataFrame:
    return sitemap.select(F.countDistinct(P.trimmed(F.col("url"))).alias("sitemap_urls")).crossJoin(P.sitemap_coverage(p, sitemap).select("missing_from_sitemap", "non_indexable_in_sitemap"))  # one row each


def hreflang_measures(h: DataFrame) -> DataFrame:
    return M.hreflang_issues(h).agg(F.count("*").alias("hreflang_issues"))


def vector_measures(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("similar_pairs")).crossJoin(groups.agg(F.count("*").alias("groups")))  # one row each


def health_measures(p: DataFrame, links: DataFrame) -> DataFrame:
    c = P.health_inputs(p, links)
    return P.health(c).select(F.col("score").alias("health_score")).crossJoin(score_parts(c).groupBy().pivot("part", [n for n, _ in PARTS]).agg(F.first("score")))  # one row each


def section(name: str, old: DataFrame, new: DataFrame) -> DataFrame:
    """section, metric, old_value, new_value, delta of two rows of measures."""
    long = lambda d, value: d.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in d.columns]).unpivot([], [F.col(f"`{c}`") for c in d.columns], "metric", value)
    both = long(old, "old_value").join(long(new, "new_value"), "metric", "full_outer").fillna(0.0, ["old_value", "new_value"])
    return both.select(F.lit(name).alias("section"), "metric", F.round("old_value", 2).alias("old_value"), F.round("new_value", 2).alias("new_value"), F.round(F.col("new_value") - F.col("old_value"), 2).alias("delta"))


def comparison(old: DataFrame, new: DataFrame, sections: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The whole report: counters, coverage, traffic gone and found, and further sections (name -> rows of measures of either side)."""
    gone = C.paired(old, new, "left").where(F.col("n_url").isNull())
    found = C.paired(new, old, "left").where(F.col("n_url").isNull())
    clicks = F.sum(F.coalesce("o_clicks", F.lit(0)))
    coverage = section("lifecycle", gone.agg(F.count("*").alias("pages"), clicks.alias("clicks")), found.agg(F.count("*").alias("pages"), clicks.alias("clicks")))
    counters = C.deltas(old, new).select(F.lit("counters").alias("section"), "metric", "old_value", "new_value", "delta")
    return reduce(DataFrame.unionByName, [counters, coverage, *[section(n, *two) for n, two in sections.items()]])


# --- rows of the crawl file -----------------------------------------------------------------------------------------


def _chain(hops: Column) -> Column:
    return F.concat_ws(" -> ", F.transform(hops, lambda h: F.concat(h["code"].cast("string"), F.lit(":"), h["url"])))


def crawl_rows(p: DataFrame) -> DataFrame:
    """p: crawl columns with ``page``, the struct of extracted facts, and ``hops`` (array of code, url) -> the 45 columns of the CSV
    file, as texts."""
    g = lambda name: F.col(f"page.{name}")
    lasting, passing = F.exists("hops", lambda h: h["code"].isin(301, 308)), F.exists("hops", lambda h: ~h["code"].isin(301, 308))
    two = lambda c: F.format_string("%.2f", c.cast("double"))
    columns: dict[str, Column] = {
        "url": F.col("url"),
        "final_url": F.col("final_url"),
        "status_code": F.col("status_code"),
        "redirect_chain": _chain(F.col("hops")),
        "redirect_type": F.when(lasting & passing, "mixed").when(lasting, "permanent").when(passing, "temporary"),
        "response_time_ms": F.col("response_ms"),
        "title": g("title"),
        "title_length": F.char_length(g("title")),
        "meta_description": g("description"),
        "meta_description_length": F.char_length(g("description")),
        "canonical": g("canonical"),
        "canonical_count": F.col("canonical_count"),
        "canonical_is_self": (g("canonical") != "") & (g("canonical") == F.col("final_url")),
        "meta_robots": g("robots"),
        "x_robots_tag": F.col("x_robots"),
        "h1": F.get(g("h1"), 0),
        "h1_count": F.size(g("h1")),
        "h2_count": F.size(g("h2")),
        "internal_links_count": F.size(g("internal_links")),
        "external_links_count": F.size(g("external_links")),
        "images_count": F.size(g("images")),
        "images_missing_alt": F.size(F.filter(g("images"), lambda i: ~i["has_alt"])),
        "depth": F.col("depth"),
        "word_count": g("words"),
        "content_hash": g("content_hash"),
        "text_to_code_ratio": two(g("text_ratio")),
        "simhash_fingerprint": F.col("simhash"),
        "indexable": F.col("indexable"),
        "indexability_reason": F.col("reason"),
        "is_https": g("security.https"),
        "has_hsts": g("security.hsts"),
        "has_mixed_content": g("mixed_content"),
        "hreflang_count": F.size(g("hreflang")),
        "hreflang_langs": F.concat_ws(",", g("hreflang.lang")),
        "structured_data_count": F.size(g("structured")),
        "og_title": F.get(F.map_values(F.map_filter(g("meta"), lambda k, _: k == "og:title")), 0),
        "readability_score": two(F.col("readability")),
        "url_issues": F.concat_ws(",", F.col("url_issues")),
        "is_soft_404": F.col("soft_404"),
        "error": F.col("error"),
        "template_type": F.col("template"),
        "inlinks": F.col("inlinks"),
        "page_rank": two(F.col("page_rank")),
        "robots_blocked": F.col("robots_blocked"),
        "url_classification": F.col("classification"),
    }
    return p.select(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in columns.items()])


#: Columns of the file of HEAD answers.
HEAD = ("url", "final_url", "status_code", "redirect_chain_length", "redirect_chain", "response_time_ms", "content_type", "content_length", "server", "x_robots_tag", "link_canonical", "hsts", "csp", "x_frame_options", "referrer_policy", "cache_control", "error")


def head_rows(r: DataFrame) -> DataFrame:
    """r: HEAD answers with ``hops`` (array of code, url) -> the columns of their CSV file, as texts."""
    made = {"redirect_chain_length": F.size("hops"), "redirect_chain": _chain(F.col("hops"))}
    return r.select(*[F.coalesce((made[c] if c in made else F.col(c)).cast("string"), F.lit("")).alias(c) for c in HEAD])
