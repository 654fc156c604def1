"""Operators over page records (one row a url) and their links.

``pages``: url, final_url, status_code, depth, response_ms, word_count, title, description, h1, h1_count, h2_count,
canonical, canonical_count, meta_robots, x_robots, robots_blocked, content_hash, inlinks, page_rank, readability,
text_ratio, richness, has_schema, mixed_content, lcp, inp, cls, impressions, clicks, position, sessions, visitors,
bytes, body_bytes, template, age_days, images, images_missing_alt, internal_links, external_links.
``links``: src, dst, anchor, nofollow, place, internal. Lists come with a unique order; counters are one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import stored
from ..functions.urls import budget_rule

#: Anchor texts that describe nothing, as the report counts them.
GENERIC_ANCHORS = ("click here", "here", "read more", "more", "link", "this", "learn more", "continue")


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0)), digits)


def trimmed(url: Column) -> Column:
    """Without its trailing slashes."""
    return F.rtrim(url, F.lit("/"))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)


def comparable(url: Column) -> Column:
    """For comparing canonicals: no scheme, no ``www.``, no trailing slash, no fragment."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(url, r"^https?://(www\.)?", ""), r"#.*$", ""), F.lit("/"))


def indexability(p: DataFrame) -> DataFrame:
    """Adds reason ('' if indexable) and indexable; the first rule that fits decides."""
    c = F.col
    noindex = lambda x: F.coalesce(F.contains(F.lower(c(x)), F.lit("noindex")), F.lit(False))
    other = (F.coalesce(c("canonical"), F.lit("")) != "") & (comparable(c("canonical")) != comparable(c("final_url")))
    reason = F.when(~c("status_code").between(200, 299), F.concat(F.lit("HTTP "), c("status_code").cast("string"))).when(noindex("meta_robots"), "meta robots noindex").when(noindex("x_robots"), "X-Robots-Tag noindex").when(other, "canonicalized").otherwise("")
    return p.withColumn("reason", reason).withColumn("indexable", F.col("reason") == "")


def classified(p: DataFrame) -> DataFrame:
    """Adds classification: robots-blocked, non-indexable, active, visible or indexable."""
    positive = lambda x: F.coalesce(F.col(x) > 0, F.lit(False))
    p = p if "indexable" in p.columns else indexability(p)
    return p.withColumn("classification", F.when(F.col("robots_blocked"), "robots-blocked").when(~F.col("indexable"), "non-indexable").when(positive("clicks") | positive("sessions") | positive("visitors"), "active").when(positive("impressions"), "visible").otherwise("indexable"))


def counters(p: DataFrame) -> DataFrame:
    """One row of on-page counters; robots-blocked pages are only counted."""
    live = ~F.col("robots_blocked")
    n = lambda c: F.count_if(live & F.coalesce(c, F.lit(False)))
    size, desc = F.char_length("title"), F.char_length("description")
    empty = lambda x: F.coalesce(F.col(x), F.lit("")) == ""
    return p.agg(
        F.count("*").alias("pages"),
        F.count_if("robots_blocked").alias("blocked"),
        n(empty("title")).alias("no_title"),
        n(empty("description")).alias("no_description"),
        n(F.col("h1_count") == 0).alias("no_h1"),
        n(F.col("h1_count") > 1).alias("many_h1"),
        n(size > 60).alias("long_titles"),
        n((size > 0) & (size < 30)).alias("short_titles"),
        n(desc > 160).alias("long_descriptions"),
        n(F.col("status_code") >= 400).alias("broken"),
        n(~F.startswith("url", F.lit("https://"))).alias("not_https"),
        n(F.col("mixed_content")).alias("mixed"),
        n((F.col("status_code") == 200) & (F.col("word_count") > 0) & (F.col("word_count") < 200)).alias("thin"),
        n(F.col("has_schema")).alias("with_schema"),
        F.sum(F.when(live, F.col("images")).otherwise(0)).cast("long").alias("images"),
        F.sum(F.when(live, F.col("images_missing_alt")).otherwise(0)).cast("long").alias("images_missing_alt"),
    )


def histogram(p: DataFrame, column: str) -> DataFrame:
    return p.groupBy(column).agg(F.count("*").alias("pages"))


def bucketed(p: DataFrame, column: str, edges: list[int]) -> DataFrame:
    """Pages per bucket; a bucket is named by its lower edge, from edges[0] on."""
    b = F.lit(edges[0])
    for e in edges[1:]:
        b = F.when(F.col(column) >= e, e).otherwise(b)
    return p.where(F.col(column) >= edges[0]).groupBy(b.cast("long").alias("bucket")).agg(F.count("*").alias("pages"))


def response_times(p: DataFrame) -> DataFrame:
    """One row: exact percentiles by linear interpolation, and four buckets."""
    t = F.col("response_ms")
    q = F.percentile("response_ms", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    out = p.where(~F.col("robots_blocked")).agg(q.alias("q"), F.count_if(t < 500).alias("fast"), F.count_if((t >= 500) & (t < 1000)).alias("medium"), F.count_if((t >= 1000) & (t < 2000)).alias("slow"), F.count_if(t >= 2000).alias("slowest"))
    return out.select(*[F.round(F.col("q")[i], 4).alias(f"p{x}") for i, x in enumerate((50, 90, 99))], "fast", "medium", "slow", "slowest")


def duplicates(p: DataFrame, column: str) -> DataFrame:
    """Values that several 200 pages share, with their number of pages."""
    return p.where((F.col("status_code") == 200) & (F.coalesce(F.col(column), F.lit("")) != "")).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("pages")).where(F.col("pages") > 1)


def duplicate_groups(p: DataFrame, k: int = 10) -> DataFrame:
    """Content hashes that several 200 pages share: size, first url and the k least urls. Ranks bound what a group gathers."""
    w = Window.partitionBy("content_hash").orderBy("url")
    some = p.where((F.col("status_code") == 200) & (F.col("content_hash") != ""))
    few = some.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("content_hash").agg(F.concat_ws("|", F.array_sort(F.collect_list("url"))).alias("urls"))
    return duplicates(p, "content_hash").withColumnRenamed("value", "content_hash").join(few, "content_hash")


def originality(p: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """url, score: 127 alone, 80 in a pair, 40 among up to five, 10 beyond; near duplicates (url) score 60 at most."""
    n = p.where((F.col("status_code") == 200) & (F.col("content_hash") != "")).groupBy("content_hash").agg(F.count("*").alias("n"))
    out = p.where((F.col("status_code") == 200) & (F.col("content_hash") != "")).select("url", "content_hash").join(n, "content_hash")
    out = out.select("url", F.when(F.col("n") <= 1, 127).when(F.col("n") == 2, 80).when(F.col("n") <= 5, 40).otherwise(10).alias("score"))
    if near is None:
        return out
    near = near.select(F.col("url").alias("_url")).distinct()
    return out.join(near, F.col("url") == F.col("_url"), "left").select("url", F.when(F.col("_url").isNotNull(), F.least("score", F.lit(60))).otherwise(F.col("score")).alias("score"))


def top(df: DataFrame, by: str, k: int, tie: str = "url", descending: bool = True) -> DataFrame:
    return df.orderBy(F.desc(by) if descending else F.asc(by), tie).limit(k)


def orphans(p: DataFrame, links: DataFrame, seed: str) -> DataFrame:
    """200 pages but the seed that no link reaches, trailing slashes aside."""
    seen = links.select(trimmed(F.col("dst")).alias("_dst"))
    return p.where((F.col("status_code") == 200) & (trimmed(F.col("url")) != seed.rstrip("/"))).select("url").join(seen, trimmed(F.col("url")) == F.col("_dst"), "left_anti")


def broken_links(p: DataFrame, links: DataFrame, k: int = 10) -> DataFrame:
    """Broken pages with their number of referring pages and the k least of them."""
    bad = p.where(F.col("status_code") >= 400).select("url", "status_code")
    refs = links.select(F.col("src"), F.col("dst").alias("_dst")).distinct().join(bad, F.col("_dst") == F.col("url"))
    w = Window.partitionBy("url").orderBy("src")
    few = refs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    n = refs.groupBy("url", "status_code").agg(F.count("*").alias("referrers"))
    return n.join(few.groupBy("url").agg(F.concat_ws("|", F.array_sort(F.collect_list("src"))).alias("sample")), "url")


def links_to_non_indexable(p: DataFrame, links: DataFrame, k: int = 50) -> DataFrame:
    t = indexability(p).where(~F.col("indexable")).select(trimmed(F.col("url")).alias("_t"), "reason")
    found = links.where("internal").join(t, trimmed(F.col("dst")) == F.col("_t")).select("src", "dst", "reason", "nofollow").distinct()
    return found.orderBy("src", "dst", "reason", "nofollow").limit(k)


def link_analysis(p: DataFrame, links: DataFrame) -> DataFrame:
    """One row: followed and nofollowed internal links, and 200 pages without internal links."""
    l = links.where("internal").agg(F.count_if(~F.col("nofollow")).alias("followed"), F.count_if("nofollow").alias("nofollowed"))
    out = links.where("internal").select(F.col("src").alias("_src"))
    dead = p.where(F.col("status_code") == 200).join(out, F.col("url") == F.col("_src"), "left_anti").agg(F.count("*").alias("dead_ends"))
    return l.crossJoin(dead)  # one row each


def link_positions(links: DataFrame) -> DataFrame:
    return links.where("internal").groupBy("place").agg(F.count("*").alias("links"), F.countDistinct("src").alias("pages"))


def without_content_links(links: DataFrame) -> DataFrame:
    """Pages none of whose internal links stands in the content."""
    return links.where("internal").groupBy("src").agg(F.count_if(F.col("place") == "content").alias("n")).where(F.col("n") == 0).select("src")


def inlink_counts(p: DataFrame, links: DataFrame) -> DataFrame:
    """url, n: distinct pages that link to it, trailing slashes aside; self-links do not count."""
    n = links.where("internal").select("src", trimmed(F.col("dst")).alias("_d")).where(trimmed(F.col("src")) != F.col("_d")).groupBy("_d").agg(F.countDistinct("src").alias("n"))
    return p.select("url").join(n, trimmed(F.col("url")) == F.col("_d"), "left").select("url", F.coalesce("n", F.lit(0)).alias("n"))


def inlink_buckets(counts: DataFrame) -> DataFrame:
    n = F.col("n")
    return counts.groupBy(F.when(n == 0, "0").when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").otherwise("20+").alias("bucket")).agg(F.count("*").alias("pages"))


def readability(p: DataFrame) -> DataFrame:
    """One row: mean grade, difficult (< 30) and very easy (> 80) pages, and three quality tiers."""
    fk, words = F.col("readability"), F.col("word_count")
    # in hundredths, so that sums are exact
    q = F.when(fk.between(4, 14), 35).when(fk < 4, 25).otherwise(0) + F.when(words >= 300, 25).when(words >= 100, 15).otherwise(0) + F.when(F.coalesce(F.col("richness"), F.lit(0.0)) >= 0.3, 20).otherwise(0) + F.when(F.col("h2_count") >= 2, 20).when(F.col("h1_count") > 0, 10).otherwise(0)
    return p.where((F.col("status_code") == 200) & fk.isNotNull()).agg(F.round(F.avg("readability"), 4).alias("mean"), F.count_if(fk < 30).alias("difficult"), F.count_if(fk > 80).alias("very_easy"), F.count_if(q >= 70).alias("tier1"), F.count_if((q >= 40) & (q < 70)).alias("tier2"), F.count_if(q < 40).alias("tier3"))


def text_to_code(p: DataFrame, poor: float = 0.1) -> DataFrame:
    r = F.col("text_ratio")
    return p.where((F.col("status_code") == 200) & (r > 0)).agg(F.round(F.avg(r), 6).alias("mean"), F.count_if(r < poor).alias("poor"))


def image_audit(p: DataFrame) -> DataFrame:
    return p.where("not robots_blocked").agg(F.sum("images").alias("images"), F.sum("images_missing_alt").alias("missing_alt"), share(F.sum("images_missing_alt"), F.sum("images")).alias("share"))


def redirects(p: DataFrame, hops: DataFrame) -> DataFrame:
    """hops (url, hop, hop_url, code) -> one row: redirects, hops, mean and greatest chain, and kinds of change by the final url."""
    per = hops.groupBy("url").agg(F.count("*").alias("n"))
    h = hops.join(p.select(F.col("url").alias("_url"), "final_url"), F.col("url") == F.col("_url")).where(F.col("code").isin(301, 302, 307, 308))
    www = lambda u: F.startswith(host(u), F.lit("www."))
    a, b = F.col("hop_url"), F.col("final_url")
    kinds = h.agg(F.count_if(F.startswith(a, F.lit("http://")) & F.startswith(b, F.lit("https://"))).alias("http_to_https"), F.count_if(www(a) != www(b)).alias("www_change"), F.count_if(host(a) != host(b)).alias("cross_domain"), F.count_if(F.col("code").isin(302, 307)).alias("temporary"))
    return per.agg(F.count("*").alias("redirects"), F.sum("n").alias("hops"), F.round(F.avg("n"), 6).alias("mean_chain"), F.max("n").alias("longest"), F.count_if(F.col("n") > 2).alias("diluted")).crossJoin(kinds)  # one row each


def redirect_loops(hops: DataFrame) -> DataFrame:
    """Chains that visit a url twice, and those whose first hop only adds or drops a trailing slash, or goes to itself."""
    per = hops.groupBy("url").agg(F.count("*").alias("n"), F.countDistinct("hop_url").alias("d"), F.count_if(F.col("hop_url") == F.col("url")).alias("own"))
    return per.select("url", "n", (F.col("d") < F.col("n")).alias("loop"), (F.col("own") > 1).alias("self_redirect"))


def canonicals(p: DataFrame) -> DataFrame:
    """One row of canonical measures over 200 pages; targets are looked up by exact url."""
    c = F.coalesce(F.col("canonical"), F.lit(""))
    t = indexability(p).select(F.col("url").alias("_t"), F.col("status_code").alias("_status"), F.col("indexable").alias("_indexable"))
    q = p.where(~F.col("robots_blocked") & (F.col("status_code") == 200)).withColumn("c", c).join(t, (c == F.col("_t")) & (c != ""), "left")
    has = F.col("c") != ""
    own = (trimmed(F.col("c")) == trimmed(F.col("url"))) | (trimmed(F.col("c")) == trimmed(F.col("final_url")))
    scheme = lambda u: F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    n = lambda x, name: F.count_if(has & F.coalesce(x, F.lit(False))).alias(name)
    return q.agg(n(has, "with_canonical"), F.count_if(~has).alias("without"), n(F.col("canonical_count") > 1, "multiple"), n(own, "self_referencing"), n(~own, "canonicalized"), n(F.col("_status") != 200, "to_non_200"), n(~F.col("_indexable"), "to_non_indexable"), n(host(F.col("url")) != host(F.col("c")), "cross_domain"), n(scheme(F.col("url")) != scheme(F.col("c")), "scheme_mismatch"), n(F.contains("c", F.lit("?")), "with_query"))


def canonical_targets(p: DataFrame, k: int = 20) -> DataFrame:
    t = p.where(~F.col("robots_blocked") & (F.col("status_code") == 200) & (F.coalesce(F.col("canonical"), F.lit("")) != "")).groupBy(F.col("canonical").alias("url")).agg(F.count("*").alias("pages"))
    return top(t, "pages", k)


def canonical_chains(p: DataFrame, depth: int = 10) -> DataFrame:
    """Pages whose canonical's canonical goes on, followed for up to ``depth`` steps: length of the chain and whether it loops."""
    step = p.where((F.coalesce(F.col("canonical"), F.lit("")) != "") & (F.col("canonical") != F.col("url"))).select(F.col("url").alias("_u"), F.col("canonical").alias("_c"))
    walk = step.select(F.col("_u").alias("url"), F.col("_c").alias("at"), F.lit(1).alias("n"), F.lit(False).alias("loop"))
    for _ in range(depth - 1):
        walk = walk.join(step, (F.col("at") == F.col("_u")) & ~F.col("loop"), "left").select("url", F.coalesce("_c", "at").alias("at"), (F.col("n") + F.col("_c").isNotNull().cast("int")).alias("n"), (F.col("loop") | F.coalesce(F.col("_c") == F.col("url"), F.lit(False))).alias("loop"))
    return walk.where(F.col("n") > 1).select("url", F.col("n").alias("steps"), "loop")


def vitals(p: DataFrame) -> DataFrame:
    """One row: means, good and poor counts of the three web vitals."""
    #: Fixed values: (column, good up to, poor beyond)
    limits = (("lcp", 2500, 4000), ("inp", 200, 500), ("cls", 0.1, 0.25))
    return p.agg(*[x for c, good, poor in limits for x in (F.round(F.avg(c), 4).alias(f"{c}_mean"), F.count_if(F.col(c) <= good).alias(f"{c}_good"), F.count_if(F.col(c) > poor).alias(f"{c}_poor"))])


def vital_class(value: Column, good: float, poor: float) -> Column:
    return F.when(value <= good, "good").when(value <= poor, "needs-improvement").otherwise("poor")


def search_totals(p: DataFrame) -> DataFrame:
    """One row: impressions, clicks, click rate, mean position, and pages with impressions but no click."""
    g = p.where(F.col("impressions").isNotNull())
    return g.agg(F.count("*").alias("pages"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), share(F.sum("clicks"), F.sum("impressions")).alias("ctr"), F.round(F.avg("position"), 6).alias("position"), F.count_if((F.col("impressions") > 0) & (F.col("clicks") == 0)).alias("zombies"))


def sessions_totals(p: DataFrame, k: int = 50) -> DataFrame:
    return p.where(F.col("sessions").isNotNull()).agg(F.count("*").alias("pages"), F.sum("sessions").alias("sessions"), F.count_if(F.col("sessions") == 0).alias("no_traffic"), F.sum(F.coalesce("visitors", F.lit(0))).cast("long").alias("visitors"))


def weights(p: DataFrame) -> DataFrame:
    """One row: whole-number mean weight, pages over 3 MiB, bodies over 2 MiB."""
    return p.where((F.col("status_code") == 200) & F.col("bytes").isNotNull()).agg(F.expr("sum(bytes) div count(*)").alias("mean_bytes"), F.count_if(F.col("bytes") > 3 * 1024 * 1024).alias("oversized"), F.count_if(F.col("body_bytes") > 2 * 1024 * 1024).alias("truncation_risk"))


def resource_weights(resources: DataFrame) -> DataFrame:
    """resources (url, kind, bytes) -> count and bytes per page and kind."""
    return resources.groupBy("url", "kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def funnel(p: DataFrame, by: str | None = None) -> DataFrame:
    """crawled, renderable, indexable, visible, active, non_indexable and shares; per ``by`` visible includes active."""
    c = classified(p).where(~F.col("robots_blocked"))
    is_ = lambda *x: F.count_if(F.col("classification").isin(*x))
    visible = is_("visible", "active") if by else is_("visible")
    measures = [F.count("*").alias("crawled"), F.count_if(F.col("status_code").between(200, 299)).alias("renderable"), is_("indexable", "visible", "active").alias("indexable"), visible.alias("visible"), is_("active").alias("active"), is_("non-indexable").alias("non_indexable"), share(is_("visible", "active") * 100, F.count("*")).alias("pct_visible"), share(is_("active") * 100, F.count("*")).alias("pct_active"), share(is_("indexable", "visible", "active") * 100, F.count("*")).alias("pct_indexable")]
    return c.groupBy(by).agg(*measures) if by else c.agg(*measures)


def freshness(p: DataFrame) -> DataFrame:
    a = F.col("age_days")
    return p.groupBy(F.when(a.isNull(), "undated").when(a <= 30, "30").when(a <= 90, "90").when(a <= 365, "365").when(a <= 730, "730").otherwise("older").alias("bucket")).agg(F.count("*").alias("pages"))


def sitemap_coverage(p: DataFrame, sitemap: DataFrame) -> DataFrame:
    """sitemap (url) against 200 pages, trailing slashes aside. One row."""
    s = sitemap.select(trimmed(F.col("url")).alias("k")).distinct().withColumn("in_map", F.lit(True))
    c = indexability(p).where(F.col("status_code") == 200).groupBy(trimmed(F.col("url")).alias("k")).agg(F.bool_or("indexable").alias("indexable")).withColumn("crawled", F.lit(True))
    both = s.join(c, "k", "full_outer")
    i, r = F.coalesce("in_map", F.lit(False)), F.coalesce("crawled", F.lit(False))
    return both.agg(F.count_if(i & r).alias("both"), F.count_if(r & ~i).alias("crawled_only"), F.count_if(i & ~r).alias("sitemap_only"), F.count_if(r & ~i & F.coalesce("indexable", F.lit(False))).alias("missing_from_sitemap"), F.count_if(r & i & ~F.coalesce("indexable", F.lit(True))).alias("non_indexable_in_sitemap"))


def sitemap_status(p: DataFrame, sitemap: DataFrame) -> DataFrame:
    s = sitemap.select(trimmed(F.col("url")).alias("_k")).distinct()
    return p.join(s, trimmed(F.col("url")) == F.col("_k"), "left_semi").groupBy("status_code").agg(F.count("*").alias("pages"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with ``place``, from 0 on, in the given order: range partitions, each one's count, and the place inside. Only the
    counts, one a partition, reach the driver."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = df.columns
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*cols, F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id() % 2**33).alias("_at"))
    dealt = stored(dealt, "numbered")
    before, counts = 0, []
    for r in sorted(dealt.groupBy("_part").count().collect()):
        counts += [F.lit(r["_part"]), F.lit(before)]
        before += r["count"]
    return dealt.select(*cols, (F.col("_at") + (F.create_map(*counts)[F.col("_part")] if counts else F.lit(0))).alias("place"))


def sitemap_entries(p: DataFrame, size: int = 50_000) -> DataFrame:
    """Eligible urls (200, indexable, their own canonical, without an error and no soft 404 where such columns are there) and the
    number of the sitemap file that each goes to."""
    bad = [~F.coalesce(F.col("soft_404"), F.lit(False))] * ("soft_404" in p.columns) + [F.coalesce(F.col("error"), F.lit("")) == ""] * ("error" in p.columns)
    p = p.where(reduce(lambda a, b: a & b, bad)) if bad else p
    own = (F.coalesce(F.col("canonical"), F.lit("")) == "") | (trimmed(F.col("canonical")) == trimmed(F.col("url")))
    e = indexability(p).where((F.col("status_code") == 200) & F.col("indexable") & own).select("url")
    return numbered(e, "url").select("url", (F.floor(F.col("place") / size) + 1).alias("file"))


def segments(p: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """rules (name, pattern): a page may be in several segments. Statistics per segment."""
    names = F.filter(F.array(*[F.when(F.col("url").rlike(pattern), name) for name, pattern in rules]), lambda x: x.isNotNull())
    s = classified(p).withColumn("segment", F.explode(names))
    return s.groupBy("segment").agg(F.count("*").alias("pages"), F.count_if(F.col("status_code") == 200).alias("ok"), F.count_if("indexable").alias("indexable"), F.round(F.avg("word_count"), 4).alias("words"), F.round(F.avg("response_ms"), 4).alias("response_ms"), F.sum(F.coalesce("clicks", F.lit(0))).cast("long").alias("clicks"))


def anchor_health(p: DataFrame, links: DataFrame) -> DataFrame:
    """Per 200 page with inbound links: diversity, generic, naked-url and over-optimised anchors."""
    ok = p.where(F.col("status_code") == 200).select("url")
    text = F.trim(F.coalesce(F.col("anchor"), F.lit("")))
    a = links.where("internal").join(ok.withColumnRenamed("url", "_src"), F.col("src") == F.col("_src"), "left_semi").select(trimmed(F.col("dst")).alias("t"), F.lower(text).alias("a"))
    a = a.withColumns({"generic": (F.col("a") == "") | F.col("a").isin(*GENERIC_ANCHORS), "naked": F.col("a").rlike("^https?://")})
    per = a.groupBy("t", "a", "generic", "naked").agg(F.count("*").alias("n"))
    all_ = per.groupBy("t").agg(F.sum("n").alias("links"), F.count_if(F.col("a") != "").alias("texts"), F.sum(F.when(F.col("generic"), F.col("n")).otherwise(0)).alias("generic"), F.sum(F.when(F.col("naked"), F.col("n")).otherwise(0)).alias("naked"))
    meaningful = F.col("links") - F.col("generic") - F.col("naked")
    hot = per.where(~F.col("generic") & ~F.col("naked")).select(F.col("t").alias("_t"), F.col("n").alias("_n")).join(all_, F.col("_t") == F.col("t")).where((meaningful > 3) & (F.col("_n") > 0.5 * meaningful)).groupBy("_t").agg(F.count("*").alias("over"))
    per_target = all_.join(hot, F.col("t") == F.col("_t"), "left").select("t", F.round(F.col("texts") / F.col("links"), 6).alias("diversity"), F.col("generic").cast("long").alias("generic"), F.col("naked").cast("long").alias("naked"), F.coalesce("over", F.lit(0)).alias("over_optimised"))
    return ok.join(per_target, trimmed(F.col("url")) == F.col("t")).drop("t")


def anchor_cloud(links: DataFrame, k: int = 300) -> DataFrame:
    """Anchor texts of 2 to 80 characters by number of links."""
    t = F.trim(F.coalesce(F.col("anchor"), F.lit("")))
    a = links.select(t.alias("text"), "internal").where(F.char_length("text").between(2, 80))
    a = a.groupBy("text").agg(F.count("*").alias("links"), F.bool_or("internal").alias("internal")).withColumn("generic", F.lower("text").isin(*GENERIC_ANCHORS))
    return top(a, "links", k, "text")


def directory_tree(p: DataFrame, depth: int = 15) -> DataFrame:
    """Every directory with the measures of all pages under it."""
    path = F.split_part(F.regexp_replace("url", r"^[a-zA-Z]+://[^/]*", ""), F.lit("?"), F.lit(1))
    seg = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(seg), F.lit(depth))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(seg, F.lit(1), i), "/")))
    return p.select("status_code", "word_count", F.explode(prefixes).alias("directory")).groupBy("directory").agg(F.count("*").alias("pages"), F.count_if(F.col("status_code") == 200).alias("ok"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.sum("word_count").alias("words"))


def directory_children(p: DataFrame, k: int = 20) -> DataFrame:
    """First-level directories: the k largest, and the rest as 'other'."""
    first = F.split_part(F.split_part(F.regexp_replace("url", r"^[a-zA-Z]+://[^/]*", ""), F.lit("?"), F.lit(1)), F.lit("/"), F.lit(2))
    d = p.groupBy(first.alias("directory")).agg(F.count("*").alias("pages"))
    chosen = top(d, "pages", k, "directory").select(F.col("directory").alias("_d"))
    return d.join(F.broadcast(chosen), F.col("directory") == F.col("_d"), "left").groupBy(F.coalesce("_d", F.lit("other")).alias("directory")).agg(F.sum("pages").alias("pages"))  # k rows


ISSUES = ("5xx", "missing-title", "missing-description", "missing-h1", "multiple-h1", "title-too-long", "title-too-short", "desc-too-long", "deep", "missing-canonical", "duplicate-titles", "duplicate-descriptions")


def issue(name: str) -> Column:
    """Predicate of an issue; duplicates need the columns title_pages and description_pages. Unknown names match nothing."""
    c, size, desc = F.col, F.char_length("title"), F.char_length("description")
    rules = {
        "5xx": lambda: c("status_code") >= 500,
        "missing-title": lambda: F.coalesce(c("title"), F.lit("")) == "",
        "missing-description": lambda: F.coalesce(c("description"), F.lit("")) == "",
        "missing-h1": lambda: c("h1_count") == 0,
        "multiple-h1": lambda: c("h1_count") > 1,
        "title-too-long": lambda: size > 60,
        "title-too-short": lambda: (size > 0) & (size < 30),
        "desc-too-long": lambda: desc > 160,
        "deep": lambda: c("depth") > 4,
        "missing-canonical": lambda: c("canonical").isNull(),
        "duplicate-titles": lambda: c("title_pages") > 1,
        "duplicate-descriptions": lambda: c("description_pages") > 1,
    }
    return F.coalesce(rules[name](), F.lit(False)) if name in rules else F.lit(False)


def with_duplicate_counts(p: DataFrame) -> DataFrame:
    for column in ("title", "description"):
        n = p.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.col(column).alias("_v")).agg(F.count("*").alias(f"{column}_pages"))
        p = p.join(n, F.col(column) == F.col("_v"), "left").drop("_v")
    return p


def issue_counts(p: DataFrame) -> DataFrame:
    """Pages per issue, in long form."""
    one = with_duplicate_counts(p).agg(*[F.count_if(issue(i)).alias(i) for i in ISSUES])
    return one.unpivot([], list(ISSUES), "issue", "pages")


CUMULATIVE = {"indexable": ("indexable", "visible", "active"), "visible": ("visible", "active")}


def filtered(p: DataFrame, search: str = "", status: str = "", indexable: str = "", template: str = "", classification: str = "", problem: str = "", robots_blocked: str = "") -> DataFrame:
    """The pages that all filters keep, classified."""
    p = classified(p)
    p = with_duplicate_counts(p) if problem.startswith("duplicate") else p
    keep = [F.lit(True)]
    if status not in ("", "all"):
        keep.append(status_filter(status))
    for value, column in ((indexable, "indexable"), (robots_blocked, "robots_blocked")):
        keep += [F.col(column) == (value == "yes")] if value in ("yes", "no") else []
    if template not in ("", "all"):
        keep.append(F.col("template") == template)
    if classification not in ("", "all", "crawled"):
        keep.append(F.col("classification").isin(*CUMULATIVE.get(classification, (classification,))))
    if problem:
        keep.append(issue(problem))
    if search:
        keep.append(F.contains(F.lower("url"), F.lit(search.lower())))
    return p.where(reduce(lambda a, b: a & b, keep))


def query(p: DataFrame, sort: str = "url", descending: bool = False, offset: int = 0, limit: int = 100, **filters: str) -> DataFrame:
    """The page list: all filters hold, then sort with url as tie-break, then offset and limit (500 at most)."""
    return filtered(p, **filters).orderBy(F.desc(sort) if descending else F.asc(sort), "url").offset(offset).limit(min(limit, 500))


def status_filter(token: str, column: str = "status_code") -> Column:
    """``404`` or ``4xx``; 5xx is open upwards; anything else matches nothing."""
    c = F.col(column)
    if token.isdigit():
        return c == int(token)
    if len(token) == 3 and token.endswith("xx") and token[0] in "2345":
        low = int(token[0]) * 100
        return c >= low if low == 500 else c.between(low, low + 99)
    return F.lit(False)


def health(c: DataFrame) -> DataFrame:
    """c: one row with total, indexable, ok, no_title, no_description, no_h1, duplicates, dead_ends, p90, insecure, with_schema,
    images, images_missing_alt -> score, 0 to 100, one decimal."""
    total = F.col("total").cast("double")
    part = lambda x: F.col(x) / total * 100
    rest = lambda x: (1 - F.least(F.col(x) / total, F.lit(1.0))) * 100
    speed = F.when(F.col("p90") > 3000, 0.0).when(F.col("p90") > 1000, 100 * (1 - (F.col("p90") - 1000) / 2000)).otherwise(100.0)
    alt = F.when(F.col("images") > 0, (1 - F.col("images_missing_alt") / F.col("images")) * 100).otherwise(100.0)
    score = part("indexable") * 0.15 + part("ok") * 0.15 + rest("no_title") * 0.10 + rest("no_description") * 0.08 + rest("no_h1") * 0.07 + rest("duplicates") * 0.10 + rest("dead_ends") * 0.10 + speed * 0.10 + rest("insecure") * 0.05 + part("with_schema") * 0.05 + alt * 0.05
    return c.select(F.when(F.col("total") == 0, 0.0).otherwise(F.round(score, 1)).alias("score"))


def health_inputs(p: DataFrame, links: DataFrame) -> DataFrame:
    """The one row that health() and alerts() read."""
    i = indexability(p)
    base = i.agg(F.count("*").alias("total"), F.count_if(F.col("indexable") & ~F.col("robots_blocked")).alias("indexable"), F.count_if(F.col("status_code").between(200, 299)).alias("ok"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.count_if(F.col("status_code") >= 500).alias("server_errors"), F.count_if(~F.startswith("url", F.lit("https://")) | F.col("mixed_content")).alias("insecure"))
    c = counters(p).select("blocked", "no_title", "no_description", "no_h1", "with_schema", "images", "images_missing_alt")
    d = [duplicates(p, column).agg(F.coalesce(F.sum("pages"), F.lit(0)).alias(name)) for column, name in (("content_hash", "duplicates"), ("title", "duplicate_titles"), ("description", "duplicate_descriptions"))]
    f = funnel(p).select("crawled", "pct_indexable", "pct_active")
    o = orphans(p, links, "").agg(F.count("*").alias("orphans"))
    return reduce(lambda a, b: a.crossJoin(b), [base, c, link_analysis(p, links).select("dead_ends"), response_times(p).select("p90"), *d, f, o])  # one row each


def alerts(c: DataFrame) -> DataFrame:
    """Alerts that fire, with severity and value."""
    rate = lambda x: F.col(x) / F.col("total") * 100.0
    rules = (("high-error-rate", "critical", rate("errors"), 10, 1), ("high-5xx-rate", "critical", rate("server_errors"), 2, 1), ("low-indexability", "warning", F.col("pct_indexable"), 70, -1), ("slow-response-time", "warning", F.col("p90"), 3000, 1), ("duplicate-titles", "warning", rate("duplicate_titles"), 10, 1), ("duplicate-descriptions", "warning", rate("duplicate_descriptions"), 10, 1), ("missing-titles", "warning", rate("no_title"), 5, 1), ("missing-descriptions", "info", rate("no_description"), 10, 1), ("orphan-pages", "warning", rate("orphans"), 5, 1), ("low-active-rate", "info", F.col("pct_active"), 5, -1))
    fired = F.array(*[F.when((v * sign > limit * sign) & (F.col("total") > 0), F.struct(F.lit(name).alias("id"), F.lit(severity).alias("severity"), F.round(v, 4).alias("value"))) for name, severity, v, limit, sign in rules])
    return c.select(F.explode(F.filter(fired, lambda x: x.isNotNull())).alias("a")).select("a.*")


def budgeted(p: DataFrame, budgets: dict[str, int], order: str) -> DataFrame:
    """rule, pages, kept and last_kept: the first urls, by ``order``, of each path prefix up to its budget; the longest prefix that fits
    counts. Only as many rows as the largest budget are ranked, Spark cuts each partition's before it shuffles them."""
    rule = budget_rule(F.col("url"), list(budgets))
    q = p.select(F.col(order).alias("_o"), rule.alias("rule")).where(F.col("rule").isNotNull())
    most = F.lit(0)
    for name, n in budgets.items():
        most = F.when(F.col("rule") == name, n).otherwise(most)
    first = q.withColumn("r", F.row_number().over(Window.partitionBy("rule").orderBy("_o"))).where(F.col("r") <= max(budgets.values())).where(F.col("r") <= most)
    kept = first.groupBy(F.col("rule").alias("_r")).agg(F.count("*").alias("kept"), F.max("_o").alias("last_kept"))
    return q.groupBy("rule").agg(F.count("*").alias("pages")).join(kept, F.col("rule") == F.col("_r"), "left").select("rule", "pages", F.coalesce("kept", F.lit(0)).alias("kept"), "last_kept")
