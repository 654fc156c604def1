"""Metric tables joined to pages, summaries of extracted signals, issue cards, further health scores, similar vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import stored
from ..functions import text as T
from ..functions import urls as U
from .graph import components
from .pages import share


def search_rollup(daily: DataFrame, first: str, last: str) -> DataFrame:
    """daily (url, day, impressions, clicks, sum_position) over a span of days -> per url sums and mean position."""
    d = daily.where(F.col("day").between(first, last)).groupBy("url").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.sum("sum_position").alias("p"))
    return d.select("url", "impressions", "clicks", share(F.col("clicks"), F.col("impressions")).alias("ctr"), F.round(F.try_divide("p", "impressions"), 6).alias("position"))


def query_cost(n_urls: int, days: int, row_bytes: int = 200, rows_per_url: int = 20, price_per_tb: float = 6.25) -> tuple[int, float]:
    """Megabytes that a search-export query reads, and its price."""
    size = n_urls * days * row_bytes * rows_per_url
    return size // 2**20, round(size / 2**40 * price_per_tb, 4)


def enriched(pages: DataFrame, metrics: DataFrame, columns: list[str], by_path: bool = False) -> DataFrame:
    """pages with a metric table's columns, by normalised url, or by lower-cased path: then every url of a path gets them. Of rows
    with one key the sums count."""
    key = U.path_key if by_path else U.metric_key
    m = metrics.groupBy(key(F.col("url")).alias("_key")).agg(*[F.sum(c).alias(f"m_{c}") for c in columns])
    return pages.withColumn("_k", key(F.col("url"))).join(m, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")


def ai_pages(seen: DataFrame, k: int = 50) -> DataFrame:
    """seen (url, query, impressions, clicks, position) -> the k pages with most clicks."""
    p = seen.groupBy("url").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.count("*").alias("queries"))
    return p.withColumn("ctr", share(F.col("clicks"), F.col("impressions"))).orderBy(F.desc("clicks"), "url").limit(k)


def ai_queries(seen: DataFrame, k: int = 50) -> DataFrame:
    """The k queries with most clicks; position is weighted by impressions."""
    q = seen.groupBy("query").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.sum(F.col("position") * F.col("impressions")).alias("w"))
    return q.select("query", "impressions", "clicks", F.round(F.try_divide("w", "impressions"), 6).alias("position"), share(F.col("clicks"), F.col("impressions")).alias("ctr")).orderBy(F.desc("clicks"), "query").limit(k)


def score_summary(p: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Mean of a 0-1 score over 200 pages, and pages under and over two limits: richness, readiness, topicality."""
    c = F.col(column)
    return p.where((F.col("status_code") == 200) & c.isNotNull()).agg(F.count("*").alias("pages"), F.round(F.avg(c), 6).alias("mean"), F.count_if(c < low).alias("low"), F.count_if(c > high).alias("high"))


def trust_summary(p: DataFrame) -> DataFrame:
    """p (author, has_about, has_contact, citations): distinct authors, coverage in per cent, whether any page has each signal."""
    a = F.coalesce(F.col("author"), F.lit("")) != ""
    return p.agg(F.countDistinct(F.when(a, F.col("author"))).alias("authors"), share(F.count_if(a) * 100, F.count("*"), 4).alias("author_coverage"), F.bool_or("has_about").alias("about"), F.bool_or("has_contact").alias("contact"), F.sum("citations").alias("citations"))


def passage_summary(p: DataFrame) -> DataFrame:
    """p (status_code, passages struct): means and numbers of pages over 200 pages that have passages."""
    x = p.where((F.col("status_code") == 200) & F.col("passages").isNotNull()).select("passages.*")
    return x.agg(F.count("*").alias("pages"), F.round(F.avg("score"), 6).alias("score"), F.round(F.avg("sections"), 6).alias("sections"), F.count_if("faq").alias("faq"), F.count_if("howto").alias("howto"), F.count_if("definitions").alias("definitions"))


def answer_summary(p: DataFrame) -> DataFrame:
    """p (status_code, answers struct): the same for answer readiness."""
    x = p.where((F.col("status_code") == 200) & F.col("answers").isNotNull()).select("answers.*")
    return x.agg(F.count("*").alias("pages"), F.round(F.avg("score"), 6).alias("score"), F.count_if("concise").alias("concise"), F.count_if("structured").alias("structured"), F.count_if("faq").alias("faq"), F.count_if("howto").alias("howto"))


def topicality_summary(t: DataFrame) -> DataFrame:
    """t as topicality() gives it: mean overlaps, pages of low (under 0.3) and of full (0.9 or more) consistency."""
    return t.agg(F.count("*").alias("pages"), F.round(F.avg("title_body"), 6).alias("title_body"), F.round(F.avg("title_h1"), 6).alias("title_h1"), F.round(F.avg("consistency"), 6).alias("consistency"), F.count_if(F.col("consistency") < 0.3).alias("low"), F.count_if(F.col("consistency") >= 0.9).alias("full"))


def with_anchors(t: DataFrame, titles: DataFrame, anchors: DataFrame) -> DataFrame:
    """t as topicality() gives it, with anchor_title and consistency made anew where descriptive internal links (href, text) lead to
    a page: the mean share of a link text's terms that titles (url, title) hold."""
    own = titles.select(F.col("url").alias("_u"), T.terms(F.col("title")).alias("_t")).where(F.size("_t") > 0)
    said = anchors.select("href", T.terms(F.col("text")).alias("_a")).where(F.size("_a") > 0).join(own, F.col("href") == F.col("_u"))
    share_ = F.size(F.filter("_a", lambda x: F.array_contains(F.col("_t"), x))) / F.size("_a")
    per = said.groupBy("_u").agg(F.round(F.avg(share_), 3).alias("_r"))
    body = 0.3 * F.col("title_body") + 0.2 * F.col("title_h1") + 0.2 * F.col("heading_body")
    out = t.join(per, F.col("url") == F.col("_u"), "left")
    return out.withColumns({"anchor_title": F.coalesce("_r", "anchor_title"), "consistency": F.when(F.col("_r").isNull(), F.col("consistency")).otherwise(F.round(body + 0.3 * F.col("_r"), 3))}).drop("_u", "_r")


def topicality(p: DataFrame) -> DataFrame:
    """p (url, title, h1, headings, body, anchor) -> overlaps of title, heading and anchor terms with the body, and their
    weighted sum. ``consistency`` has the anchors' part, ``body_only`` leaves it out. Pages of under 30 words or without a
    title have none."""
    t, b, h = T.terms(F.col("title")), F.array_distinct(T.terms(F.col("body"))), T.terms(F.coalesce(F.col("h1"), F.lit("")))
    q = p.where((F.coalesce(F.col("title"), F.lit("")) != "") & (F.size(T.fields(F.col("body"))) >= 30)).select("url", t.alias("t"), b.alias("b"), h.alias("h"), F.array_distinct(T.terms(F.coalesce(F.col("headings"), F.lit("")))).alias("hs"), T.terms(F.coalesce(F.col("anchor"), F.lit(""))).alias("a"))
    cover = lambda x: F.round(F.coalesce(F.try_divide(F.size(F.filter(x, lambda y: F.array_contains(F.col("b"), y))), F.size(x)), F.lit(0.0)), 3)
    m = q.select("url", cover(F.col("t")).alias("title_body"), T.jaccard(F.col("t"), F.col("h")).alias("title_h1"), cover(F.col("hs")).alias("heading_body"), T.jaccard(F.col("t"), F.col("a")).alias("anchor_title"))
    body = 0.3 * F.col("title_body") + 0.2 * F.col("title_h1") + 0.2 * F.col("heading_body")
    return m.withColumns({"body_only": F.round(body, 3), "consistency": F.round(body + 0.3 * F.col("anchor_title"), 3)})


#: Column of the health inputs, severity and category of each issue card.
CARDS = (("errors", "critical", "http"), ("server_errors", "critical", "http"), ("no_title", "critical", "content"), ("no_description", "warning", "content"), ("no_h1", "warning", "content"), ("duplicate_titles", "warning", "content"), ("duplicate_descriptions", "warning", "content"), ("duplicates", "warning", "content"), ("dead_ends", "warning", "links"), ("orphans", "warning", "links"), ("insecure", "warning", "security"), ("images_missing_alt", "info", "images"))


def issue_cards(c: DataFrame) -> DataFrame:
    """Issues that occur, with severity, category and number."""
    cards = F.array(*[F.struct(F.lit(n).alias("issue"), F.lit(s).alias("severity"), F.lit(g).alias("category"), F.col(n).cast("long").alias("pages")) for n, s, g in CARDS])
    return c.select(F.explode(F.filter(cards, lambda x: x["pages"] > 0)).alias("x")).select("x.*")


def card_score(c: DataFrame) -> DataFrame:
    """The dashboard's score: indexable 25, titles 15, descriptions 15, first headings 10, fast answers 10, broken links 10,
    canonicals 10, orphans 5."""
    total = F.col("total").cast("double")
    part = lambda x, n: F.least(F.lit(1.0), x / total) * n
    speed = F.coalesce(F.try_divide(F.col("fast") * 10.0, F.col("fast") + F.col("medium") + F.col("slow") + F.col("slowest")), F.lit(5.0))
    score = part(F.col("indexable"), 25) + part(total - F.col("no_title"), 15) + part(total - F.col("no_description"), 15) + part(total - F.col("no_h1"), 10) + speed + F.greatest(F.lit(0.0), 10 - F.col("errors") * 0.5) + part(F.col("with_canonical"), 10) + F.greatest(F.lit(0.0), 5 - F.col("orphans") * 0.25)
    return c.select(F.when(F.col("total") > 0, F.round(score)).otherwise(-1).cast("int").alias("score"))


def hreflang_issues(h: DataFrame) -> DataFrame:
    """h (url, lang, href) -> url, issue: no entry for the page itself, no x-default, a target that does not link back."""
    own = h.groupBy("url").agg(F.bool_or(U.comparison_form(F.col("href")) == U.comparison_form(F.col("url"))).alias("own"), F.bool_or(F.lower("lang") == "x-default").alias("default"))
    a = own.where(~F.col("own")).select("url", F.lit("missing-self").alias("issue"))
    b = own.where(~F.col("default")).select("url", F.lit("missing-x-default").alias("issue"))
    back = h.select(F.col("url").alias("_from"), F.col("href").alias("_to")).distinct()
    pages = h.select(F.col("url").alias("_page")).distinct()
    c = h.where(F.col("href") != F.col("url")).join(pages, F.col("href") == F.col("_page"), "left_semi").join(back, (F.col("href") == F.col("_from")) & (F.col("url") == F.col("_to")), "left_anti").select("url", F.lit("missing-return-link").alias("issue"))
    return a.unionByName(b).unionByName(c).distinct()


def response_ema(hits: DataFrame, key: str, alpha: float = 0.3) -> DataFrame:
    """Exponential moving average of response times per key at the last hit: the recursion written out as weights by place. Only
    the last hits that a double can tell are read, 1e-20 of the weight lies beyond, so a key with most hits is not sorted whole."""
    last = math.ceil(math.log(1e-20) / math.log(1 - alpha))
    back = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq"))
    h = hits.select(key, "ts", "seq", "response_time").withColumn("r", F.row_number().over(back)).where(F.col("r") <= last)
    n = hits.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n"))
    w = F.when(F.col("r") == F.col("n"), F.pow(F.lit(1 - alpha), F.col("n") - 1)).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("r") - 1))
    return h.join(n, F.col(key) == F.col("_k")).groupBy(key).agg(F.round(F.sum(w * F.col("response_time")), 6).alias("ema"), F.max("n").alias("hits"))


#: Factors of the adaptive delay, and answers that it waits for before it changes.
BACK_OFF, SLOWER, FASTER, LEAST_ANSWERS = 2.0, 1.3, 0.9, 3


def next_delay(delay: Column, status: Column, response_ms: Column, mean_ms: Column, answers: Column, streak: Column, reset_s: Column, remaining: Column, recent_429: Column, least: float, most: float, factor: float = 0.0, slow: float = 2.0, fast: float = 0.5) -> Column:
    """The delay between requests to a host after one more answer, in ms: doubled after 429 (or up to the stated reset), raised with
    the streak of errors after 503 and 504, else a multiple of the mean response if ``factor`` is set, slower after an answer of
    ``slow`` times the mean, faster after one of ``fast`` times it unless a 429 is recent, or while requests remain."""
    backed = F.greatest(delay * BACK_OFF, F.coalesce(reset_s, F.lit(0)) * 1000.0)
    overload = delay * F.least(F.lit(BACK_OFF), 1.5 + 0.5 * streak)
    if factor > 0:
        calm = F.lit(factor) * mean_ms
    else:
        quick = (response_ms < mean_ms * fast) & ~recent_429
        calm = F.when(response_ms > mean_ms * slow, delay * SLOWER).when(quick | (F.coalesce(remaining, F.lit(0)) > 10), delay * FASTER).otherwise(delay)
    calm = F.when(answers < LEAST_ANSWERS, delay).otherwise(F.greatest(F.lit(least), calm))
    new = F.when(status == 429, backed).when(status.isin(503, 504), overload).when(status.between(200, 399), calm).otherwise(delay)
    return F.least(F.lit(most), new)


#: Rows of a block of vectors, blocks of smaller tables (one up to FEW rows), rows that are multiplied at once, and what single
#: precision may be off.
BLOCK, LEAST_BLOCKS, FEW, STRIP, OFF = 32_768, 5, 2_000, 512, 1e-4


def _alike(least: float, k: int | None):
    """Of the table of two blocks: pairs of ids a < b from either, or within the one, of rounded cosine ``least`` or more; the k
    first if k is set. Products in single precision leave out what is surely less; the rest are summed as SQL sums them."""

    def order(a, b, s):
        at = np.lexsort((b, a, -s))[:k]
        return a[at], b[at], s[at]

    def run(key, t):
        side, ids = t["side"].to_numpy(), t["id"].to_numpy()
        v = t["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        norm = np.zeros(len(ids))
        for x in v.T:
            norm += x * x
        unit = (v / np.sqrt(norm)[:, None]).astype(np.float32)
        left = np.flatnonzero(side == key[0].as_py())
        right = left if key[0] == key[1] else np.flatnonzero(side == key[1].as_py())
        other, found = np.ascontiguousarray(unit[right].T), [(np.empty(0, np.int64),) * 3]
        for at in range(0, len(left), STRIP):
            i, j = np.nonzero(unit[left[at : at + STRIP]] @ other >= least - OFF)
            i, j = left[i + at], right[j]
            if key[0] == key[1]:
                i, j = i[ids[i] < ids[j]], j[ids[i] < ids[j]]
            for part in range(0, len(i), 1 << 18):
                p, q = i[part : part + (1 << 18)], j[part : part + (1 << 18)]
                dot = np.zeros(len(p))
                for x in v.T:
                    dot += x[p] * x[q]
                c = dot / np.sqrt(norm[p] * norm[q])
                s = (np.sign(c) * np.floor(np.abs(c) * 1e6 + 0.5)).astype(np.int64)
                on = s / 1e6 >= least
                a, b = ids[p[on]], ids[q[on]]
                found.append((np.minimum(a, b), np.maximum(a, b), s[on]))
                if k is not None:
                    found = [order(*map(np.concatenate, zip(*found, strict=True)))]
        a, b, s = map(np.concatenate, zip(*found, strict=True))
        return pa.table({"a": a, "b": b, "similarity": s / 1e6})

    return run


def similar_pairs(v: DataFrame, least: float = 0.9, k: int | None = 100) -> DataFrame:
    """v (id, v): pairs a < b of cosine ``least`` or more, for ``least`` over 0. Vectors are dealt to blocks by their ids, and each
    two blocks are one task's matrix product; a row is copied once per block. Vectors that are zero, or hold a null, take no part."""
    rows = v.withColumn("_n", F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda s, x: s + x)).where((F.col("_n") > 0) & (F.col("_n") < math.inf)).select("id", "v")
    n = v.count()
    blocks = max(-(-n // BLOCK), LEAST_BLOCKS if n > FEW else 1)
    dealt = rows.withColumn("side", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    to = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(o, F.col("side")).alias("i"), F.greatest(o, F.col("side")).alias("j"))))
    tasks = dealt.select("id", "v", "side", to.alias("x")).select("id", "v", "side", "x.i", "x.j").repartition(4 * blocks * (blocks + 1) // 2, "i", "j")
    pairs = tasks.groupBy("i", "j").applyInArrow(_alike(least, k), "a long, b long, similarity double")
    return pairs if k is None else pairs.orderBy(F.desc("similarity"), "a", "b").limit(k)


def similar_groups(pairs: DataFrame, k: int = 50) -> DataFrame:
    """Components of similar pairs: size and mean similarity over all member pairs, those under the limit counting 0."""
    pairs = stored(pairs, "similar")  # read twice
    c = components(pairs.select("a", "b"))
    size = c.groupBy(F.col("root").alias("group_id")).agg(F.count("*").alias("size"))
    parts = pairs.groupBy("a").agg(F.sum(F.round(F.col("similarity") * 1e6).cast("long")).alias("_s"))  # whole millionths: any order gives one sum
    sums = parts.join(c, F.col("a") == F.col("id")).groupBy(F.col("root").alias("_r")).agg((F.sum("_s") / 1e6).alias("s"))
    return size.join(sums, F.col("group_id") == F.col("_r")).select("group_id", "size", F.round(F.col("s") / (F.col("size") * (F.col("size") - 1) / 2), 4).alias("mean_similarity")).orderBy(F.desc("size"), "group_id").limit(k)


def render_stats(diffs: DataFrame) -> DataFrame:
    """diffs (url, field): pages per field; title, canonical, robots and first headings are critical."""
    critical: Column = F.col("field").isin("title", "canonical", "robots", "metaRobots", "meta_robots", "h1")
    return diffs.groupBy("field", critical.alias("critical")).agg(F.countDistinct("url").alias("pages"))
