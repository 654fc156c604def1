"""Log urls against crawled pages.

A crawled page answers to its path, that path with or without a trailing slash, and its percent-decoded
form; a log path is looked up whole first, then without its query. Of several pages under one key the
closest variant wins, then the least url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from . import pages as P
from .logs import status_group


KEPT = ("crawl_path", "url", "final_url", "status_code", "canonical", "indexable")


def crawl_keys(p: DataFrame) -> DataFrame:
    """key and KEPT of the page that answers to each key: of the variants that make a key the closest, then the least url. One
    aggregate, whose rows are cut down before they are shuffled."""
    path = U.path_and_query(F.col("url"))
    other = lambda x: F.when(F.endswith(x, F.lit("/")), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(F.concat(x, F.lit("/")))
    raw = F.concat(F.when(U.raw_path(F.col("url")) == "", "/").otherwise(U.raw_path(F.col("url"))), F.when(U.query(F.col("url")) != "", F.concat(F.lit("?"), U.query(F.col("url")))).otherwise(""))
    q = P.classified(p).withColumn("crawl_path", path).withColumn("_raw", raw).select(*KEPT, "_raw")
    forms = F.array_distinct(F.array(F.col("crawl_path"), other(F.col("crawl_path")), F.col("_raw"), other(F.col("_raw"))))
    k = q.select(*KEPT, F.posexplode(forms).alias("rank", "key")).where(F.col("key") != "")
    best = k.groupBy("key").agg(F.min(F.struct("rank", "url", F.struct(*KEPT).alias("row"))).alias("m"))
    return best.select("key", "m.row.*")


def segment(bot_hits: Column) -> tuple[Column, Column]:
    """(segment, reason) of a matched log url: the first rule that fits."""
    c = F.col
    to = F.substring(U.path_and_query(c("canonical")), 1, 80)
    code = c("status_code").cast("string")
    other = (F.coalesce(c("canonical"), F.lit("")) != "") & (U.path_and_query(c("canonical")) != c("crawl_path"))
    waste = F.when(bot_hits > 0, "crawl_waste").otherwise("crawled_not_indexed")
    rules = (
        (c("status_code").between(300, 399) | (c("final_url") != c("url")), F.lit("redirect_waste"), F.concat(F.lit("redirect, HTTP "), code, F.when(F.coalesce(c("canonical"), F.lit("")) != "", F.concat(F.lit(", by way of "), F.substring("canonical", 1, 80))).otherwise(""))),
        (c("status_code") >= 400, F.lit("error_pages"), F.concat(F.lit("the crawler was answered with HTTP "), code)),
        (~c("indexable"), waste, F.when(bot_hits > 0, "not indexable, yet bots spend their budget on it").otherwise("not indexable")),
        (other & (bot_hits > 0), F.lit("crawl_waste"), F.concat(F.lit("bots read a copy whose canonical is "), to)),
        (other, F.lit("healthy"), F.concat(F.lit("canonical is "), to)),
    )
    kind, why = F.lit("healthy"), F.when(bot_hits > 0, "indexable, bots come").otherwise("indexable, in the crawl")
    for test, name, reason in reversed(rules):
        kind, why = F.when(test, name).otherwise(kind), F.when(test, reason).otherwise(why)
    return kind, why


def merged(log_urls: DataFrame, p: DataFrame) -> DataFrame:
    """path, in_logs, in_crawl, hits, bot_hits, log_status, crawl_status, segment, reason, mismatch: log urls, then crawled paths
    that no log url met, once each."""
    k = crawl_keys(p)
    whole = log_urls.select(F.col("path"), "hits", "bot_hits", F.col("status").alias("log_status"), F.split_part("path", F.lit("?"), F.lit(1)).alias("bare"))
    tries = whole.select("*", F.explode(F.array(F.struct(F.lit(0).alias("t"), F.col("path").alias("key")), F.struct(F.lit(1).alias("t"), F.col("bare").alias("key")))).alias("x")).select("*", "x.t", F.col("x.key").alias("_key")).drop("x")
    found = tries.join(k, F.col("_key") == F.col("key"))
    best = found.groupBy("path").agg(F.min_by(F.struct("crawl_path", "url", "final_url", "status_code", "canonical", "indexable"), "t").alias("m")).select(F.col("path").alias("_p"), "m.*")
    kind, why = segment(F.col("bot_hits"))
    logs = whole.join(best, F.col("path") == F.col("_p"), "left").select("path", F.lit(True).alias("in_logs"), F.col("_p").isNotNull().alias("in_crawl"), "hits", "bot_hits", "log_status", F.col("status_code").alias("crawl_status"), F.when(F.col("_p").isNull(), "orphan_crawled").otherwise(kind).alias("segment"), F.when(F.col("_p").isNull(), "bots reach this url, the crawl found no link to it").otherwise(why).alias("reason"), F.coalesce((F.col("log_status") > 0) & (status_group(F.col("log_status")) != status_group(F.col("status_code"))), F.lit(False)).alias("mismatch"))
    met = best.select(F.col("crawl_path").alias("_met")).distinct()
    ghosts = P.classified(p).select(U.path_and_query(F.col("url")).alias("path"), "status_code", "url").join(met, F.col("path") == F.col("_met"), "left_anti").groupBy("path").agg(F.min_by("status_code", "url").alias("crawl_status"))
    none = F.lit(0).cast("long")
    ghosts = ghosts.select("path", F.lit(False).alias("in_logs"), F.lit(True).alias("in_crawl"), none.alias("hits"), none.alias("bot_hits"), F.lit(None).cast("int").alias("log_status"), "crawl_status", F.lit("uncrawled_indexable").alias("segment"), F.lit("in the crawl, no bot came in the time of the logs").alias("reason"), F.lit(False).alias("mismatch"))
    return logs.unionByName(ghosts)


def summary(m: DataFrame) -> DataFrame:
    return m.groupBy("segment").agg(F.count("*").alias("pages"), F.sum("hits").alias("hits"), F.sum("bot_hits").alias("bot_hits"), F.count_if("mismatch").alias("mismatches"))


#: Rows of each segment that a summary shows.
SHOWN = {"crawl_waste": 200, "orphan_crawled": 200, "uncrawled_indexable": 200, "redirect_waste": 100}


def samples(m: DataFrame, otherwise: int = 50) -> DataFrame:
    """The rows of each segment that bots visit most, as many as a summary shows; ``summary`` counts them all."""
    best = Window.partitionBy("segment").orderBy(F.desc("bot_hits"), F.desc("hits"), "path")
    most = F.lit(otherwise)
    for name, n in SHOWN.items():
        most = F.when(F.col("segment") == name, n).otherwise(most)
    return m.withColumn("place", F.row_number().over(best)).where(F.col("place") <= max(SHOWN.values())).where(F.col("place") <= most)


def query(m: DataFrame, segment_name: str | None = None, search: str = "", status: str = "", coverage: str = "", sort: str = "bot_hits", descending: bool = True, offset: int = 0, limit: int = 100) -> DataFrame:
    """Page of merge rows; path breaks ties."""
    out = m.where(F.contains("path", F.lit(search)))
    out = out.where(F.col("segment") == segment_name) if segment_name else out
    out = out.where(P.status_filter(status, "crawl_status")) if status else out
    cover = {"crawl_only": ~F.col("in_logs"), "logs_only": ~F.col("in_crawl"), "both": F.col("in_logs") & F.col("in_crawl")}
    out = out.where(cover[coverage]) if coverage in cover else out
    return out.orderBy(F.desc(sort) if descending else F.asc(sort), "path").offset(offset).limit(min(limit, 500))
