"""Access-log operators. Input ``hits``: seq, ip, ts, method, path, status, bytes, referer, user_agent, response_time.

Every aggregate is a plain hash aggregate with map-side combine. Lists have a unique tie-break. The last
status of a url is that of its greatest (ts, seq); its top bot is the exact most frequent, ties to the
smaller name.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bots

#: Crawl-waste classes, first match wins.
WASTE = (
    ("resources", r"\.(css|js|woff2?|ttf|eot|svg|png|jpg|jpeg|gif|webp|ico|mp4|mp3|pdf|zip|gz|map|json)(\?|$)"),
    ("api", r"/(api|graphql|rest|v\d+)/"),
    ("session_ids", r"[?&](sid|session|sessionid|jsessionid|phpsessid|token|nonce|csrf|fbclid|gclid|msclkid|_ga|_gl|ref|affiliate|trk)=|[?&](utm_|mc_)\w+="),
    ("faceted_nav", r"[?&](color|size|sort|order|filter|brand|material|style|type|category|min|max|page_size|per_page|view|display|layout)="),
    ("search", r"[?&](q|query|search|s|keyword|term|text)=|/search[/?]"),
    ("pagination", r"(/page/\d+|[?&]page=\d+|[?&]p=\d+|[?&]offset=\d+|[?&]start=\d+)"),
    ("calendar", r"/\d{4}/\d{2}(/\d{2})?/?$|[?&](year|month|date|day)=\d"),
    ("taxonomy", r"/(tag|tags|category|categories|topic|topics|archive|archives|author|label|labels)/"),
)
TOP_URLS = 500


def with_bot(hits: DataFrame) -> DataFrame:
    """Adds bot, category and mobile (search engines only). Each step is a projection of its own, so the chain of signatures
    stands in the plan once."""
    out = hits.withColumn("_ua", F.lower(F.coalesce("user_agent", F.lit("")))).withColumn("_at", bots.signature(F.col("_ua")))
    out = out.withColumns({"bot": bots.name_at(F.col("_at")), "category": bots.category_at(F.col("_at"))})
    return out.withColumn("mobile", F.coalesce(F.contains("_ua", F.lit("mobile")) & (F.col("category") == "search_engine"), F.lit(False))).drop("_ua", "_at")


def status_group(status: Column) -> Column:
    return F.when(status >= 500, "5xx").when(status >= 400, "4xx").when(status >= 300, "3xx").when(status >= 200, "2xx").otherwise("other")


def waste_class(path: Column) -> Column:
    """Crawl-waste class of a path, '' for none."""
    low, out = F.lower(path), F.lit("")
    for name, pattern in reversed(WASTE):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def weekday(ts: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(ts) - 1


def _bots() -> Column:
    return F.count_if(F.col("bot").isNotNull())


def overview(hits: DataFrame) -> DataFrame:
    """One row: hits, bot and human hits, bytes, distinct ips and urls, first and last time."""
    return hits.agg(F.count("*").alias("hits"), _bots().alias("bot_hits"), F.count_if(F.col("bot").isNull()).alias("human_hits"), F.sum("bytes").alias("bytes"), F.countDistinct("ip").alias("ips"), F.countDistinct("path").alias("urls"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def by_status(hits: DataFrame) -> DataFrame:
    return hits.groupBy("status", status_group(F.col("status")).alias("status_group")).agg(F.count("*").alias("hits"))


def by_hour(hits: DataFrame) -> DataFrame:
    return hits.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("hits"))


def heatmap(hits: DataFrame) -> DataFrame:
    return hits.groupBy(weekday(F.col("ts")).alias("weekday"), F.hour("ts").alias("hour")).agg(F.count("*").alias("hits"))


def timeline(hits: DataFrame) -> DataFrame:
    """Hits and bytes by hour of the calendar."""
    return hits.groupBy(F.date_format("ts", "yyyy-MM-dd'T'HH").alias("hour")).agg(F.count("*").alias("hits"), F.sum("bytes").alias("bytes"))


def daily(hits: DataFrame) -> DataFrame:
    """Hits by day; human ones are all but the bots'."""
    return hits.groupBy(day(F.col("ts")).alias("day")).agg(F.count("*").alias("hits"), _bots().alias("bot_hits"), F.greatest(F.lit(0), F.count("*") - _bots()).cast("long").alias("human_hits"))


def by_bot(hits: DataFrame) -> DataFrame:
    """Per bot: hits, bytes, errors, distinct urls and ips, span, crawl rate per hour."""
    hours = F.greatest((F.unix_timestamp("last_seen") - F.unix_timestamp("first_seen")) / 3600.0, F.lit(1.0))
    return (
        hits.where(F.col("bot").isNotNull())
        .groupBy("bot", "category")
        .agg(F.count("*").alias("hits"), F.sum("bytes").alias("bytes"), F.count_if(F.col("status") >= 400).alias("errors"), F.countDistinct("path").alias("urls"), F.countDistinct("ip").alias("ips"), F.bool_or("mobile").alias("mobile"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
        .withColumn("hits_per_hour", F.round(F.col("hits") / hours, 6))
    )


def by_bot_status(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("bot").isNotNull()).groupBy("bot", "status").agg(F.count("*").alias("hits"))


def by_bot_day(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("bot").isNotNull()).groupBy("bot", day(F.col("ts")).alias("day")).agg(F.count("*").alias("hits"))


def by_category(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("category").isNotNull()).groupBy("category").agg(F.count("*").alias("hits"), F.countDistinct("bot").alias("bots"), F.sum("bytes").alias("bytes"))


def by_category_day(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("category").isNotNull()).groupBy("category", day(F.col("ts")).alias("day")).agg(F.count("*").alias("hits"))


def ai_trend(hits: DataFrame) -> DataFrame:
    """AI crawlers by day."""
    return hits.where(F.startswith("category", F.lit("ai_"))).groupBy("category", "bot", day(F.col("ts")).alias("day")).agg(F.count("*").alias("hits"))


def url_stats(hits: DataFrame) -> DataFrame:
    """Per path: hits, bot and human hits, bytes, last status, top bot."""
    votes = hits.where(F.col("bot").isNotNull()).groupBy("path", "bot").agg(F.count("*").alias("n"))
    top = votes.groupBy("path").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("bot"))).alias("top")).select(F.col("path").alias("_path"), F.col("top.bot").alias("top_bot"))
    out = hits.groupBy("path").agg(F.count("*").alias("hits"), _bots().alias("bot_hits"), F.count_if(F.col("bot").isNull()).alias("human_hits"), F.sum("bytes").alias("bytes"), F.max_by("status", F.struct("ts", "seq")).alias("status"))
    return out.join(top, F.col("path") == F.col("_path"), "left").drop("_path")


def merged_url_stats(parts: DataFrame) -> DataFrame:
    """Adds up batches (path, hits, bot_hits, human_hits, bytes, status, seq): sums, and the status of the last batch."""
    return parts.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("hits", "bot_hits", "human_hits", "bytes")], F.max_by("status", "seq").alias("status"))


def top(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)


def crawl_budget(hits: DataFrame) -> DataFrame:
    """One row: bot hits, distinct urls they crawled, and the shares of errors, mobile and AI bots among them."""
    b = hits.where(F.col("bot").isNotNull())
    share = lambda c: F.round(F.try_divide(F.count_if(c), F.count("*")), 6)
    return b.agg(F.count("*").alias("bot_hits"), F.countDistinct("path").alias("urls"), F.round(F.try_divide(F.countDistinct("path"), F.count("*")), 6).alias("efficiency"), share(F.col("status") >= 400).alias("error_rate"), share(F.col("mobile")).alias("mobile_share"), share(F.startswith("category", F.lit("ai_"))).alias("ai_share"))


def waste(urls: DataFrame) -> DataFrame:
    """Per class: hits, bot hits, urls and the class's share of all bot hits."""
    w = urls.withColumn("waste", waste_class(F.col("path")))
    total = urls.agg(F.sum("bot_hits").alias("all_bot_hits"))
    out = w.where(F.col("waste") != "").groupBy("waste").agg(F.sum("hits").alias("hits"), F.sum("bot_hits").alias("bot_hits"), F.count("*").alias("urls"))
    return out.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.try_divide("bot_hits", "all_bot_hits"), 6)).drop("all_bot_hits")  # one row


def waste_samples(urls: DataFrame, k: int = 5) -> DataFrame:
    """The k most visited urls of each class."""
    order = Window.partitionBy("waste").orderBy(F.desc("hits"), "path")
    w = urls.select("path", "hits", waste_class(F.col("path")).alias("waste")).where(F.col("waste") != "")
    return w.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def anomalies(hits: DataFrame, k: int = 10) -> DataFrame:
    """Days on which a bot, or all traffic, lies over two standard deviations above its mean over all days."""
    d = day(F.col("ts")).alias("day")
    days = hits.select(d).distinct()
    per = by_bot_day(hits).select("bot", "day", "hits").unionByName(hits.groupBy(d).agg(F.count("*").alias("hits")).select(F.lit("All Traffic").alias("bot"), "day", "hits"))
    sums = per.groupBy("bot").agg(F.sum("hits").alias("s"), F.sum(F.col("hits") * F.col("hits")).alias("q")).crossJoin(F.broadcast(days.agg(F.count("*").alias("n"))))  # one row
    mean, var = F.col("s") / F.col("n"), F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    sums = sums.select(F.col("bot").alias("_bot"), "n", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"))
    found = per.join(sums, F.col("bot") == F.col("_bot")).where((F.col("n") >= 3) & ((F.col("mean") >= 1) | (F.col("bot") == "All Traffic")) & (F.col("sd") >= 1))
    z = (F.col("hits") - F.col("mean")) / F.col("sd")
    found = found.withColumn("z", F.round(z, 4)).where(F.col("z") > 2)
    return top(found.select("bot", "day", "hits", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "z", F.when(F.col("z") > 3, "critical").otherwise("warning").alias("severity")), "hits", k, "bot", "day")


def by_directory(urls: DataFrame) -> DataFrame:
    """Per first directory: hits, bot and human hits, urls, bytes."""
    first = F.split_part(F.split_part(F.col("path"), F.lit("?"), F.lit(1)), F.lit("/"), F.lit(2))
    return urls.groupBy(F.concat(F.lit("/"), first).alias("directory")).agg(F.sum("hits").alias("hits"), F.sum("bot_hits").alias("bot_hits"), F.sum("human_hits").alias("human_hits"), F.count("*").alias("urls"), F.sum("bytes").alias("bytes"))


def by_parameter(urls: DataFrame) -> DataFrame:
    """Per query parameter, once a url: hits, bot hits, urls."""
    query = F.split_part(F.col("path"), F.lit("?"), F.lit(2))
    names = F.array_distinct(F.transform(F.split(query, "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1))))
    u = urls.select("hits", "bot_hits", F.explode(names).alias("parameter")).where((F.col("parameter") != "") & (F.length("parameter") <= 80))
    return u.groupBy("parameter").agg(F.sum("hits").alias("hits"), F.sum("bot_hits").alias("bot_hits"), F.count("*").alias("urls"))


def by_depth(urls: DataFrame) -> DataFrame:
    segments = F.filter(F.split(F.split_part(F.col("path"), F.lit("?"), F.lit(1)), "/"), lambda s: s != "")
    return urls.groupBy(F.size(segments).alias("depth")).agg(F.sum("hits").alias("hits"), F.sum("bot_hits").alias("bot_hits"), F.count("*").alias("urls"))


def search_variants(hits: DataFrame, name: str = "google") -> DataFrame:
    """Variants of one engine's bots, mobile against desktop."""
    return hits.where(F.contains(F.lower("bot"), F.lit(name))).groupBy("bot").agg(F.count("*").alias("hits"), F.count_if("mobile").alias("mobile_hits"), F.count_if(~F.col("mobile")).alias("desktop_hits"))


def bot_heatmaps(hits: DataFrame, k: int = 5) -> DataFrame:
    """Heatmaps of the k most active bots."""
    b = hits.where(F.col("bot").isNotNull())
    chosen = top(b.groupBy("bot").agg(F.count("*").alias("n")), "n", k, "bot").select(F.col("bot").alias("_bot"))
    b = b.join(F.broadcast(chosen), F.col("bot") == F.col("_bot"), "left_semi")  # k rows
    return b.groupBy("bot", weekday(F.col("ts")).alias("weekday"), F.hour("ts").alias("hour")).agg(F.count("*").alias("hits"))


def hour_summary(hits: DataFrame) -> DataFrame:
    """One row: peak hour (ties to the earlier), its hits, mean hits an hour of the day, share of bots."""
    h = hits.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("hits"), _bots().alias("bot_hits"))
    return h.agg(F.max_by("hour", F.struct("hits", (-F.col("hour")).alias("h"))).alias("peak_hour"), F.max("hits").alias("peak_hits"), F.round(F.sum("hits") / 24, 4).alias("mean_hits"), F.round(F.try_divide(F.sum("bot_hits"), F.sum("hits")), 6).alias("bot_ratio"))


def url_table(urls: DataFrame, search: str = "", group: str | None = None, sort: str = "hits", descending: bool = True, k: int = 200) -> DataFrame:
    """Urls whose path contains ``search`` (any case), of one status group, sorted."""
    out = urls.where(F.contains(F.lower("path"), F.lit(search.lower())))
    out = out if group is None else out.where(status_group(F.col("status")) == group)
    return out.orderBy(F.desc(sort) if descending else F.asc(sort), "path").limit(k)


def verified_summary(checks: DataFrame) -> DataFrame:
    """checks (bot, ip, verified) -> per bot: ips, verified and failed ones, share."""
    return checks.groupBy("bot").agg(F.count("*").alias("ips"), F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("spoofed"), F.round(F.try_divide(F.count_if("verified"), F.count("*")), 6).alias("share"))


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    part = [F.try_element_at(F.split(ip, r"\."), F.lit(i)).try_cast("long") for i in (1, 2, 3, 4)]
    return ((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3]


def ip6_digits(ip: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address; null for anything else."""
    low = F.lower(ip)
    group = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    left, right = group(F.split_part(low, F.lit("::"), F.lit(1))), group(F.split_part(low, F.lit("::"), F.lit(2)))
    every = F.when(F.contains(low, F.lit("::")), F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))), right)).otherwise(F.split(low, ":"))
    return F.when(F.contains(ip, F.lit(":")) & (F.size(every) == 8), F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))


def in_ranges(hits: DataFrame, ranges: list[tuple[str, str]]) -> DataFrame:
    """Hits with the label of the first range (cidr, label) that holds their ip: a chain of comparisons, as ranges are a
    parameter of a few dozen entries."""
    n, six, out = ip_number(F.col("ip")), ip6_digits(F.col("ip")), F.lit(None).cast("string")
    for cidr, label in reversed(ranges):
        net = ipaddress.ip_network(cidr, strict=False)
        if net.version == 4:
            holds = n.between(int(net.network_address), int(net.broadcast_address))
        else:
            holds = six.between(f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}")
        out = F.when(holds, label).otherwise(out)
    return hits.withColumn("range", out)
