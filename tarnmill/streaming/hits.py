"""Log statistics over streams: the batch operators' twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs as L
from ..sources import log_lines

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def hit_stream(spark: SparkSession, path: str, kind: str = "combined", files: int = 16) -> DataFrame:
    """Hits of a folder's log files as they arrive, ``files`` a trigger."""
    return L.with_bot(log_lines.parse(spark.readStream.option("maxFilesPerTrigger", files).text(path), kind))


def windowed(hits: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Hits and bytes per window and bot; windows close ``late`` after the greatest time seen."""
    return hits.withWatermark("ts", late).groupBy(F.window("ts", window), F.coalesce("bot", F.lit("human")).alias("bot")).agg(F.count("*").alias("hits"), F.sum("bytes").alias("bytes"))


def daily_counts(hits: DataFrame) -> DataFrame:
    """Daily counters that never close: for complete mode."""
    return hits.groupBy(F.window("ts", "1 day"), F.coalesce("bot", F.lit("human")).alias("bot")).agg(F.count("*").alias("hits"))


def upsert_urls(path: str):
    """foreachBatch function: each batch's url statistics are appended under ``path`` by batch; merged_url_stats adds them up.
    A batch that is run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        s = batch.groupBy("path").agg(F.count("*").alias("hits"), F.count_if(F.col("bot").isNotNull()).alias("bot_hits"), F.count_if(F.col("bot").isNull()).alias("human_hits"), F.sum("bytes").alias("bytes"), F.max_by("status", "ts").alias("status"))
        s.withColumn("seq", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/seq_of={batch_id}")

    return write


def changed_pages(stream: DataFrame, previous: DataFrame) -> DataFrame:
    """stream (url, content_hash) against the hashes of the crawl before: url, state."""
    p = previous.select(F.col("url").alias("_u"), F.col("content_hash").alias("_h"))
    return stream.join(p, F.col("url") == F.col("_u"), "left").select("url", F.when(F.col("_h").isNull(), "new").when(F.col("_h") == F.col("content_hash"), "unchanged").otherwise("changed").alias("state"))
