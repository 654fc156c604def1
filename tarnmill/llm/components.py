"""Connected components by alternating large and small stars (Kiveris et al. 2014).

Every round keeps the number of edges linear, hubs only meet minima that are summed map-side, and each
round's edges are written to the shared folder, which cuts lineage. Only a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rows

ROUNDS = 60


def _stars(e: DataFrame, large: bool) -> DataFrame:
    """e has (a, b), a > b, once each. Large: each node's greater neighbours go to its least one; small: its others do."""
    if large:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # the greater neighbours v of u: e has them as rows (v, u)
        return e.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b")).distinct()
    least = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    out = e.join(least, F.col("a") == F.col("u")).where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) -> (node, root): every linked node and the least node of its component. Loops and repeats are harmless."""
    e = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, seen = rows.stored(e, "links"), None
    for _ in range(ROUNDS):
        before, e = e, rows.stored(_stars(_stars(e, True), False), "links")
        rows.discard(before)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select("b", "b").distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
