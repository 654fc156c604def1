"""N-grams of page texts: counts, document frequency, weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stopwords import stopwords


def ngrams(texts: DataFrame, n: int, language: str = "en", k: int = 100) -> DataFrame:
    """texts (id, text) -> term, count, pages, weight: the k most frequent n-grams, ties to the smaller term. Texts of under
    50 bytes or 3 tokens do not count; with over 5 texts a term needs two pages. Weight is tf * ln(N / df), where tf is the
    share of all n-grams' tokens.

    Each text is cut once. Its n-grams are sorted within the row, so that the first of each is known, and one shuffle by term,
    summed before it, gives counts and pages; a row without a term per text gives the totals."""
    t = texts.where(F.octet_length("text") >= 50).select(T.tokens(F.col("text"), stopwords(language)).alias("w")).where(F.size("w") >= max(3, n))
    gram = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.concat_ws(" ", *[F.get(F.col("w"), i + j) for j in range(n)])) if n > 1 else F.col("w")
    t = t.select(F.array_sort(gram).alias("g"))
    new = F.transform("g", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (F.get(F.col("g"), F.greatest(i - 1, F.lit(0))) != x)).cast("long").alias("first")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("first")))
    per = t.select(F.explode(F.concat(new, none)).alias("x")).groupBy("x.term").agg(F.count("*").alias("count"), F.sum("x.first").alias("pages"))
    total = per.agg(F.sum(F.when(F.col("term").isNull(), F.col("count"))).alias("texts"), F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("count"))), F.lit(0)).alias("grams"))
    out = per.where(F.col("term").isNotNull()).crossJoin(F.broadcast(total))  # one row
    weight = F.round(F.col("count") / (F.col("grams") + (n - 1) * F.col("texts")) * F.ln(F.col("texts") / F.col("pages")), 5)
    return out.where((F.col("texts") <= 5) | (F.col("pages") >= 2)).select("term", "count", "pages", weight.alias("weight")).orderBy(F.desc("count"), "term").limit(k)


def changes(old: DataFrame, new: DataFrame, k: int = 30) -> DataFrame:
    """Terms that only one of two n-gram lists has: emerging or declining, k of each."""
    new_only = new.join(old.select(F.col("term").alias("_t")), F.col("term") == F.col("_t"), "left_anti").orderBy(F.desc("count"), "term").limit(k).withColumn("kind", F.lit("emerging"))
    old_only = old.join(new.select(F.col("term").alias("_t")), F.col("term") == F.col("_t"), "left_anti").orderBy(F.desc("count"), "term").limit(k).withColumn("kind", F.lit("declining"))
    return new_only.unionByName(old_only).select("kind", "term", "count", "pages")
