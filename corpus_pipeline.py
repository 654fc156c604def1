"""Training-data pipeline: toxicity, near duplicates, repeated passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

toxicity: rows whose text scores one half or more go. ngram_jaccard_join: of each component of
documents that link exactly one row stays, that of the least doc_id (null last; then by a hash of its
text); texts without words link with nothing and stay. substring_dedup: words of passages that start earlier
elsewhere go from the text. secret_scans: secrets in the text become a mark. packing: pieces of
sequences. n_chars follows the text wherever it changes.

Columns beyond those of documents are kept, whatever their names, up to packing, which has columns of its
own. Null and empty texts pass every stage; an empty table passes as one. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.llm import jaccard_join, packing, rows, secret_scan, substring_dedup, toxicity

#: Near duplicates of the stage: shingles of five words, similarity 0.8. op1 alone has four words and 0.85.
WIDTH, NUM, DEN = 5, 80, 100


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    one, least, root, copies = rows.fresh(docs, "_row", "_least", "_root", "_copies")
    row = docs.withColumn(one, rows.row_hash(docs["doc_id"], docs["text"]))
    found = jaccard_join.jaccard_components(row.select(F.col(one).alias("doc_id"), "text"), width=WIDTH, num=NUM, den=DEN)
    ids = row.groupBy(F.col(one).alias("r")).agg(F.min(F.col("doc_id").cast("long")).alias("id"), F.count("*").alias("n"))
    linked = ids.join(found.where("n_shingles > 0").select(F.col("doc_id").alias("r"), "component_id").distinct(), "r")
    linked = rows.stored(linked, "pipeline-linked")
    first = linked.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "r")).alias("m"), F.count("*").alias("size"))
    first = rows.stored(first.select("component_id", F.col("m.r").alias("k"), "size"), "pipeline-first")
    kept = rows.spread_join(linked, first, "component_id", "size", linked.count()).select(F.col("r").alias(least), (F.col("r") == F.col("k")).alias(root), F.col("n").alias(copies))
    kept = rows.stored(kept, "pipeline-kept")
    # Rows of one hash are one text under one id; of a kept one that repeats, the least row stays.
    alone = row.join(kept.where(F.col(copies) == 1), F.col(one) == F.col(least), "left")
    repeats = kept.where(F.col(copies) > 1)
    alone = alone.where(F.coalesce(root, F.lit(True))).join(repeats.select(F.col(least).alias(f"{least}_")), F.col(one) == F.col(f"{least}_"), "left_anti").select(*docs.columns)
    several = row.join(repeats.where(root), F.col(one) == F.col(least)).groupBy(one).agg(F.min(F.struct(*docs.columns)).alias(root))
    return alone.unionByName(several.select(f"{root}.*"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.without_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, rows.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("substring_dedup", substring_stage),
    ("secret_scans", secrets_stage),
    ("packing", packing_stage),
]

#: Learned weights, component search and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.documents(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, rows.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        rows.discard(before)
    return docs
