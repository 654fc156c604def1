"""Row plumbing that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import discard, stored  # noqa: F401  the operators' way to cut lineage

HOT_ROWS, HOT_KEYS = 256, 10_000


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text alone; a null text is empty."""
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """A narrow step over Arrow batches; fn gives one batch's columns, in the schema's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Gives freed memory back at a task's end: workers live on, and several operators share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to miss every column of df; Spark heeds no case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def row_hash(doc_id: Column, text: Column) -> Column:
    """Tells rows apart by id and text; a null id is one of its own."""
    return F.xxhash64(doc_id.cast("long"), doc_id.isNull(), F.coalesce(text.cast("string"), F.lit("")))


def spread_join(left: DataFrame, right: DataFrame, key: str, copies: str, total: int) -> DataFrame:
    """Inner join of left with right, which has each key once and in ``copies`` its number of rows on the left (``total`` in all).
    Keys of more than max(HOT_ROWS, total / HOT_KEYS) rows, of which there are HOT_KEYS at most, are broadcast, so their rows
    stay where they are; the others are shuffled."""
    unit = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot, cold = right.where(F.col(copies) > unit).drop(copies), right.where(F.col(copies) <= unit).drop(copies)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))
