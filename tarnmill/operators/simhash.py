"""Simhash fingerprints and near-duplicate pairs."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import discard, stored

BITS = 64


def fingerprint(text: str) -> int:
    """Majority bits of the first eight md5 bytes, little-endian, of 3-word shingles of the lower-cased text; under five words,
    of the text itself; 0 for an empty one. As a signed 64-bit number."""
    if not text:
        return 0
    words = text.lower().split()
    some = [text] if len(words) < 5 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = np.frombuffer(b"".join(hashlib.md5(s.encode()).digest()[:8] for s in some), dtype="<u8")
    if len(words) < 5:
        return int(h[0].astype(np.int64))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0].astype(np.int64))


def fingerprints(docs: DataFrame, least_words: int = 30) -> DataFrame:
    """id, fingerprint of texts (id, text) of so many words or more."""

    @F.pandas_udf("long")
    def prints(text: pd.Series) -> pd.Series:
        return text.map(lambda t: fingerprint(t or ""))

    return docs.where(F.size(F.split(F.trim("text"), r"\s+")) >= least_words).select("id", prints("text").alias("fingerprint"))


def _key_blocks(n: int) -> int:
    """How many blocks a key joins: more for larger tables, so that a key holds few fingerprints."""
    return 2 if n < 1 << 20 else 3 if n < 1 << 26 else 4


def near_keys(n: int, most: int = 6) -> list[list[tuple[int, int]]]:
    """Runs (first bit, bits) whose bits make each key. Of most + r blocks r are equal in any two fingerprints ``most`` apart or
    nearer, so every choice of r blocks is a key, and no pair is lost."""
    r = _key_blocks(n)
    cut = [i * BITS // (most + r) for i in range(most + r + 1)]
    return [[(cut[i], cut[i + 1] - cut[i]) for i in some] for some in combinations(range(most + r), r)]


def near_pairs(prints: DataFrame, most: int = 6) -> DataFrame:
    """a, b (fingerprints, a < b), distance of different fingerprints at most ``most`` apart. Equal fingerprints count once, so
    copies make no pairs. Candidates share a key of near_keys; a pair that shares several is looked at for the first alone. The join
    is by sorting: the stored fingerprints look small enough to broadcast, their keys are dozens of times as many rows."""
    d = stored(prints.select("fingerprint").distinct(), "fingerprints")
    every = near_keys(d.count(), most)
    masks = [sum(((1 << size) - 1) << at for at, size in runs) for runs in every]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("key"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(signed)])
    k = d.select("fingerprint", F.explode(keys).alias("x")).select("fingerprint", "x.*")
    o = k.select(F.col("fingerprint").alias("b"), F.col("key").alias("_n"), F.col("bits").alias("_k"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    distance = F.bit_count(apart)
    first = F.array_position(F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: apart.bitwiseAND(m)), F.lit(0).cast("long")) - 1
    pairs = k.withColumnRenamed("fingerprint", "a").join(o.hint("merge"), (F.col("key") == F.col("_n")) & (F.col("bits") == F.col("_k")) & (F.col("a") < F.col("b"))).where(distance <= most).where(first == F.col("key"))
    return pairs.select("a", "b", distance.alias("distance"), F.expr(f"({BITS} - bit_count(a ^ b)) * 100 div {BITS}").alias("similarity"))


def greedy_groups(prints: DataFrame, most: int = 6) -> DataFrame:
    """id, group_id of fingerprints (id, fingerprint), by seeds in order of id: whoever is in no group yet founds one and takes all
    that are ``most`` apart or nearer and free. In rounds: whoever has no undecided neighbour before it is a seed, and its
    neighbours are not; at last each of those joins its first seed. Equal fingerprints go together. Joins are by sorting, as all
    sides grow with the table."""
    prints = stored(prints, "greedy")  # read four times
    order = stored(prints.groupBy("fingerprint").agg(F.min("id").alias("o")), "greedy")
    pairs = stored(near_pairs(prints, most).select("a", "b"), "greedy")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    at = lambda side, name: order.select(F.col("fingerprint").alias(side), F.col("o").alias(name)).hint("merge")
    among = lambda d, name: d.select(F.col("o").alias(name)).hint("merge")
    e = stored(both.join(at("a", "oa"), "a").join(at("b", "ob"), "b").select("oa", "ob"), "greedy")  # each by its first id
    discard(pairs)
    left, seeds = stored(e.select(F.col("oa").alias("o")).distinct(), "greedy"), None
    while not left.isEmpty():
        open_ = e.join(among(left, "oa"), "oa", "left_semi").join(among(left, "ob"), "ob", "left_semi")
        new = stored(left.join(open_.where(F.col("ob") < F.col("oa")).select(F.col("oa").alias("o")).hint("merge"), "o", "left_anti"), "greedy")
        taken = e.join(among(new, "oa"), "oa", "left_semi").select(F.col("ob").alias("o"))
        before, left = left, stored(left.join(new.hint("merge"), "o", "left_anti").join(taken.hint("merge"), "o", "left_anti"), "greedy")
        discard(before)
        seeds = new if seeds is None else seeds.unionByName(new)
    if seeds is None:
        return prints.join(order.hint("merge"), "fingerprint").select("id", F.col("o").alias("group_id"))
    s = seeds.distinct()
    first = e.join(among(s, "ob"), "ob", "left_semi").groupBy("oa").agg(F.min("ob").alias("seed")).join(among(s, "oa"), "oa", "left_anti")
    group = order.join(first.hint("merge"), F.col("o") == F.col("oa"), "left").select(F.col("fingerprint").alias("_f"), F.coalesce("seed", "o").alias("group_id"))
    return prints.join(group.hint("merge"), F.col("fingerprint") == F.col("_f")).select("id", "group_id")
