"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding lower-cases, replaces homoglyphs and, inside tokens that hold a letter, digits and marks that
stand for letters; ``l`` and ``i`` fold together, as ``1`` may be either. The lexicon holds whole words
and word beginnings whose presence marks label 1; weights are smoothed log odds. A hit counts unless
the pair of it and a neighbour is an exception phrase: one that labelled clean text uses. The sum of
weights and its rate per hundred words go through a logistic curve fitted on the same rows.

The fit reads at most ``SAMPLE`` labelled documents, those of least hash, each once: of texts that share an
id that of least hash. Lexicon and exceptions come whole from that sample, which bounds them; scoring reads
every row and whole texts, words of any length included. Null counts as empty; an empty text has no hit and
gets the curve's value for none. Repeated rows are scored each; of labels that contradict each other 1 counts.
Empty tables give no rows; without labels of both kinds nothing is rejected. ``scored`` reads no other
columns, ``without_toxic`` keeps them.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rows

SAMPLE = 20_000
MIN_DOCS, MIN_SHARE = 2, 0.008  # toxic texts that an entry needs: so many, and such a share of all
MIN_WEIGHT = 3.0
STEMS = (4, 5, 6)

#: Letters that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = dict(zip("абвгеёзикмнопрстухіјѕԁɡӏһԛԝαβεηικνορτυχωłøđ", "abbreeзukmhonpctyxijsdglhqwabenikvoptuxwlod", strict=True))
SIGNS = str.maketrans("013457@$!|", "oieastasil")
INVISIBLE = "­​‌‍⁠﻿"


class _Fold(dict):
    """For str.translate: each character to its folded form, found once."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in INVISIBLE:
            out = ""
        else:
            c = unicodedata.normalize("NFKC", c).lower()
            c = HOMOGLYPHS.get(c, c)
            out = "".join("i" if x == "l" else x if x.isalnum() else " " for x in unicodedata.normalize("NFC", c))
        self[code] = out
        return out


_FOLD = _Fold()
_SIGNED = re.compile(r"[\w@$!|]*[0-9@$!|][\w@$!|]*")


def _letters(m: re.Match) -> str:
    s = m[0]
    core = s.strip("@$!|") if not s[0].isalnum() and s[-1] in "@$!|" else s.rstrip("@$!|")
    return core.translate(SIGNS) + " " if any(c.isalpha() for c in core) else s


def fold(text: str) -> str:
    """Words of the folded text, one blank before and after each."""
    return " " + " ".join(_SIGNED.sub(_letters, text).translate(_FOLD).split()) + " "


@dataclass
class Lexicon:
    weights: dict[str, float]  # " word " or " stem"
    exceptions: set[tuple[str, str]] = field(default_factory=set)
    curve: tuple[float, float, float] = (-4.0, 1.0, 1.0)
    _automaton: ahocorasick.Automaton | None = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for pattern, weight in self.weights.items():
                self._automaton.add_word(pattern, (len(pattern), weight))
            if self.weights:
                self._automaton.make_automaton()
        return self._automaton

    def hits(self, folded: str) -> dict[int, float]:
        """Place of each matched word -> the largest weight of its matches; exception phrases are left out."""
        found: dict[int, float] = {}
        if self.weights:
            for end, (size, weight) in self.automaton.iter(folded):
                at = end + 1 - size
                if weight > found.get(at, 0.0):
                    found[at] = weight
        return {at: w for at, w in found.items() if not self.exceptions.intersection(pairs(folded, at))} if self.exceptions else found

    def features(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        total = sum(self.hits(folded).values())
        return math.log1p(total), math.log1p(100 * total / (folded.count(" ") + 20))

    def score(self, text: str) -> float:
        a, b, c = self.curve
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * x + c * y))))


def pairs(folded: str, at: int) -> list[tuple[str, str]]:
    """The word at a place with its left and its right neighbour."""
    end = folded.index(" ", at + 1)
    after = folded.find(" ", end + 1)
    return [(folded[folded.rfind(" ", 0, at) + 1 : at], folded[at + 1 : end]), (folded[at + 1 : end], folded[end + 1 : after] if after >= 0 else "")]


def _entries(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}


def _counted(sample: DataFrame, features) -> DataFrame:
    """feature -> number of toxic and of clean texts that hold it."""

    def fn(batch):
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            n[1 if toxic else 0].update(features(text))
        every = list(n[0].keys() | n[1].keys())
        return {"feature": every, "bad": [n[1][f] for f in every], "good": [n[0][f] for f in every]}

    return rows.map_batches(sample, fn, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; ridge keeps separable data finite."""
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Learns from labelled rows that are not held out; without both labels the lexicon is empty and scores stay low."""
    spark = docs.sparkSession
    some = labels.select(labels["doc_id"].cast("long").alias("doc_id"), (labels["toxic"] == 1).alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = rows.texts(docs).join(F.broadcast(some), "doc_id")  # SAMPLE ids at most
    chosen = rows.stored(found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "toxicity")
    n = {r.toxic: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    bad, good = n.get(True, 0), n.get(False, 0)
    if not bad or not good:
        return Lexicon({})
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    top = _counted(chosen, lambda t: _entries(fold(t))).where(F.col("bad") >= max(MIN_DOCS, math.ceil(MIN_SHARE * bad))).withColumn("weight", weight).where(F.col("weight") >= MIN_WEIGHT)
    lexicon = Lexicon({r.feature: r.weight for r in top.collect()})
    shared = spark.sparkContext.broadcast(lexicon)

    def phrases(text):
        folded = fold(text)
        return {" ".join(p) for at in shared.value.hits(folded) for p in pairs(folded, at) if all(p)}

    odd = _counted(chosen, phrases).where((F.col("good") >= 3) & (weight < 0)).collect()
    lexicon.exceptions = {tuple(r.feature.split(" ")) for r in odd}
    shared = spark.sparkContext.broadcast(lexicon)

    def fn(batch):
        found = [shared.value.features(t) for t in batch.column("text").to_pylist()]
        return {"x": [f[0] for f in found], "y": [f[1] for f in found], "toxic": batch.column("toxic")}

    seen = rows.map_batches(chosen, fn, "x double, y double, toxic boolean").toPandas()
    rows.discard(chosen)
    lexicon.curve = tuple(float(v) for v in _logistic(seen[["x", "y"]].to_numpy(), seen["toxic"].to_numpy().astype(float)))
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def fn(batch):
        s = [shared.value.score(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "score": s}

    out = rows.map_batches(rows.texts(docs), fn, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of docs whose text scores under one half, unchanged; null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def score(text):
        return text.fillna("").map(shared.value.score)

    return docs.where(score(F.col("text").cast("string")) < 0.5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.documents(spark, sf_dir)
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
