"""Substring dedup by repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document; a word goes if a window that covers it also
starts earlier (smaller doc_id, or same document and earlier start).

(1) Every window names one of its 8-word grams, the leftmost of least hash: its *anchor*. Equal windows
name equal anchors, and neighbours mostly share one, so anchors are a seventh as many as words. Their
counts, summed map-side, tell which recur, and a bitmap of fixed size carries that to (2); where it
fills up it passes more and loses nothing. (2) Documents are read again, and the passage about each
recurring anchor, from its first to its last window, goes to the anchor's shard: so a shard's automaton is
streamed over every part of every document that can hold one of its phrases, and over nothing else. Passages
equal to one earlier in the same batch need not go: their windows are known to start earlier. Anchors of more
than ``HOT`` places would make a large group; their passages go as single windows, dealt by content, of
which a batch sends each once. (3) A shard confirms by counts which of its passages' windows recur, compiles
those into Aho-Corasick automata over word numbers, a bounded number at a time, and streams its
passages through them, which gives the places: each but for the phrase's first is to be removed. Hot windows
are one phrase a task; of their places only the least is held. (4) Places are
gathered by document and joined to the texts.

Windows are compared word by word; hashes only deal them out. Texts: null, empty or without words have
no windows and kept words ""; a text of any length is read whole. Repeats of a row, with id and text, are one
document: they have the same places and get the same answer. Texts without an id are documents of their own and
come before all others, by a hash; of different texts under one id, that of least hash has the id's place and
the others come last. An empty table gives no rows. substring_dedup reads no other columns, without_repeats
keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rows
from .arrow_text import Words, mix, words

WINDOW, GRAM = 20, 8
BITS, HOT_BITS = 1 << 27, 1 << 22
HOT = 4096
PHRASES = 8_000
U = np.uint64
NO_ID, SECOND, SPAN = -(2**63), 2**62, 2**62 - 1  # where the keys of texts without an id, and of second texts of one, begin; what a hash adds at most


def _rolling(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of each run of ``width`` words; the last runs are short and unused."""
    acc = np.zeros(len(h), dtype=U)
    for k in range(width):
        factor = U(((seed + 0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF) | 1)
        acc[: len(h) - k] += h[k:] * factor
    return mix(acc)


def anchors(w: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, place of each one's anchor, hash of each gram)."""
    n = len(w.hash)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    g = _rolling(w.hash, gram, 1)
    starts = np.flatnonzero(np.arange(n) + window <= np.repeat(w.offset[1:], np.diff(w.offset)))
    best, at = g[starts], starts.copy()
    for k in range(1, window - gram + 1):
        other = g[starts + k]
        less = other < best
        best = np.where(less, other, best)
        at = np.where(less, starts + k, at)
    return starts, at, g


def _passages(w: Words, window: int, gram: int):
    """Runs of windows that share an anchor: (first start, number of windows, anchor's hash, document)."""
    starts, at, g = anchors(w, window, gram)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    # An anchor lies inside its document, so runs of one anchor never cross documents.
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return starts[new], np.diff(np.r_[new, len(starts)]), g[at[new]], w.doc[starts[new]]


def _counts(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def fn(batch):
        every = [_passages(w, window, gram)[2] for w in words(batch.column("text"))]
        h, n = np.unique(np.concatenate(every), return_counts=True)
        return {"anchor": h.view(np.int64), "n": n.astype(np.int64)}

    return rows.map_batches(docs, fn, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """One bit per hash, modulo ``bits``: a filter of fixed size that may pass too much and never too little."""
    bit = F.pmod(F.col(column), F.lit(bits)) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in parts.toLocalIterator():
        out[(r.bucket - 1) * 4096 : (r.bucket - 1) * 4096 + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def among(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & U(len(bits) * 8 - 1)
    return (bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1


def _sent(batch: pa.RecordBatch, recurring: np.ndarray, hot: np.ndarray, window: int, gram: int) -> dict:
    """Rows (task, one, doc, start, n, words): passages to compare, ``one`` for hot windows, and with null words places known to
    be removed."""
    ids = batch.column("doc_id").to_numpy()
    first: dict[tuple[bytes, bool], tuple[int, int]] = {}
    known: list[tuple[int, int, int]] = []
    tasks: dict[tuple[bytes, bool], int] = {}

    def see(words_: bytes, one: bool, task: int, doc: int, start: int, n: int) -> None:
        text = words_, one
        at, was = (doc, start), first.get(text)
        if was is None:
            first[text], tasks[text] = at, task
        elif was != at:
            if at < was:
                first[text], at = at, was
            known.append((*at, n))

    for w in words(batch.column("text")):
        starts, n, h, doc = _passages(w, window, gram)
        keep = among(recurring, h)
        starts, n, h, doc = starts[keep], n[keep], h[keep], doc[keep]
        if not len(starts):
            continue
        single = among(hot, h)
        whole = _rolling(w.hash, window, 2) if single.any() else None
        raw, inside = w.data.tobytes(), (starts - w.offset[doc]).tolist()
        begin, end = w.start[starts].tolist(), w.end[starts + n + window - 2].tolist()
        for i, (d, s, m, a, one) in enumerate(zip(ids[w.first + doc].tolist(), inside, n.tolist(), h.view(np.int64).tolist(), single.tolist(), strict=True)):
            tokens = raw[begin[i] : end[i]].split()
            if not one:
                see(b" ".join(tokens), False, a, d, s, m)
            else:
                for k in range(m):
                    see(b" ".join(tokens[k : k + window]), True, int(whole[starts[i] + k].view(np.int64)), d, s + k, 1)
    text = list(first)
    doc, start = [first[t][0] for t in text] + [k[0] for k in known], [first[t][1] for t in text] + [k[1] for k in known]
    n = [t.count(b" ") + 2 - window for t, _ in text] + [k[2] for k in known]
    task = [tasks[t] for t in text] + mix(np.array([k[0] for k in known], np.int64).view(U) + np.array([k[1] for k in known], np.int64).view(U)).view(np.int64).tolist()
    return {"task": pa.array(task, pa.int64()), "one": pa.array([one for _, one in text] + [False] * len(known), pa.bool_()), "doc": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "n": pa.array(n, pa.int64()), "words": pa.array([t for t, _ in text] + [None] * len(known), pa.binary())}


def _located(group: list[tuple[int, int, int, bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, n): runs of windows that start earlier elsewhere. group: whole tasks' (task, doc, start, words)."""
    none = np.zeros(0, np.int64)
    number: dict[bytes, int] = {}
    streams = [[number.setdefault(x, len(number) + 1) for x in text.split()] for _, _, _, text in group]
    # Confirm: windows of several places, by a hash of their words' numbers.
    flat, sizes = np.array([i for ids in streams for i in ids], np.int64), np.array([len(ids) for ids in streams])
    if not len(flat):
        return none, none, none
    begin = np.cumsum(sizes) - sizes
    at = np.arange(len(flat)) - np.repeat(begin, sizes)
    whole = np.flatnonzero(at + window <= np.repeat(sizes, sizes))
    h = _rolling(mix(flat.view(U)), window, 3)[whole]
    doc = np.repeat(np.array([g[1] for g in group]), sizes)[whole]
    start = (np.repeat(np.array([g[2] for g in group]), sizes) + at)[whole]
    order = np.lexsort((start, doc, h))
    same = h[order][1:] == h[order][:-1]
    apart = (doc[order][1:] != doc[order][:-1]) | (start[order][1:] != start[order][:-1])
    recurring = np.unique(h[order][1:][same & apart])
    if not len(recurring):
        return none, none, none
    # Compile those, word by word.
    phrases, compiled = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), set()
    small = flat.astype(np.uint32)
    for k in whole[np.isin(h, recurring)].tolist():
        w = small[k : k + window].tobytes()
        if w not in compiled:
            compiled.add(w)
            phrases.add_word(tuple(small[k : k + window].tolist()), len(compiled))
    phrases.make_automaton()
    # Stream: every place of every phrase.
    which, docs, places = [], [], []
    for (_, d, s, _), ids in zip(group, streams, strict=True):
        for end, phrase in phrases.iter(tuple(ids)):
            which.append(phrase)
            docs.append(d)
            places.append(s + end - window + 1)
    which, docs, places = np.array(which, np.int64), np.array(docs, np.int64), np.array(places, np.int64)
    order = np.lexsort((places, docs, which))
    which, docs, places = which[order], docs[order], places[order]
    first = np.r_[True, which[1:] != which[:-1]]
    again = np.r_[False, (docs[1:] == docs[:-1]) & (places[1:] == places[:-1])] & ~first  # a repeated row's place
    least = np.maximum.accumulate(np.where(first, np.arange(len(which)), 0))
    gone = ~first & ~again & ~((docs == docs[least]) & (places == places[least]))
    docs, places = docs[gone], places[gone]
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    if not len(docs):
        return none, none, none
    new = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (places[1:] > places[:-1] + 1)])
    last = np.r_[new[1:], len(docs)] - 1
    return docs[new], places[new], places[last] - places[new] + 1


def _shard(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Tasks come whole and one after another; those of one passage have nothing to compare."""

    def out(doc, start, n):
        return pa.RecordBatch.from_pydict({"doc": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "n": pa.array(n, pa.int64())})

    held: list[tuple[int, int, int, bytes]] = []  # whole tasks
    task: list[tuple[int, int, int, bytes]] = []  # the one that may go on
    windows, hot, least = 0, None, {}
    for b in batches:
        known = b.filter(b.column("words").is_null())
        if known.num_rows:
            yield known.select(["doc", "start", "n"])
        b = b.filter(b.column("words").is_valid())
        later: list[tuple[int, int]] = []
        for t, one, doc, start, words_ in zip(*(b.column(c).to_pylist() for c in ("task", "one", "doc", "start", "words")), strict=True):
            if one:  # a hot window: the least place stays, whatever their number
                if t != hot:
                    hot, least = t, {}
                place, was = (doc, start), least.setdefault(words_, (doc, start))
                if place != was:
                    least[words_] = min(place, was)
                    later.append(max(place, was))
                continue
            if task and task[-1][0] != t:
                if len(task) > 1:
                    held += task
                    windows += sum(x[3].count(b" ") + 2 - window for x in task)
                    if windows >= PHRASES:
                        yield out(*_located(held, window))
                        held, windows = [], 0
                task = []
            task.append((t, doc, start, words_))
        if later:
            yield out([d for d, _ in later], [s for _, s in later], [1] * len(later))
    yield out(*_located(held + (task if len(task) > 1 else []), window))
    rows.trim()


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text, no nulls) -> (doc, places): the runs of windows, as structs (start, n), that start earlier elsewhere."""
    spark = docs.sparkSession
    counts = rows.stored(_counts(docs, window, gram).where(F.col("n") > 1), "anchors")
    filters = spark.sparkContext.broadcast((bitmap(counts, "anchor", BITS), bitmap(counts.where(F.col("n") > hot), "anchor", HOT_BITS)))
    sent = rows.map_batches(docs, lambda b: _sent(b, *filters.value, window, gram), "task long, one boolean, doc long, start long, n long, words binary")
    dealt = sent.repartition("task").sortWithinPartitions("task")
    places = dealt.mapInArrow(lambda batches: _shard(batches, window), "doc long, start long, n long")
    return places.groupBy("doc").agg(F.collect_set(F.struct("start", "n")).alias("places"))


def kept_words(text: str, places: list | None, window: int = WINDOW) -> tuple[list[bytes], int]:
    """(words that stay, number of all)."""
    w = text.encode().split()
    if not places:
        return w, len(w)
    change = np.zeros(len(w) + 1, dtype=np.int64)
    for p in places:
        start, end = p["start"], min(p["start"] + p["n"] + window - 1, len(w))
        if start < end:
            change[start] += 1
            change[end] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return [x for x, g in zip(w, gone.tolist(), strict=True) if not g], len(w)


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """docs with a column ``key``: doc_id, or for texts without one and for second texts of one a number of their own."""
    i, text = docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit(""))
    id_, hash_, least = rows.fresh(docs, "_id", "_hash", "_least")
    d = docs.select(i.alias(id_), F.xxhash64(text).alias(hash_)).where(F.col(id_).isNotNull())
    several = d.groupBy(id_).agg(F.min(hash_).alias(least), F.max(hash_).alias(hash_)).where(F.col(least) < F.col(hash_)).select(id_, least)
    several = rows.stored(several, "substring-ids")
    own = F.xxhash64(i, text).bitwiseAND(F.lit(SPAN))
    made = F.when(i.isNull(), own + F.lit(NO_ID)).when(F.xxhash64(text) != F.col(least), own + F.lit(SECOND)).otherwise(i)
    return docs.join(several, i == F.col(id_), "left").withColumn(key, made).drop(id_, least)


def _with_places(docs: DataFrame, places: str, window: int, gram: int, hot: int) -> DataFrame:
    """docs with a column ``places``."""
    key, doc = rows.fresh(docs.withColumn(places, F.lit(None)), "_key", "_doc")
    keyed = _keyed(docs, key)
    found = repeats(rows.texts(keyed, key), window, gram, hot).select(F.col("doc").alias(doc), F.col("places").alias(places))
    return keyed.join(found, F.col(key) == F.col(doc), "left").drop(doc, key)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs (doc_id, text)."""

    def fn(batch):
        kept = [kept_words(t or "", p, window) for t, p in zip(batch.column("text").to_pylist(), batch.column("_places").to_pylist(), strict=True)]
        return {"doc_id": batch.column("doc_id"), "n_words": [n for _, n in kept], "n_removed": [n - len(k) for k, n in kept], "kept_sha256": [hashlib.sha256(b" ".join(k)).hexdigest() for k, _ in kept]}

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.map_batches(_with_places(slim, "_places", window, gram, hot), fn, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with those words gone from text, the rest joined by one space; texts that lose none are unchanged, and n_chars follows."""

    @F.udf("string", useArrow=True)
    def cut(text, places):
        return text if not places or text is None else b" ".join(kept_words(text, places)[0]).decode()

    (places,) = rows.fresh(docs, "_places")
    out = _with_places(docs, places, WINDOW, GRAM, HOT).withColumn("text", cut("text", places)).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(rows.documents(spark, sf_dir))


ORACLE = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1 AS again FROM g
), gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE again
), p AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w
), k AS (
  SELECT p.doc_id, string_agg(p.x, ' ' ORDER BY p.p) AS kept FROM p ANTI JOIN gone ON gone.doc_id = p.doc_id AND gone.p = p.p GROUP BY p.doc_id
), n AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
