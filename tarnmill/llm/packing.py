"""Packing along a space-filling curve.

Each document becomes ids and a vector of hashed token counts, projected to a few dimensions; the
Hilbert key of the projection orders documents so that neighbours on the curve are alike. Rows are
range-sorted by (key, doc_id), and each range is cut into sequences of ``LENGTH`` ids as one stream,
so every sequence is full but for a range's last ids, which are cut into powers of two and need no
padding either. Ranges are as many as the ids ask for (``RANGE_IDS`` each); a document may lie in any
number of sequences.

Texts: null counts as empty, and an empty text is the one closing id. Rows that repeat are packed
each; rows of one key and doc_id, null ones too, are ordered by the place at which they were written, and a
range may begin between any two of them, so neither copies nor rows without an id need to meet in one task.
A text of any length is tokenized whole. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rows
from .bpe import Recent, json_ranks
from .pretokens import word_level

LENGTH = 4096
CLOSE = 2
DIMS, BITS = 4, 8
RANGE_IDS = 1 << 22
_END = b"\xff"  # stands for the end-of-word suffix; no UTF-8 text holds this byte


class WordBpe:
    """Ids of a word-level BPE vocabulary file (NFC, white space dropped, lower case, end-of-word suffix)."""

    def __init__(self, path: str):
        ranks, self.special = json_ranks(path, _END)
        self.cut = word_level()
        # The library's merge loop over one given piece; the cutting pattern is never used.
        self.encode_piece = tiktoken.Encoding("ranks", pat_str=r"[\s\S]", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._known = Recent(self._piece)

    def _piece(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece.encode() + _END), dtype="<u2").tobytes()

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 16-bit integers, special strings included."""
        if "<|" not in text:
            return self._plain(text)
        return b"".join(np.array([self.special[p]], dtype="<u2").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(self._split.split(text)))

    def _plain(self, text: str) -> bytes:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        # str.lower() looks at a capital sigma's neighbours; the vocabulary's rule does not.
        text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        known = self._known
        return b"".join([known[p] for p in self.cut(text)])


@functools.cache
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


@functools.cache
def _directions(n: int = 1 << 16) -> np.ndarray:
    """A fixed random direction for each token id; the sum over a document is its hashed vector's projection."""
    return np.random.default_rng(20240229).standard_normal((n, DIMS)).astype(np.float32)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each row of cells (n x dims, whole numbers under 2**bits) on the Hilbert curve (Skilling 2004)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def keys(ids: list[bytes]) -> np.ndarray:
    """Hilbert key of each document's ids (16-bit)."""
    sizes = np.array([len(b) // 2 for b in ids])
    sums, step = np.zeros((len(ids), DIMS)), _directions()
    i = 0
    while i < len(ids):  # blocks bound the memory of the gathered directions
        j = max(i + 1, int(np.searchsorted(np.cumsum(sizes[i:]), 1 << 20)) + i)
        flat = np.frombuffer(b"".join(ids[i:j]), dtype="<u2")
        starts = np.concatenate([[0], np.cumsum(sizes[i:j])[:-1]])
        sums[i:j] = np.add.reduceat(step[flat], starts, axis=0)
        i = j
    scaled = np.arctan(sums / np.sqrt(sizes)[:, None]) / np.pi + 0.5
    return hilbert(np.minimum((scaled * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def _tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, curve key, number of ids and the ids, packed by zstd; the closing id is among them."""

    def fn(batch):
        t, pack, close = tokenizer(path), zstandard.ZstdCompressor(level=1).compress, np.array([CLOSE], dtype="<u2").tobytes()
        ids = [t(x) + close for x in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "key": keys(ids), "n": [len(b) // 2 for b in ids], "ids": [pack(b) for b in ids]}

    return rows.map_batches(rows.texts(docs), fn, "doc_id long, key long, n long, ids binary")


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class _Stream:
    """Cuts one range's documents into sequences."""

    def __init__(self, part: int):
        self.next_id, self.filled, self.open, self.out = part << 32, 0, [], []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while at < n:
            size = min(n - at, LENGTH - self.filled)
            self.open.append((doc, at, ids[at : at + size], n))
            self.filled += size
            at += size
            if self.filled == LENGTH:
                self._close()

    def _close(self) -> None:
        offset = 0
        for doc, start, ids, n in self.open:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.next_id, offset))
            offset += len(ids)
        self.next_id, self.filled, self.open = self.next_id + 1, 0, []

    def finish(self) -> None:
        """The last ids, as sequences whose lengths are powers of two."""
        rest, left = self.open, self.filled
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            self.open = []
            while size:
                doc, start, ids, n = rest[0]
                take = min(size, len(ids))
                self.open.append((doc, start, ids[:take], n))
                rest = ([(doc, start + take, ids[take:], n)] if take < len(ids) else []) + rest[1:]
                size -= take
            self._close()

    def batch(self) -> pa.RecordBatch:
        rows_, self.out = self.out, []
        return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows_], pa.int64()) for i, c in enumerate(COLUMNS)})


def _cut(batches):
    stream, unpack = _Stream(TaskContext.get().partitionId()), zstandard.ZstdDecompressor().decompress
    for b in batches:
        for doc, ids in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
            stream.add(doc, np.frombuffer(unpack(ids), dtype="<u2"))
        yield stream.batch()
    stream.finish()
    yield stream.batch()


def packed(docs: DataFrame, path: str, range_ids: int = RANGE_IDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    t = rows.stored(_tokenized(docs, path).withColumn("place", F.monotonically_increasing_id()), "packing")
    total = t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(1, -(-total // range_ids))
    order = ["key", "doc_id", "place"]
    dealt = t.select(*order, "ids").repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_cut, ", ".join(f"{c} long" for c in COLUMNS))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(rows.documents(spark, sf_dir), rows.vocabulary("word_bpe_49k.json"))
