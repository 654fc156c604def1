"""Byte-level BPE by monoid tree reduction.

A piece is halved until its parts are of four bytes at most, each part is encoded, and neighbours are joined: if the
last token of the left and the first of the right may stand side by side, the two lists concatenate;
else the bytes of a window of tokens about the seam are encoded anew, and the window grows on each
side until its outer token may stand beside the token before (after) it. By bpe's second fact the
tokens outside are then proved stable. Joining is associative, so the tree may have any shape.
Decoding concatenates byte strings up a tree of the same kind.

Texts: null counts as empty; an empty text has no ids, and its hashes are those of no bytes. Special
strings are ordinary text. A text of any length is encoded whole; a piece of any length costs in
proportion to its length, as windows stay short. Rows that repeat are encoded each, an empty table gives
no rows, and other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import rows
from .bpe import Bpe, Recent, tiktoken_ranks
from .pretokens import byte_level

LEAF = 4
DECODE_LEAF = 1024


class TreeBpe:
    def __init__(self, path: str):
        self.bpe, self.cut = Bpe(tiktoken_ranks(path)), byte_level()
        self._known = Recent(self.piece)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes, from their encodings."""
        fits = self.bpe.adjacent
        if not left or not right or fits(left[-1], right[0]):
            return left + right
        a, b = 1, 1
        while True:
            window = self.bpe.encode(self.bpe.decode(left[len(left) - a :]) + self.bpe.decode(right[:b]))
            before = a == len(left) or fits(left[-a - 1], window[0])
            after = b == len(right) or fits(window[-1], right[b])
            if before and after:
                return left[: len(left) - a] + window + right[b:]
            a, b = (a if before else min(2 * a, len(left))), (b if after else min(2 * b, len(right)))

    def tree(self, piece: bytes, leaf: int = LEAF) -> list[int]:
        if len(piece) <= leaf:
            return self.bpe.encode(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half], leaf), self.tree(piece[half:], leaf))

    def piece(self, piece: str) -> bytes:
        """The ids of one piece as little-endian unsigned 32-bit integers; a piece that is a token is that token."""
        b = piece.encode()
        whole = self.bpe.ranks.get(b)
        return np.array([whole] if whole is not None else self.tree(b), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Pieces are encoded apart, so up here joining is concatenation."""
        known = self._known
        return b"".join([known[p] for p in self.cut(text)])

    def decode(self, ids: bytes) -> bytes:
        return self._concat(array("I", ids).tolist() if array("I").itemsize == 4 else np.frombuffer(ids, "<u4").tolist())

    def _concat(self, ids: list[int]) -> bytes:
        level = [self.bpe.decode(ids[i : i + DECODE_LEAF]) for i in range(0, len(ids), DECODE_LEAF)] or [b""]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0]


@functools.cache
def codec(path: str) -> TreeBpe:
    return TreeBpe(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every row of docs (doc_id, text)."""

    def fn(batch):
        c = codec(path)
        return {"doc_id": batch.column("doc_id"), "ids": [c.encode(t) for t in batch.column("text").to_pylist()]}

    return rows.map_batches(rows.texts(docs), fn, "doc_id long, ids binary")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and bytes (binary) of every row of ids (doc_id, ids); null ids are none."""

    def fn(batch):
        c = codec(path)
        return {"doc_id": batch.column("doc_id"), "bytes": [c.decode(x or b"") for x in batch.column("ids").to_pylist()]}

    return rows.map_batches(ids.select("doc_id", "ids"), fn, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs (doc_id, text): encoded and decoded in one step."""

    def fn(batch):
        c = codec(path)
        n, ids, back = [], [], []
        for t in batch.column("text").to_pylist():
            e = c.encode(t)
            n.append(len(e) // 4)
            ids.append(hashlib.sha256(e).hexdigest())
            back.append(hashlib.sha256(c.decode(e)).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": back}

    return rows.map_batches(rows.texts(docs), fn, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(rows.documents(spark, sf_dir), rows.vocabulary("byte_bpe_multi_50k.tiktoken"))
