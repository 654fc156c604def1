"""Text columns as numpy: words, their places and 64-bit hashes, without a Python object per word.

A *word* is a maximal run of bytes outside {0x20, 0x09-0x0D}, i.e. ``[^\\x20\\x09-\\x0D]+``
over UTF-8 (no continuation byte falls into that set).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_BASE_INV = _U(_inverse(int(_BASE)))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class _Powers:
    """Powers of an odd number modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.all = base, np.ones(1, dtype=_U)

    def upto(self, n: int) -> np.ndarray:
        if len(self.all) < n:
            size = max(n, 2 * len(self.all))
            steps = np.full(size, self.base, dtype=_U)
            steps[0] = 1
            self.all = np.cumprod(steps, dtype=_U)
        return self.all[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_BASE_INV)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the usual xor-shift-multiply finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


@dataclass
class Words:
    """Words of consecutive documents of one chunk, in order."""

    first: int  # row in the batch of the chunk's first document
    n_docs: int
    data: np.ndarray  # bytes of the chunk
    start: np.ndarray  # byte offsets into data
    end: np.ndarray
    hash: np.ndarray  # uint64
    offset: np.ndarray  # n_docs + 1: where each document's words begin

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.offset))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)), off


def words(column: pa.Array, lower: bool = False, chunk: int = CHUNK_BYTES) -> Iterator[Words]:
    """Chunks of whole documents, of about ``chunk`` bytes; a longer document is a chunk of its own."""
    data, off = buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + chunk, side="right")) - 1)
        yield _chunk(data[off[i] : off[j]], off[i : j + 1] - off[i], i, lower)
        i = j


def _chunk(data: np.ndarray, off: np.ndarray, first: int, lower: bool) -> Words:
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
        begins[cuts] |= inside[cuts]
        ends[cuts - 1] |= inside[cuts - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * _UP.upto(n), dtype=_U, out=total[1:])
    h = mix((total[end] - total[start]) * _DOWN.upto(n + 1)[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))
    return Words(first, len(off) - 1, data, start, end, h, np.searchsorted(start, off))


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each run of ``width`` words inside one document; a shorter document's whole sequence is one."""
    counts = np.diff(w.offset)
    if not len(w.hash):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    n = len(w.hash)
    acc = np.zeros(n, dtype=_U)
    here = np.arange(n)
    last = np.repeat(w.offset[1:], counts)  # one past the document's last word
    for k in range(width):
        at = here + k
        factor = _U((2 * (0x632BE59BD9B4E019 >> (k + 1)) + 1) * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF)
        acc += np.where(at < last, w.hash[np.minimum(at, n - 1)], _U(0)) * factor
    size = np.minimum(last - here, width).astype(_U)
    whole = (here + width <= last) | (here == np.repeat(w.offset[:-1], counts))
    return mix(acc[whole] + size[whole] * _U(0xA0761D6478BD642F)), w.doc[whole]


def text_at(w: Words, i: int) -> str:
    return bytes(w.data[w.start[i] : w.end[i]]).decode("utf-8", "replace")
