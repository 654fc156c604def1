"""Token counts by prefix dynamic programming.

For a piece ``b`` of the cut text, ``last[i]`` is the last token of the encoding of ``b[:i]``: the one
token ``t`` that ends at ``i`` and may stand after ``last[i - len(t)]`` (see bpe). So one pass gives
the exact token count of every prefix, and the counts are kept: a text's table adds them up piece by
piece, and truncation or budget questions are looked up, not encoded again. Pieces repeat, so each
distinct one is solved once per process.

Two places of a text are not a prefix of one of its pieces: within a contraction such as 're, whose first
two characters are two pieces, and within a special string, which is ordinary text until it is whole. There
the few characters are cut anew.

Texts: null counts as empty, an empty text has 0 tokens; special strings inside a text are one token
each, as the library does by default. A text of any length is read whole; a piece of n bytes costs in
proportion to n. Rows that repeat are kept, an empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import rows
from .bpe import Bpe, Recent, json_ranks
from .pretokens import byte_level

FEW = (2, 1)


class PrefixCounter:
    """Exact counts for a byte-level vocabulary file (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        ranks, self.special = json_ranks(path)
        self.bpe, self.cut = Bpe(ranks), byte_level()
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._known = Recent(self._by_char)  # piece -> token count of each prefix in characters
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                ends.setdefault(token[-3:], set()).add(len(token))
        self._sizes = {tail: (*sorted(sizes, reverse=True), 2, 1) for tail, sizes in ends.items()}  # of tokens that end so

    def prefixes(self, piece: bytes) -> list[int]:
        """Token count of each prefix of one piece, from the empty one on."""
        n, ids, sizes, known, fits = len(piece), self.bpe.ranks.get, self._sizes.get, self.bpe.pairs.get, self.bpe.adjacent
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for size in sizes(piece[i - 3 : i], FEW) if i > 2 else FEW:
                at = i - size
                if at < 0 or (t := ids(piece[at:i])) is None:
                    continue
                if at:
                    before = last[at]
                    if not ((k := known((before, t))) or (k is None and fits(before, t))):
                        continue
                elif size > 1 and not self._whole(t):
                    continue
                last[i], count[i] = t, count[at] + 1
                break
        return count

    @functools.cache  # noqa: B019  one counter lives as long as its process
    def _whole(self, token: int) -> bool:
        return self.bpe.merge(self.bpe.bytes_of[token]) == [token]

    def _by_char(self, piece: str) -> bytes | list[int]:
        raw = piece.encode()
        count = self.prefixes(raw)
        if len(raw) != len(piece):  # a character begins at a byte that does not go on one
            count = [n for n, b in zip(count, raw, strict=False) if b & 0xC0 != 0x80] + count[-1:]
        return bytes(count) if count[-1] < 256 else count

    def by_char(self, piece: str) -> np.ndarray:
        """Token count of each prefix in characters."""
        kept = self._known[piece]
        return np.frombuffer(kept, np.uint8) if isinstance(kept, bytes) else np.array(kept)

    def pieces(self, text: str) -> tuple[list[str], list[int], set[int]]:
        """(pieces, tokens of each, places of those that are special strings)."""
        known = self._known
        if self._split is None or not (parts := self._split.split(text))[1:]:
            every = self.cut(text)
            return every, [known[p][-1] for p in every], set()
        every, count, special = [], [], set()
        for i, part in enumerate(parts):
            if i % 2:
                special.add(len(every))
                every.append(part)
                count.append(1)
            else:
                some = self.cut(part)
                every += some
                count += [known[p][-1] for p in some]
        return every, count, special

    def count(self, text: str) -> int:
        return sum(self.pieces(text)[1])

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class PrefixTable:
    """Exact counts of every prefix of one text: one number at each piece's end, the rest from the piece's own table."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.pieces, count, self.special = counter.pieces(text)
        self.totals = list(accumulate(count, initial=0))

    @functools.cached_property
    def ends(self) -> list[int]:
        return list(accumulate(map(len, self.pieces), initial=0))

    def __len__(self) -> int:
        return self.totals[-1]

    def _blank(self, k: int) -> bool:
        p = self.pieces[k]
        return k not in self.special and p.isspace() and not any("\x1c" <= c <= "\x1f" for c in p)

    def _longer(self, k: int) -> str:
        """Piece k, and if it is white space the next character too where that is: a prefix that ends there has both in one piece."""
        if self._blank(k) and k + 1 < len(self.pieces) and k + 1 not in self.special:
            first = self.pieces[k + 1][0]
            if first.isspace() and not "\x1c" <= first <= "\x1f":
                return self.pieces[k] + first
        return self.pieces[k]

    def count(self, chars: int) -> int:
        """Tokens of ``text[:chars]`` encoded on its own."""
        chars = min(chars, len(self.text))
        if chars <= 0:
            return 0
        k = bisect_left(self.ends, chars) - 1
        p, j = self.pieces[k], chars - self.ends[k]
        if k in self.special:
            if j == len(p):
                return self.totals[k + 1]
            k -= k > 0 and k - 1 not in self.special
            return self.totals[k] + self.counter.count(self.text[self.ends[k] : chars])
        if j == 1 and k and len(longer := self._longer(k - 1)) > len(self.pieces[k - 1]):
            return self.totals[k - 1] + int(self.counter.by_char(longer)[-1])
        if j == 2 and len(p) == 3 and p[0] == "'" and p[1].isalpha():
            return self.totals[k] + self.counter.count(p[:2])
        return self.totals[k] + int(self.counter.by_char(p)[j])

    def truncate(self, budget: int) -> int:
        """The longest prefix, in characters, of at most ``budget`` tokens."""
        if len(self) <= budget:
            return len(self.text)
        if budget <= 0:
            return 0
        k = bisect_right(self.totals, budget) - 1
        after = range(self.ends[k + 1] + 1, self.ends[min(k + 2, len(self.pieces))]) if k + 1 in self.special else range(0)
        within = range(self.ends[k] + 1, self.ends[k + 1] + 1)
        if k not in self.special:
            fits = np.flatnonzero(self.counter.by_char(self._longer(k)) <= budget - self.totals[k])
            within = [self.ends[k] + 1, *(fits[1:] + self.ends[k]).tolist()]
        for chars in (*reversed(after), *reversed(within)):
            if self.count(chars) <= budget:
                return chars
        return self.ends[k]

    def fits(self, chars: int, budget: int) -> bool:
        return self.count(chars) <= budget


@functools.cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and kept_chars, the longest prefix within the limit, of every row of docs (doc_id,
    text); rows that repeat are kept."""

    def fn(batch):
        c = counter(path)
        texts = batch.column("text").to_pylist()
        tables = map(c.table, texts)  # one at a time
        n, kept = zip(*[(len(t), t.truncate(limit)) for t in tables], strict=True)
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [k < len(t) for k, t in zip(kept, texts, strict=True)], "kept_chars": kept}

    return rows.map_batches(rows.texts(docs), fn, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, kept_chars long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(rows.documents(spark, sf_dir), rows.vocabulary("byte_bpe_50k.json"))
