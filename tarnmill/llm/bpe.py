"""Byte-pair encoding by ranks: the merge loop, the test that two tokens may stand side by side, and vocabulary files.

Two facts carry everything here. (1) The tokens of an encoding that cover a span are the span's own
encoding, as no merge crossed its ends. (2) So a sequence of tokens is the encoding of its bytes if
and only if every two neighbours ``a b`` encode to ``[a, b]``: the first merge to cross a boundary
would also be made among those two alone.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Sequence

PAIR_CACHE, SHORT = 400_000, 12


class Recent(dict):
    """What ``solve`` gives for a piece, remembered in two generations: when the younger has ``most`` pieces the older goes, so
    pieces that keep coming stay. Pieces of over ``longest`` characters are solved each time."""

    def __init__(self, solve, most: int = 150_000, longest: int = 64):
        super().__init__()
        self.solve, self.most, self.longest, self.old = solve, most, longest, {}

    def __missing__(self, piece):
        found = self.old.get(piece)
        if found is None:
            found = self.solve(piece)
            if len(piece) > self.longest:
                return found
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


def tiktoken_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {chr(b): b for b in plain}
    shown |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return shown


def json_ranks(path: str, end: bytes = b"") -> tuple[dict[bytes, int], dict[str, int]]:
    """(token bytes to id, special strings to id) of a byte-level BPE vocabulary whose ids follow its merges.
    ``end`` stands for the end-of-word suffix, if the vocabulary has one."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    special = {t["content"]: t["id"] for t in d["added_tokens"]}
    suffix = d["model"].get("end_of_word_suffix") or ""
    shown, ranks = _byte_alphabet(), {}
    for token, i in d["model"]["vocab"].items():
        if token in special:
            continue
        tail = bool(suffix) and token.endswith(suffix)
        body = token[: -len(suffix)] if tail else token
        ranks[bytes(shown[c] for c in body) + (end if tail else b"")] = i
    return ranks, special


class Bpe:
    """Encodes byte strings that the caller has cut; ranks double as ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        self._short: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The merge loop itself: join the leftmost neighbours of least rank, until none has a rank."""
        if len(piece) > 64:
            return self._merge_long(piece)
        none, rank = len(self.ranks) + 1 << 32, self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of (rank, place): time grows with n log n."""
        n, rank = len(piece), self.ranks.get
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if j < n and (r := rank(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue  # one of the two has been joined since
            alive[j], end[i], after[i] = False, end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [self.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, piece: bytes) -> list[int]:
        """merge(), remembered for short pieces: parts of words repeat far more than words do."""
        known = self._short.get(piece)
        if known is None:
            known = self.merge(piece)
            if len(piece) <= SHORT:
                if len(self._short) >= PAIR_CACHE:
                    self._short.clear()
                self._short[piece] = known
        return known

    def adjacent(self, a: int, b: int) -> bool:
        """Whether token b may follow token a in an encoding."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))
