import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tarnmill.llm.bpe import tiktoken_ranks
from tarnmill.llm.byte_bpe import TreeBpe, decoded, encoded, round_trip
from tarnmill.llm.pretokens import BYTE_LEVEL
from tarnmill.llm.token_counts import PrefixCounter, token_counts

TEXTS = ["", " ", "a", "Hello, world! don't 'll", "x  \n\n  y \t z \u0085q", "naïve éèêß ²½ ⅷ १२ 日本語 😀😀", "a" * 700, "ab" * 400 + " " * 50, "<|endoftext|>x<|endoftext|>", "_under_score__ $%&***", "\x1c\x1d x\x1cy"]


def more(n=60):
    r = random.Random(1)
    return TEXTS + ["".join(r.choices("the tion ing éß\n  1234.,'st<|>AB日", k=r.randint(1, 200))) for _ in range(n)]


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_counts_equal_the_library(counter, library):
    for t in more():
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_every_prefix_is_exact(counter, library):
    for t in [*more(8)[:19], "x  <|endoftext|>!! <|endoftext|>'re they're we'll \n\n b", "   \n" * 9 + "z", "a<|endof<|endoftext|><|endoftext|> "]:
        t, n = t[:150], lambda s: len(library.encode(s, add_special_tokens=False).ids)
        table = counter.table(t)
        counts = [n(t[:i]) for i in range(len(t) + 1)]
        assert [table.count(i) for i in range(len(t) + 1)] == counts
        for budget in (0, 1, 3, 7, 1000):
            assert table.truncate(budget) == max(i for i, c in enumerate(counts) if c <= budget)


def test_tree_equals_the_library():
    tree = TreeBpe(P.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=tiktoken_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert P.PATTERN == BYTE_LEVEL
    for t in more():
        ids = tree.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(t), t
        assert tree.decode(ids) == t.encode()
        for leaf in (1, 3):  # any tree gives the same
            piece = t.encode()[:120]
            assert tree.tree(piece, leaf) == tree.bpe.merge(piece)


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "x", 1), (2, "", "y", 2), (3, "Hello  world", "z", 3), (3, "Hello  world", "z", 3)], "doc_id long, text string, n_tokens string, ids int")
    path = P.path("byte_bpe_50k.json")
    got = sorted(map(tuple, token_counts(docs, path, 2).collect()))
    assert got == [(1, 0, 0, False, 0), (2, 0, 0, False, 0), (3, 12, 3, True, 6), (3, 12, 3, True, 6)]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    none = hashlib.sha256(b"").hexdigest()
    got = sorted(map(tuple, round_trip(docs, path).collect()))
    assert got[0] == (1, 0, none, none) and got[2] == got[3] and got[3][3] == hashlib.sha256(b"Hello  world").hexdigest()
    assert [bytes(r.bytes) for r in decoded(encoded(docs, path), path).orderBy("doc_id").collect()] == [b"", b"", b"Hello  world", b"Hello  world"]
    assert token_counts(docs.limit(0), path.replace("multi_50k.tiktoken", "50k.json")).count() == 0


def test_long_pieces(counter, library):
    r = random.Random(8)
    for t in ("a" * 100_000, "".join(r.choices("etaoinshrdlu", k=100_000)), " " * 50_000 + "x"):
        began = time.time()
        table = counter.table(t)
        cuts = [table.truncate(b) for b in (1, 100, 5000, 10**9)]
        assert time.time() - began < 10 and len(table) == len(library.encode(t, add_special_tokens=False).ids)
        began = time.time()
        assert [table.count(c) <= b for c, b in zip(cuts, (1, 100, 5000, 10**9), strict=True)] == [True] * 4
        assert table.count(cuts[2] + 1) > 5000 or len(table) <= 5000
    tree = TreeBpe(P.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=tiktoken_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for t in ("a" * 20_000, "".join(r.choices("etaoinshrdlu", k=20_000))):
        assert np.frombuffer(tree.encode(t), "<u4").tolist() == theirs.encode_ordinary(t)
        assert tree.bpe.merge(t[:3000].encode()) == theirs.encode_ordinary(t[:3000])
