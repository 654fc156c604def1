import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tarnmill.llm import packing

PATH = P.path("word_bpe_49k.json")


def test_ids_equal_the_library():
    ours, theirs, r = packing.WordBpe(PATH), Tokenizer.from_file(PATH), random.Random(3)
    texts = ["", " \n", "Hello, World's 1234 ½²!", "ΑΣ Σ ΣΑΣ", "İstanbul É e\u0301", "<|endoftext|> a<|startoftext|>b", "日本語 😀", "\x1c x", "_a_b__"]
    texts += ["".join(r.choices("the tion ing éßÀ\n  12.,'st<|>AB日", k=r.randint(1, 150))) for _ in range(200)]
    for t in texts:
        assert np.frombuffer(ours(t), "<u2").tolist() == theirs.encode(t, add_special_tokens=False).ids, t


def test_hilbert_is_a_curve():
    cells = np.array(list(itertools.product(range(4), repeat=3)))
    k = packing.hilbert(cells, bits=2)
    assert sorted(k) == list(range(64))
    assert (np.abs(np.diff(cells[np.argsort(k)], axis=0)).sum(axis=1) == 1).all()


def test_pieces_rebuild_documents(spark):
    r = random.Random(4)
    data = [(i, " ".join(r.choices(["alpha", "beta", "gamma", "delta's", "x1"], k=r.choice([0, 1, 30, 400, 9000])))) for i in range(40)]
    data += [(100, None), (101, ""), (7, data[7][1]), (None, "no id")]
    docs = spark.createDataFrame([(*d, 5) for d in data], "doc_id long, text string, length int")
    got = packing.packed(docs, PATH, range_ids=20_000).collect()
    ours, ids = packing.WordBpe(PATH), defaultdict(list)
    for d, t in data:
        ids[d].append(np.append(np.frombuffer(ours(t or ""), "<u2"), packing.CLOSE).astype("<u4"))
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in got:
        by_seq[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
        assert p.doc_tokens == len(ids[p.doc_id][0]) and p.length > 0
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][0][p.start : p.start + p.length].tobytes())
    for s in by_seq.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == [0, *itertools.accumulate(p.length for p in s)][:-1]
        size = sum(p.length for p in s)
        assert size == 4096 or size & (size - 1) == 0 and size < 4096
    for d, pieces in by_doc.items():
        copies = len(ids[d])
        assert sum(p.length for p in pieces) == copies * len(ids[d][0])
        assert set(itertools.chain.from_iterable(range(p.start, p.start + p.length) for p in pieces)) == set(range(len(ids[d][0])))
    assert len(by_doc) == len(ids)
    assert packing.packed(docs.limit(0), PATH).count() == 0
