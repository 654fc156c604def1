import hashlib
import random
import re

import pytest

from tarnmill.llm.substring_dedup import substring_dedup, without_repeats

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(data, window=20):
    docs = [(d, W.findall(t or "")) for d, t in data]
    key = lambda d: -(2**63) if d is None else d
    first = {}
    for d, w in docs:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (key(d), s)), (key(d), s))
    out = []
    for d, w in docs:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (key(d), s):
                gone.update(range(s, s + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: (key(r[0]), r))


def corpus():
    r = random.Random(9)
    vocab = [f"wö{i}" if i % 5 else f"W{i}," for i in range(3000)]
    passages = [r.choices(vocab, k=k) for k in (19, 20, 21, 35, 60, 150)]
    out = []
    for i in range(150):
        w = r.choices(vocab, k=r.choice([0, 3, 18, 40, 120]))
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            p, at = r.choice(passages), r.randint(0, len(w))
            w[at:at] = p[r.choice([0, 0, 3]) : r.choice([len(p), len(p), len(p) - 2])]
        if i % 25 == 0:
            w += ["la"] * 70 + ["a", "b"] * 30
        out.append((r.randrange(10**6), r.choice([" ", "\n", " \t"]).join(w)))
    return [*dict(out).items()]


@pytest.mark.parametrize("hot", [4096, 5])
def test_equals_brute_force(spark, hot):
    data = corpus()
    data += [(2 * 10**6, None), (2 * 10**6 + 1, ""), (2 * 10**6 + 2, " \n"), data[3], data[3], (None, data[3][1])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in data], "doc_id long, text string, start int").repartition(5)
    got = sorted(map(tuple, substring_dedup(docs, hot=hot).collect()), key=lambda r: (-(2**63) if r[0] is None else r[0], r))
    assert got == brute(data)


def test_texts_follow(spark):
    p = " ".join(f"x{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a  b " + p, 0), (2, "c\n" + p + " d  e", 0), (3, None, 0), (4, "q  r", 4)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in without_repeats(docs).collect()}
    assert got[1][0] == "a  b " + p and got[2] == ("c d e", 5) and got[3][0] is None and got[4] == ("q  r", 4)
    assert substring_dedup(docs.limit(0)).count() == 0
