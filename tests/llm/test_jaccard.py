import random
import re

import numpy as np
import pytest

from tarnmill.llm import jaccard_join as J
from tarnmill.llm.components import components


def shingled(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(data):
    s = [(d, shingled(t)) for d, t in data]
    root = list(range(len(s)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            a, b = s[i][1], s[j][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(s):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return sorted((d, len(x), least[find(i)]) for i, (d, x) in enumerate(s))


def corpus(n, seed):
    r = random.Random(seed)
    vocab = [f"W{i}é" if i % 7 else f"w{i}" for i in range(400)]
    out = []
    while len(out) < n:
        base = r.choices(vocab, k=r.choice([1, 2, 3, 4, 5, 6, 9, 15, 30, 60, 120, 300, 900]))
        for _ in range(r.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1])] = [r.choice(vocab)]
            out.append(r.choice([" ", "\n", "\t "]).join(w))
    return [(i * 3, t) for i, t in enumerate(out[:n])]


@pytest.mark.parametrize("block", [4096, 3])
def test_equals_brute_force(spark, block, monkeypatch):
    data = corpus(160, block) + [(1000, None), (1001, ""), (1002, " \n "), (1, "one"), (2, "ONE"), (2, "ONE")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in data], "doc_id long, text string, node string")
    got = sorted(map(tuple, J.jaccard_components(docs, block=block).collect()))
    assert got == brute(data)


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keys_lose_no_link():
    r = np.random.default_rng(6)
    for _ in range(3000):
        n = int(r.choice([1, 2, 6, 7, 12, 13, 30, 100, 333]))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) > r.choice([0, 0.05, 0.08])], r.integers(0, 2**63, r.integers(0, 1 + n // 12)).astype(np.uint64)]))
        if len(b) and J.linked(a, b):
            assert np.intersect1d(J.keys(a), J.keys(b)).size


def test_tree_bounds_lose_no_link():
    r = np.random.default_rng(7)
    base = [np.unique(r.integers(0, 2**63, 80).astype(np.uint64)) for _ in range(12)]
    every = [np.unique(np.concatenate([b[r.random(len(b)) > 0.04], r.integers(0, 2**63, r.integers(0, 4)).astype(np.uint64)])) for b in base for _ in range(60)]
    points, sizes = J.alike([J.point(h) for h in every]), np.array([len(h) for h in every])
    tree = J.RTree(points, sizes)
    for i in range(0, len(every), 37):
        assert {j for j in range(len(every)) if J.linked(every[i], every[j])} <= set(tree.candidates(points[i], sizes[i]).tolist())


def test_points_fold():
    r = np.random.default_rng(11)
    h = np.unique(r.integers(0, 2**63, 5000).astype(np.uint64))
    assert len(J.point(h)) == 1024 and (J.folded(J.point(h), 64) == np.bincount((h & np.uint64(63)).astype(int), minlength=64)).all()


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(-50, 200), r.randrange(-50, 200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
