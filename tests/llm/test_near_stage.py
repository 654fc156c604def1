import random

import numpy as np

import corpus_pipeline as C
from tarnmill.llm import jaccard_join as J


def shingled(text, width):
    w = text.split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def similarity(a, b, width):
    a, b = shingled(a, width), shingled(b, width)
    return len(a & b) / len(a | b)


def least_ids(texts, width, bound):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j], width) >= bound:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return set(root)


def test_stage_links_the_band_between_the_settings(spark):
    r = random.Random(3)
    texts = []
    for n in [49, 50, 51, 52, 60, 90, 100, 140, 190, 240, 300] * 2:
        base = [f"w{r.randrange(5000)}" for _ in range(n)]
        texts.append(" ".join(base))
        for changes in {max(1, n // 45), max(1, n // 48), n // 40}:
            w = list(base)
            for k in range(changes):
                w[(2 * k + 1) * n // (2 * changes)] = f"x{r.randrange(5000)}"
            texts.append(" ".join(w))
    band = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if similarity(a, b, 5) >= 0.8 and similarity(a, b, 4) < 0.85]
    want = least_ids(texts, 5, 0.8)
    assert band and want != least_ids(texts, 4, 0.85)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in C.jaccard_stage(spark, docs, "").collect()} == want


def test_keys_lose_no_link_at_four_fifths():
    r = np.random.default_rng(16)
    found = 0
    for _ in range(3000):
        n = int(r.choice([1, 2, 4, 5, 9, 10, 13, 30, 100, 333]))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) > r.choice([0, 0.08, 0.11])], r.integers(0, 2**63, r.integers(0, 1 + n // 8)).astype(np.uint64)]))
        if len(b) and J.linked(a, b, 80, 100):
            found += not J.linked(a, b)
            assert np.intersect1d(J.keys(a, 80, 100), J.keys(b, 80, 100)).size
    assert found


def test_one_row_of_each_component_stays(spark):
    r = random.Random(4)
    a, b, c, d, e = (" ".join(f"w{r.randrange(5000)}" for _ in range(30)) for _ in range(5))
    data = [(7, a), (None, a), (None, b), (None, c), (None, c), (4, d), (4, e), (3, e), (9, d), (9, d), (None, None), (None, ""), (5, ""), (5, ""), (6, "lone"), (8, b + " x"), (2, "twice"), (2, "twice")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in data], "doc_id long, text string, n_chars long").repartition(3)
    out = C.jaccard_stage(spark, docs, "")
    assert out.dtypes == docs.dtypes
    want = [(7, a), (None, c), (4, d), (3, e), (None, None), (None, ""), (5, ""), (5, ""), (6, "lone"), (8, b + " x"), (2, "twice")]
    assert sorted(((x.doc_id, x.text) for x in out.collect()), key=repr) == sorted(want, key=repr)
