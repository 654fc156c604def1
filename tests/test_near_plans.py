"""Joins of fingerprints broadcast nothing that grows with the table."""

import random

import pytest

from tarnmill.operators import graph as G
from tarnmill.operators import simhash as S


@pytest.fixture
def plans(monkeypatch):
    """The plans of all that is stored on the way, and ``seen`` for the last one."""
    got = []

    def seen(df):
        got.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    for m in (S, G):
        keep = m.stored
        monkeypatch.setattr(m, "stored", lambda df, name="step", keep=keep: keep(seen(df), name))
    return got, seen


def prints(spark):
    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(40)]
    some = base + [x ^ (1 << r.randrange(63)) for x in base] + base[:5]
    return spark.createDataFrame(list(enumerate(some)), "id long, fingerprint long"), some


def near(some):
    one = sorted(set(some))
    return {(a, b) for i, a in enumerate(one) for b in one[i + 1 :] if (a ^ b).bit_count() <= 6}


def test_pairs_broadcast_nothing(spark, plans):
    p, some = prints(spark)
    got, seen = plans
    assert {(x.a, x.b) for x in seen(S.near_pairs(p)).collect()} == near(some)
    assert not any("Broadcast" in x for x in got)


def test_components_broadcast_nothing(spark, plans):
    p, some = prints(spark)
    got, seen = plans
    links = near(some)
    root = {x: x for x in some}
    for _ in some:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    found = {x.id: x.root for x in seen(G.components(spark.createDataFrame(sorted(links), "a long, b long"))).collect()}
    assert found == {x: root[x] for pair in links for x in pair}
    assert not any("Broadcast" in x for x in got)


def test_groups_hash_texts_once(spark, tmp_path, plans):
    from tarnmill.plans import graphs

    words = "a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd".split()
    texts = [" ".join(words), " ".join(words), " ".join(reversed(words)), "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, seen = plans
    rows = seen(graphs.near_duplicate_groups(spark, str(tmp_path))).collect()
    of = {x.id: x.group_id for x in rows}
    assert len(rows) == 3 and of[0] == of[1] != of[2]
    assert "ArrowEvalPython" not in got[-1] and "Broadcast" not in got[-1]


def test_greedy_broadcasts_nothing(spark, plans):
    p, some = prints(spark)
    got, seen = plans
    first, group = {}, {}
    for i, x in enumerate(some):
        first.setdefault(x, i)
    for x, i in sorted(first.items(), key=lambda kv: kv[1]):
        if x not in group:
            group |= {y: i for y in first if y not in group and (x ^ y).bit_count() <= 6}
    found = {x.id: x.group_id for x in seen(S.greedy_groups(p)).collect()}
    assert found == {i: group[x] for i, x in enumerate(some)}
    assert not any("Broadcast" in x for x in got)
