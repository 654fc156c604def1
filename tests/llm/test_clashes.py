"""Stages and operators over columns named like their own, null and repeated ids, empty tables and very long texts."""

import random

import pytest

import corpus_pipeline as C
from tarnmill.llm import jaccard_join, rows, secret_scan, substring_dedup, toxicity

EXTRA = ["_row", "_least", "_root", "_copies", "_places", "_doc", "_key", "_out", "_gone", "_id", "_hash", "Node", "key", "toxic", "score", "one", "r"]


def table(spark, data):
    cols = ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[f"{c}{k}" for c in EXTRA]) for k, (i, t) in enumerate(data)], f"doc_id long, text string, lang string, source string, n_chars long, {cols}").repartition(3)


def test_stages_keep_columns(spark, tmp_path):
    r = random.Random(5)
    fresh = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    a, b, c, p = fresh(40), fresh(40), fresh(40), fresh(30)
    data = [(1, a), (1, b), (2, a), (None, c), (None, c), (None, fresh(30)), (3, None), (None, None), (4, ""), (5, f"{fresh(30)} {p} y"), (6, f"q {p} {fresh(30)}"), (None, f"{fresh(29)} {p}")]
    docs = table(spark, data)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        before, docs = docs, rows.stored(out, "test")
        got = docs.collect()
        if name == "ngram_jaccard_join":
            want = [(1, a), (1, b), (None, c), *data[5:]]
            assert sorted(((x.doc_id, x.text) for x in got), key=repr) == sorted(want, key=repr)
        else:
            assert len(got) == before.count()
        for x in got:  # each row is one of the input's, with its own columns
            k = x["_row"][4:]
            assert all(x[c] == f"{c}{k}" for c in EXTRA) and x.doc_id == data[int(k)][0]
    assert sum(p.split()[3] in (x.text or "").split() for x in got) == 1
    assert C.STAGES[-1][1](spark, docs, "").select("doc_id").where("doc_id is null").count() >= 3


@pytest.mark.parametrize("stage", range(5))
def test_stages_of_an_empty_table(spark, tmp_path, stage):
    docs = table(spark, [(1, "x")]).limit(0)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.STAGES[stage][1](spark, docs, str(tmp_path)).count() == 0


def test_very_long_texts(spark):
    r = random.Random(6)
    words = [f"w{r.randrange(4000)}" for _ in range(120_000)]
    one = "x" * 300_000
    docs = table(spark, [(1, " ".join(words)), (2, " ".join([*words[:-9], "end"])), (3, one), (4, one), (5, "tail " + " ".join(words[500:540]))])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(docs).collect()}
    assert {i: c for i, (_, c) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5} and got[3][0] == 1 and got[1][0] > 100_000
    got = {x.doc_id: x.n_removed for x in substring_dedup.substring_dedup(docs).collect()}
    assert got == {1: 0, 2: len(words) - 9, 3: 0, 4: 0, 5: 40}
    docs = table(spark, [(1, one + " password=abcdef123 " + one), (2, "a" * 400_000)])
    spans = {x.doc_id: (x.n_assign, x.n_hex, x.spans) for x in secret_scan.secrets(docs).collect()}
    assert spans[1][0] == 1 and spans[2] == (0, 1, "hex:0:400000")


def test_lexicon_of_long_words_and_repeated_ids(spark):
    long_word = "q" * 55
    bad = [(i, f"{long_word} word{i}") for i in range(30)]
    good = [(i, f"fine word{i} text") for i in range(100, 160)]
    docs = spark.createDataFrame(bad + good + [(0, f"other {k}") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in bad] + [(i, 0) for i, _ in good], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels)
    assert f" {long_word} " in lexicon.weights and lexicon.score(f"so {long_word} it is") > 0.5 > lexicon.score("fine text")
    left = f" {'y' * 200} scum {'z' * 90} "
    assert toxicity.pairs(left, left.index(" scum")) == [("y" * 200, "scum"), ("scum", "z" * 90)]
