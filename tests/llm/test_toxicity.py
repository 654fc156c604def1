import random

from tarnmill.llm.toxicity import Lexicon, fit, fold, scored, without_toxic


def test_folding():
    assert fold("St00pid, ЅТUPID! $cum $$$ 1234 naïve") == " stoopid stupid scum 1234 naïve ".replace("l", "i")
    assert fold("l0ser") == fold("Loser") == " ioser "


def test_exceptions_take_hits_back():
    x = Lexicon({" trash ": 5.0, " scum": 4.0}, {("trash", "can")})
    assert x.hits(fold("the trash can")) == {} and len(x.hits(fold("Trash scummy trash"))) == 3


def test_learns_and_scores(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghmnoprstuvw", k=5)) for _ in range(300)]
    text = lambda bad: " ".join(r.choices(words, k=60) + ([r.choice(["moron", "scum"]) for _ in range(3)] if bad else ["trash", "can"] if r.random() < 0.3 else []))
    data = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(1000, None, "x"), (1001, "", "x"), (1002, "you m0r0n " * 3, "x"), (1002, "you m0r0n " * 3, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in data] + [(None, 1, 0), (5000, None, 0)], "doc_id long, toxic int, quality int")
    lexicon = fit(docs, labels)
    got = scored(docs, lexicon).collect()
    truth = {i: y for i, _, y in data}
    held = [g for g in got if g.held_out and g.doc_id in truth]
    assert len(held) > 50 and sum(g.predicted == truth[g.doc_id] for g in held) / len(held) > 0.98
    assert [g.predicted for g in got if g.doc_id in (1000, 1001)] == [0, 0]
    assert [g.predicted for g in got if g.doc_id == 1002] == [1, 1]
    assert without_toxic(docs, lexicon).columns == docs.columns
    assert without_toxic(docs, lexicon).where("doc_id = 1000").count() == 1
    none = fit(docs, labels.limit(0))
    assert scored(docs, none).where("predicted = 1").count() == 0
    assert scored(docs.limit(0), lexicon).count() == 0
