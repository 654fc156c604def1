import random

from tarnmill.llm.substring_dedup import without_repeats


def test_texts_without_an_id_and_texts_that_share_one(spark):
    r = random.Random(12)
    fresh = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    p, q, s, t = (fresh(25) for _ in range(4))
    a = fresh(30) + p + fresh(5) + p + fresh(40)  # repeats within one text without an id
    b, c = fresh(125), [*fresh(40), *q, *fresh(9)]
    d = [*fresh(40), *q, *fresh(9)]  # the same place as in c, also without an id
    e, f = [*fresh(10), *s, *fresh(8)], [*fresh(10), *s, *fresh(8)]  # texts of one id
    g, h = t + fresh(30), fresh(20) + t  # an id's passage is later than that of a text without one
    data = [(None, a), (None, b), (None, c), (None, d), (5, e), (5, f), (6, g), (None, h), (7, fresh(60))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in data], "doc_id long, text string").repartition(3)
    got = [(x.doc_id, x.text.split()) for x in without_repeats(docs).collect()]
    assert len(got) == len(data)
    for i, w in data:  # each row keeps its own words
        same = [v for j, v in got if i == j and v and set(v) <= set(w)]
        assert len(same) == 1 and set(w) - set(same[0]) <= {*p, *q, *s, *t}
    for passage in (p, q, s, t):  # one copy of each stays
        assert sum(v.count(passage[0]) for _, v in got) == 1
    assert sum(len(v) for _, v in got) == sum(len(w) for _, w in data) - 4 * 25
    assert [v for j, v in got if j == 6] == [g[25:]]
