"""Queries read their tables whole."""

import numpy as np

from tarnmill.plans import registry

Q = registry.QUERIES


def test_semantic_links_of_every_vector(spark, tmp_path):
    r = np.random.default_rng(5)
    n = 620
    v = r.normal(size=(n, 8))
    v[(619 * 7 + 3) % n] = v[619] * 2  # a strongest link whose source is beyond id 500
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    v = v.astype(np.float32).astype(float)
    links = []
    for s in range(n):
        d = (s * 7 + 3) % n
        links.append((s, d, round(float(v[s] @ v[d] / np.sqrt((v[s] @ v[s]) * (v[d] @ v[d]))), 6)))
    weak = sorted((x for x in links if x[2] < 0.15), key=lambda x: (x[2], x[0], x[1]))[:50]
    strong = sorted((x for x in links if x[2] > 0.6), key=lambda x: (-x[2], x[0], x[1]))[:50]
    got = [tuple(x) for x in Q["vector_semantic_links"](spark, str(tmp_path)).collect()]
    want = [(*x, "weak") for x in weak] + [(*x, "strong") for x in strong]
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[3] for x in got] == [x[3] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-6) and strong[0][0] == 619
