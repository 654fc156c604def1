"""Links to vectors that are missing."""

import duckdb
import numpy as np
import pytest

from tarnmill.operators import graph as G
from tarnmill.plans import registry


def test_links_of_a_null_vector_are_as_in_sql(spark, tmp_path):
    r = np.random.default_rng(7)
    n = 500  # as many as its SQL reads, so both read all
    c = r.normal(size=8)
    v = [(c + 0.1 * x).tolist() for x in r.normal(size=(n, 8))]
    v[40] = (-c).tolist()  # its two links are the only weak ones
    v[10] = None
    spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(registry.ORACLES["vector_semantic_links"]).fetchall()
    got = [tuple(x) for x in registry.QUERIES["vector_semantic_links"](spark, str(tmp_path)).collect()]
    assert sorted((x[0], x[1], x[3]) for x in got) == sorted((x[0], x[1], x[3]) for x in want)
    assert {x[0] for x in got if x[3] == "weak"} == {40, next(s for s in range(n) if (s * 7 + 3) % n == 40)}


@pytest.mark.parametrize("missing", [None, [1.0, None]])
def test_a_link_without_a_whole_vector_is_not_weak(spark, missing):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, missing), (3, [0.0, 0.0]), (4, [1.0]), (5, [-1.0, 0.0])], "id long, v array<double>")
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 4), (1, 5), (1, 1)], "src long, dst long")
    got = [tuple(x) for x in G.semantic_links(edges, vectors).collect()]
    # a zero vector and one of another length are 0 alike by definition
    assert got == [(1, 5, -1.0, "weak"), (1, 3, 0.0, "weak"), (1, 4, 0.0, "weak"), (1, 1, 1.0, "strong")]
