import numpy as np
import pytest

from newsloom.operators import vectors as v


def test_order_decides_and_zero_vectors():
    m = np.array([[1.0, 0], [0.8, 0.6], [0, 1.0], [0, 0]])
    assert list(v.assign_in_order(m, 0.7)) == [0, 0, 1, 2]
    assert list(v.assign_in_order(m[::-1], 0.7, "first")) == [-1, 0, 1, 1] or list(v.assign_in_order(m[::-1], 0.7, "first"))[0] == -1


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in v.top_k(df, df.where("vec_id < 5").selectExpr("vec_id as query_id", "embedding"), 3, block=2).collect()}
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(5):
        want = np.argsort(-(m @ m[q]), kind="stable")[:3]
        assert [got[q, k + 1] for k in range(3)] == want.tolist()
    assert v.top_k(df, df.limit(0).selectExpr("vec_id as query_id", "embedding"), 3).count() == 0


def test_blocks_dimensions_and_allowed(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [1.0, 0.0])], "vec_id long, embedding array<double>")
    asked = df.where("vec_id in (1, 3, 4)").selectExpr("vec_id as query_id", "embedding")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in v.top_k(df, asked, 2).collect()}
    assert got == {(1, 1): 1, (1, 2): 5, (3, 1): 3}
    some = spark.createDataFrame([(2,), (2,)], "vec_id long")
    assert [r["vec_id"] for r in v.top_k(df, asked, 2, allowed=some).collect()] == [2] and v.top_k(df, asked, 0).count() == 0


def test_quantised_recall(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(800)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding")
    exact = {(r["query_id"], r["vec_id"]) for r in v.top_k(df, asked, 5).collect()}
    index = v.quantised(df)
    found = {(r["query_id"], r["vec_id"]) for r in v.top_k_quantised(index, df, asked, 5).collect()}
    assert index.count() == 800 and len(exact & found) >= 0.99 * len(exact)


def test_embeddings(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    rows = [r[0] for r in df.select(v.hash_embedding(F.col("t"), 40)).collect()]
    assert len(rows[0]) == 40 and abs(np.linalg.norm(rows[0]) - 1) < 1e-9 and rows[0] != rows[1] and rows[2] is None
    with pytest.raises(Exception, match="3 dimensions"):
        v.provider_embeddings(df, "t", "t", lambda texts: [[1.0]] * len(texts), 3).collect()
