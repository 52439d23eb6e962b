import random

from pyspark.sql import functions as F

from newsloom.llm import splits
from newsloom.llm.forest import spanning_forest

from .fixtures import entities, items


def groups_of(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in pairs:
        parent[find(u)] = find(v)
    out = {}
    for x in list(parent):
        out.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in out.values()}


def test_forest_against_union_find(spark):
    random.seed(3)
    edges = [(f"n{random.randint(0, 60)}", f"n{random.randint(0, 60)}", random.randint(0, 9)) for _ in range(45)] + [("a", "b", 1)] * 3 + [("c", "c", 1), (None, "d", 1)]
    df = spark.createDataFrame(edges, "u string, v string, w long")
    forest, components = spanning_forest(df)
    real = [(u, v) for u, v, _ in edges if u and u != v]
    found = {}
    for r in components.collect():
        found.setdefault(r["root"], set()).add(r["node"])
    assert {frozenset(g) for g in found.values()} == groups_of(real)
    assert forest.count() == components.count() - components.select("root").distinct().count()
    assert groups_of([(r["u"], r["v"]) for r in forest.collect()]) == groups_of(real)


def test_long_path_and_empty(spark):
    path = spark.range(200).select(F.col("id").cast("string").alias("u"), (F.col("id") + 1).cast("string").alias("v"), F.col("id").alias("w"))
    assert spanning_forest(path)[1].select("root").distinct().count() == 1
    assert spanning_forest(path.limit(0))[1].count() == 0


def test_groups(spark):
    e, a = entities(spark)
    rows = [
        dict(id=5, source_name=" the post ", metadata_json={"author": "Ann Lee"}), dict(id=6, source_name="Post Online"), dict(id=7, source_name="Other", metadata_json={"author": "LEE,  ann"}),
        dict(id=8, source_name="Third", metadata_json={"author": "Cy Dow"}), dict(id=9, source_name="Fourth", metadata_json={"author": "Cy Dow"}), dict(id=10), dict(id=11, source_name=" "), dict(id=None, source_name="x"),
    ]
    labels = spark.createDataFrame([(i,) for i in (7, 6, 8, 9, 10, 11, 6, 99, None)], "raw_item_id long")
    got = {r["raw_item_id"]: r["group_first_id"] for r in splits.labelled_groups(items(spark, rows), labels, e, a).collect()}
    assert got == {6: 6, 7: 6, 8: 8, 9: 9, 10: 10, 11: 11, 99: 99}


def test_shares_of_many_groups(spark):
    sizes = spark.range(6000).select(F.col("id").alias("group_first_id"), (1 + F.col("id") % 7).alias("n"))
    out = splits.split_groups(sizes)
    total = out.agg(F.sum("n")).first()[0]
    share = {r["split"]: r["s"] / total for r in out.groupBy("split").agg(F.sum("n").alias("s")).collect()}
    assert out.count() == 6000 and all(abs(share[k] - v) < 0.02 for k, v in splits.SHARES.items())
    mixed = spark.createDataFrame([(1, 3000), (2, 900), (3, 800), *((i, 1 + i % 5) for i in range(10, 1800))], "group_first_id long, n long")
    rows = {r["split"]: r["s"] for r in splits.split_groups(mixed).groupBy("split").agg(F.sum("n").alias("s")).collect()}
    assert all(abs(rows[k] / sum(rows.values()) - v) < 0.02 for k, v in splits.SHARES.items())
    assert splits.split_groups(sizes.limit(0)).count() == 0
    assert splits.split_groups(spark.createDataFrame([(1, 900), (2, 1)], "group_first_id long, n long")).where("group_first_id = 1").first()["split"] == "train"
