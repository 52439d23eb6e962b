import datetime as dt

from pyspark.sql import functions as F

from newsloom.operators import graph as g

D = dt.date(2026, 3, 20)


def marks(spark, rows):
    return spark.createDataFrame(rows, "entity_id long, slug string, day date, portrayal string, severity_rank int")


def test_flat_baseline_uses_the_floor_and_share_is_inclusive(spark):
    rows = [(1, "a", D, "negative" if i < 3 else "neutral", 0) for i in range(10)]
    m = marks(spark, rows)
    r = g.spikes(m, m.agg(F.max("day").alias("as_of"))).first()
    assert r["is_threat"] and abs(r["z"] - (10 / 3) / 0.75) < 1e-5


def test_fewer_than_four_recent_is_no_spike(spark):
    m = marks(spark, [(1, "a", D, "neutral", 0)] * 3)
    assert g.spikes(m, m.agg(F.max("day").alias("as_of"))).count() == 0


def test_weeks_are_filled(spark):
    m = marks(spark, [(1, "a", D, "positive", 0), (2, "b", D - dt.timedelta(days=40), "negative", 0)])
    out = g.weekly(m, m.agg(F.max("day").alias("as_of")))
    assert out.groupBy("slug").count().where("count <> 8").count() == 0
    assert out.where("slug = 'a'").agg(F.sum("positive")).first()[0] == 1


def test_co_mentions_count_edges(spark):
    m = marks(spark, [(1, "a", D, "neutral", 0)]).withColumn("raw_item_id", F.lit(5).cast("long"))
    edges = spark.createDataFrame([(5, 1, "x"), (5, 2, "y"), (5, 2, "z")], "raw_item_id long, entity_id long, surface string")
    ents = spark.createDataFrame([(1, "a", "active", "person"), (2, "b", "active", "person")], "id long, slug string, status string, entity_type string")
    assert [tuple(r) for r in g.co_mentions(m, edges, ents).collect()] == [("a", "b", 2, 1)]
