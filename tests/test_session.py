from pyspark.sql import functions as F

from newsloom import session


def test_small_counts_rows_and_bytes(spark):
    df = spark.range(10).select("id", F.array_repeat("id", 1000).alias("a"))
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(session.small(df)) and not hinted(session.small(df, limit=9)) and not hinted(session.small(df, most=1000))
    assert hinted(session.small(df.limit(0)))


def test_salted_join_equals_plain(spark):
    many = spark.range(200).select("id", F.when(F.col("id") < 150, 1).otherwise(F.col("id")).alias("k"))
    few = spark.createDataFrame([(1, "a"), (160, "b"), (None, "c")], "k long, v string")
    got = {tuple(r) for r in session.salted_join(many, few, ["k"], F.col("id")).select("id", "v").collect()}
    assert got == {tuple(r) for r in many.join(few, "k").select("id", "v").collect()} and len(got) == 151


def test_stored_tables_can_be_removed(spark):
    kept = session.stored(spark.range(3).toDF("id"), "t")
    assert kept.count() == 3
    session.clear_stored(spark)
    assert session.stored(spark.range(2).toDF("id"), "t").count() == 2
