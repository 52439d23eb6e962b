import datetime as dt

from newsloom.operators import stories as st

T0 = dt.datetime(2026, 1, 8)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, content_hash string, source_name string, published_at timestamp")


def test_coordination(spark):
    rows = [(1, "a", "s1", T0), (2, "a", "s2", T0 + dt.timedelta(hours=18)), (3, "b", "s1", T0), (4, "c", "s1", None), (5, "c", "s2", T0), (6, "d", "s1", T0), (7, "d", "s2", T0 - dt.timedelta(days=9))]
    got = {r["content_hash"]: r["coordination"] for r in st.story_stats(frame(spark, rows)).collect()}
    assert got == {"a": 0.375, "b": 0.0, "c": 0.4, "d": 0.0}
    assert st.story_stats(frame(spark, [])).count() == 0


def test_momentum(spark):
    day = lambda n: T0 - dt.timedelta(days=n)
    rows = [(1, "up", "s", day(0)), (2, "up", "s", day(3)), (3, "down", "s", day(4)), (4, "down", "s", day(5)), (5, "flat", "s", day(8)), (6, "flat", "s", None), (7, "even", "s", day(1)), (8, "even", "s", day(6))]
    got = {r["content_hash"]: r["momentum"] for r in st.momentum(frame(spark, rows)).collect()}
    assert got == {"up": "rising", "down": "fading", "flat": "flat", "even": "steady"}
