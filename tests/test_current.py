import datetime as dt

from newsloom.operators.current import current_analyses
from newsloom.operators.scoring import primary_metric, scores

D = dt.datetime(2026, 1, 2)
ROWS = [(1, 7, "mock-a", dt.datetime(2026, 2, 1)), (2, 7, "real", D), (3, 7, "real", D), (4, 8, "mock-a", D), (5, 8, "real", None), (6, 9, None, D)]


def best(spark, name):
    df = spark.createDataFrame(ROWS, "id long, raw_item_id long, model_name string, created_at timestamp")
    return {r["raw_item_id"]: r["id"] for r in current_analyses(df, name).collect()}


def test_policies_differ_on_ties_stand_ins_and_nulls(spark):
    assert best(spark, "kpi") == {7: 2, 8: 5, 9: 6}
    assert best(spark, "graph") == {7: 3, 8: 5, 9: 6}
    assert best(spark, "latest_id") == {7: 3, 8: 5, 9: 6}
    assert best(spark, "chat") == {7: 1, 8: 4, 9: 6}


def test_scores_count_missing_predictions(spark):
    gold = spark.createDataFrame([(1, "f", "a"), (2, "f", "a"), (3, "f", "b")], "raw_item_id long, field string, gold string")
    said = spark.createDataFrame([(1, "f", "a"), (3, "f", "c")], "raw_item_id long, field string, predicted string")
    r = scores(gold, said).first()
    assert (r["support"], round(r["accuracy"], 4), round(r["macro_f1"], 4)) == (3, 0.3333, 0.3333)
    assert primary_metric(scores(gold.limit(0), said)).first()["metric"] is None
