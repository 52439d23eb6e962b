"""Scores of predictions against gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scores(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """(field, support, accuracy, macro_p, macro_r, macro_f1). gold: raw_item_id, field, gold; predictions: raw_item_id, field, predicted.

    A missing prediction counts as <none>. The macro averages are over the classes that
    gold has. Only the counts of pairs (gold, predicted) are shuffled beyond the join.
    """
    pairs = gold.join(predictions, ["raw_item_id", "field"], "left").select("field", "gold", F.coalesce("predicted", F.lit("<none>")).alias("predicted"))
    counted = pairs.groupBy("field", "gold", "predicted").agg(F.count("*").alias("n"))
    true = counted.groupBy("field", F.col("gold").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    said = counted.groupBy("field", F.col("predicted").alias("class")).agg(F.sum("n").alias("said"))
    per = true.join(said, ["field", "class"], "left").withColumns({"r": F.col("hit") / F.col("support"), "p": F.coalesce(F.try_divide(F.col("hit"), F.col("said")), F.lit(0.0))})
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    return per.groupBy("field").agg(F.sum("support").alias("support"), (F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg("p").alias("macro_p"), F.avg("r").alias("macro_r"), F.avg(f1).alias("macro_f1"))


def primary_metric(scored: DataFrame) -> DataFrame:
    """One row: the mean of the fields' macro F1."""
    return scored.agg(F.avg("macro_f1").alias("metric"))
