"""Models and their versions: evaluation, promotion, what is live, one pass of the label loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .current import best_row
from .scoring import scores


def evaluated(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """(model_name, version, primary_metric, eval_examples): the mean macro F1 of the fields, and how many gold labels there are, for each model and version. predictions: model_name, version, raw_item_id, field, predicted. A model without any gold label of its items has none."""
    models = predictions.select("model_name", "version").distinct()
    wanted = gold.crossJoin(F.broadcast(models))  # a few models
    pairs = wanted.join(predictions, ["model_name", "version", "raw_item_id", "field"], "left").select("model_name", "version", "field", "gold", F.coalesce("predicted", F.lit("<none>")).alias("predicted"))
    counted = pairs.groupBy("model_name", "version", "field", "gold", "predicted").agg(F.count("*").alias("n"))
    key = ["model_name", "version", "field"]
    true = counted.groupBy(*key, F.col("gold").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    said = counted.groupBy(*key, F.col("predicted").alias("class")).agg(F.sum("n").alias("said"))
    per = true.join(said, [*key, "class"], "left").withColumns({"r": F.col("hit") / F.col("support"), "p": F.coalesce(F.try_divide(F.col("hit"), F.col("said")), F.lit(0.0))})
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    fields = per.groupBy(*key).agg(F.avg(f1).alias("f1"), F.sum("support").alias("support"))
    return fields.groupBy("model_name", "version").agg(F.avg("f1").alias("primary_metric"), F.sum("support").alias("eval_examples"))


def promotions(registry: DataFrame, candidates: DataFrame, least: float = 0.0) -> DataFrame:
    """(model_name, version, candidate_metric, incumbent_metric, promoted, reason) for candidates (model_name, version): the first of a name goes live; one that is live stays; one without gold never goes; else it must reach the live one's metric and `least` more, so an equal one goes live where nothing more is asked. registry: model_name, version, primary_metric, eval_examples, is_live."""
    live = registry.where("is_live").select("model_name", F.col("version").alias("_live"), F.col("primary_metric").alias("incumbent_metric"))
    joined = candidates.join(registry, ["model_name", "version"]).join(live, "model_name", "left")
    reason = F.when(F.col("eval_examples") <= 0, "no gold").when(F.col("_live").isNull(), "first").when(F.col("_live") == F.col("version"), "live").when(F.col("primary_metric") >= F.col("incumbent_metric") + least, "better").otherwise("kept incumbent")
    return joined.select("model_name", "version", F.col("primary_metric").alias("candidate_metric"), "incumbent_metric", reason.isin("first", "live", "better").alias("promoted"), reason.alias("reason"))


def after(registry: DataFrame, decided: DataFrame) -> DataFrame:
    """The registry after promotions: of a name with a promoted version that one is live and no other."""
    won = decided.where("promoted").select("model_name", F.col("version").alias("_won"))
    return registry.join(won, "model_name", "left").withColumn("is_live", F.when(F.col("_won").isNotNull(), F.col("version") == F.col("_won")).otherwise(F.col("is_live"))).drop("_won")


def live_models(registry: DataFrame) -> DataFrame:
    """The live version of each name; of several the latest."""
    return best_row(registry.where("is_live"), ["model_name"], [F.desc("version")])


def stub_version(fingerprint: str) -> str:
    """The version that a trainer gives a model trained on a labelled set of that fingerprint."""
    return f"stub-{fingerprint}"


__all__ = ["after", "evaluated", "live_models", "promotions", "scores", "stub_version"]
