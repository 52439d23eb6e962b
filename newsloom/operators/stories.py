"""Stories as groups of items with one content: sizes, sources, timing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def story_stats(items: DataFrame, key: str = "content_hash") -> DataFrame:
    """(key, size, sources, span_h, stamps, representative, coordination).

    coordination: 0 for one item; without two times a fifth for each source; else a
    quarter for each source, falling to 0 as the items spread over 72 hours; 1 at most.
    """
    per = items.groupBy(key).agg(
        F.count("*").alias("size"),
        F.count_distinct("source_name").alias("sources"),
        ((F.unix_micros(F.max("published_at")) - F.unix_micros(F.min("published_at"))) / 3.6e9).alias("span_h"),
        F.count("published_at").alias("stamps"),
        F.min("id").alias("representative"),
    )
    near = F.round(F.least(F.lit(1.0), F.col("sources") / 4) * F.greatest(F.lit(0.0), 1 - F.col("span_h") / 72), 3)
    return per.withColumn("coordination", F.when(F.col("size") < 2, 0.0).when(F.col("stamps") < 2, F.least(F.lit(1.0), F.col("sources") / 5)).otherwise(near))


def momentum(items: DataFrame, key: str = "content_hash", recent_days: int = 3, days: int = 7) -> DataFrame:
    """(key, momentum): rising, fading or steady as the recent days hold more, fewer or as many items as those before; flat below two."""
    now = items.agg(F.max("published_at").alias("_now"))
    age = (F.unix_micros("_now") - F.unix_micros("published_at")) / 8.64e10
    per = items.crossJoin(F.broadcast(now)).groupBy(key).agg(F.count_if(age <= recent_days).alias("a"), F.count_if((age > recent_days) & (age <= days)).alias("b"))  # one row
    return per.select(key, F.when(F.col("a") + F.col("b") < 2, "flat").when(F.col("a") > F.col("b"), "rising").when(F.col("a") < F.col("b"), "fading").otherwise("steady").alias("momentum"))
