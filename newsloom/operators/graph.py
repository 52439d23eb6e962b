"""Mentions of entities, their daily and weekly counts, surges and co-mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .current import current_analyses, item_day, relevant, severity_rank, subject_portrayal

WATCHED = ("person", "party", "district", "department", "office", "scheme")


def gated_items(t) -> DataFrame:  # noqa: ANN001
    """Items with their current analysis that pass the gate: raw_item_id, analysis_id, day, portrayal, severity rank and labels. Texts aren't read."""
    best = current_analyses(t.ai_analysis.select("id", "raw_item_id", "model_name", "created_at", "government_relevance", "tvk_portrayal", "stance_toward_government", "severity", "district", "needs_human_review"))
    items = t.raw_items.select(F.col("id").alias("raw_item_id"), "published_at", "ingested_at", "source_name")
    joined = best.where(relevant()).join(items, "raw_item_id")
    return joined.select("raw_item_id", F.col("id").alias("analysis_id"), item_day().alias("day"), subject_portrayal().alias("portrayal"), severity_rank().alias("severity_rank"), "district", "needs_human_review", "source_name")


def mentions(t) -> DataFrame:  # noqa: ANN001
    """One row per (entity, item) among the gated items, however many surfaces name it; candidates are left out."""
    edges = t.item_entities.select("raw_item_id", "entity_id").distinct()
    entities = t.entities.where("status <> 'candidate'").select(F.col("id").alias("entity_id"), "slug", "canonical_name", "entity_type", "status")
    return edges.join(entities, "entity_id").join(gated_items(t), "raw_item_id")


def as_of(gated: DataFrame) -> DataFrame:
    """One row: the last day of the gated items."""
    return gated.agg(F.coalesce(F.max("day"), F.lit("1970-01-01").cast("date")).alias("as_of"))


def favourability(pos: Column, neg: Column) -> Column:
    """0 to 100, 50 where they balance, null without either; rounded half to even."""
    return F.bround(50 + 50 * (pos - neg) / F.nullif(pos + neg, F.lit(0))).cast("int")


def count_of(kind: str) -> Column:
    return F.count_if(F.col("portrayal") == kind)


def spikes(marks: DataFrame, last: DataFrame, recent_days: int = 3, baseline_days: int = 10, least: int = 4, z_least: float = 1.0, threat_share: float = 0.3, floor: float = 0.75) -> DataFrame:
    """Entities whose recent daily rate surges over a baseline of whole days, absent days counting 0.

    The baseline's mean and population deviation come from the sums of daily counts and
    of their squares, so no table of days is needed.
    """
    placed = marks.crossJoin(F.broadcast(last)).withColumn("_age", F.datediff("as_of", "day"))  # one row
    daily = placed.where(F.col("_age") < recent_days + baseline_days).groupBy("entity_id", "slug", "_age").agg(
        F.count("*").alias("n"), count_of("negative").alias("neg"), F.count_if(F.col("severity_rank") >= 3).alias("severe")
    )
    now = F.col("_age") < recent_days
    per = daily.groupBy("entity_id", "slug").agg(
        F.sum(F.when(now, F.col("n")).otherwise(0)).alias("recent"),
        F.sum(F.when(now, F.col("neg")).otherwise(0)).alias("recent_negative"),
        F.sum(F.when(now, F.col("severe")).otherwise(0)).alias("severe"),
        F.sum(F.when(now, 0).otherwise(F.col("n"))).alias("_s"),
        F.sum(F.when(now, 0).otherwise(F.col("n") * F.col("n"))).alias("_q"),
    )
    mean = F.col("_s") / baseline_days
    spread = F.sqrt(F.greatest(F.col("_q") / baseline_days - mean * mean, F.lit(0.0)))
    z = (F.col("recent") / recent_days - mean) / F.greatest(spread, F.lit(floor))
    share = F.col("recent_negative") / F.col("recent")
    found = per.where(F.col("recent") >= least).withColumns({"mean_daily": mean, "z": z, "share": share}).where(F.col("z") >= z_least).withColumn("is_threat", F.col("share") >= threat_share)
    score = F.when(F.col("is_threat"), 10.0).otherwise(0.0) + F.col("z") * (0.5 + F.col("share")) * (1 + F.col("severe"))
    return found.select("entity_id", "slug", "recent", "recent_negative", "severe", F.round("mean_daily", 6).alias("mean_daily"), F.round("z", 6).alias("z"), "is_threat", F.round(score, 6).alias("score"))


def weekly(marks: DataFrame, last: DataFrame, weeks: int = 8) -> DataFrame:
    """(entity_id, slug, week_start, counts, favourability): weeks from Monday that end with the last one, absent weeks with zeros."""
    first = F.date_sub(F.date_trunc("week", F.col("as_of")).cast("date"), 7 * (weeks - 1))
    monday = F.date_trunc("week", F.col("day")).cast("date")
    placed = marks.crossJoin(F.broadcast(last)).where(monday >= first)
    counted = placed.groupBy("entity_id", "slug", monday.alias("week_start")).agg(*[count_of(k).alias(k) for k in ("positive", "negative", "mixed", "neutral")])
    spine = last.select(F.explode(F.sequence(first, F.date_trunc("week", F.col("as_of")).cast("date"), F.expr("interval 7 days"))).alias("week_start"))
    every = marks.select("entity_id", "slug").distinct().crossJoin(F.broadcast(spine))  # as many rows as weeks
    filled = every.join(counted, ["entity_id", "slug", "week_start"], "left").na.fill(0, ["positive", "negative", "mixed", "neutral"])
    return filled.withColumn("favourability", favourability(F.col("positive"), F.col("negative")))


def co_mentions(marks: DataFrame, edges: DataFrame, entities: DataFrame, limit: int = 6) -> DataFrame:
    """(slug, other_slug, n, rank): edges of other entities on the items that mention an entity, most first.

    Counts edges, not items. Edges are counted per (item, entity) before the join.
    """
    kept = entities.where("status <> 'candidate' and entity_type <> 'source'").select(F.col("id").alias("other_id"), F.col("slug").alias("other_slug"))
    per = edges.groupBy("raw_item_id", F.col("entity_id").alias("other_id")).agg(F.count("*").alias("c")).join(kept, "other_id")
    met = marks.select("raw_item_id", "entity_id", "slug").join(per, "raw_item_id").where("entity_id <> other_id")
    counted = met.groupBy("slug", "other_slug").agg(F.sum("c").alias("n"))
    at = Window.partitionBy("slug").orderBy(F.desc("n"), "other_slug")
    return counted.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= limit)
