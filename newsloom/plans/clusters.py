"""Queries on story clusters of the news and the cards built on them. Their SQL would need the pass in order, so they are tested against it on small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cards as cd
from ..operators import clusters as cl
from ..operators import places as pl
from ..operators import stories as st
from ..operators.current import current_analyses, relevant, subject_portrayal
from ..session import stored
from .registry import Tables, query

_made: dict[tuple, DataFrame] = {}


def news(t: Tables) -> DataFrame:
    return t.raw_items.where("source_type = 'news'").select("id", F.unix_micros("ingested_at").alias("ord"), F.col("clean_text_original").alias("text"))


def kept(t: Tables, name: str, make) -> DataFrame:  # noqa: ANN001
    """A table that several queries of a session read; made once for an input."""
    at = (t.raw_items.sparkSession.sparkContext.applicationId, t.place, name)
    if at not in _made:
        _made[at] = stored(make(), name)
    return _made[at]


def leads(t: Tables) -> DataFrame:
    return kept(t, "leads", lambda: cl.lead_vectors(news(t)))


def briefing_clusters(t: Tables) -> DataFrame:
    return kept(t, "briefing", lambda: cl.clusters_of(leads(t)))


def theme_clusters(t: Tables) -> DataFrame:
    return kept(t, "themes", lambda: cl.clusters_of(leads(t), cl.THEMES, "first"))


def members(t: Tables, clusters: DataFrame) -> DataFrame:
    """The items of clusters with what their current analyses say; items without one have nulls and are neutral."""
    items = t.raw_items.where("source_type = 'news'").select("id", "title", "source_name", "published_at", "ingested_at", F.unix_micros("ingested_at").alias("ord"))
    names = ("id", "raw_item_id", "model_name", "created_at", "government_relevance", "tvk_portrayal", "stance_toward_government", "people_issue", "public_issue", "severity", "action_priority", "needs_human_review", "department", "district", "summary_english")
    best = current_analyses(t.ai_analysis.select(*names)).withColumn("portrayal", subject_portrayal()).drop("created_at", "model_name")
    said = best.select(F.col("raw_item_id").alias("id"), F.col("id").alias("analysis_id"), "government_relevance", "portrayal", "people_issue", "public_issue", "severity", "action_priority", "needs_human_review", "department", "district", F.col("summary_english").alias("summary"))
    return items.join(clusters, "id").join(said, "id", "left").withColumn("portrayal", F.coalesce("portrayal", F.lit("neutral")))


def story_cards(t: Tables) -> DataFrame:
    from .analyses import win8_stance_override

    def make() -> DataFrame:
        overrides = win8_stance_override(t).select(F.col("raw_item_id").alias("id"), F.col("corrected_stance").alias("corrected"))
        made = cl.cards(members(t, briefing_clusters(t)), overrides)
        known = pl.district_aliases(t.entities, t.entity_aliases)
        return pl.canonical_districts(made, "district", known).withColumn("department_canonical", pl.canonical_department(F.col("department")))

    return kept(t, "cards", make)


@query()
def clu2_story_clusters(t: Tables) -> DataFrame:
    """Every news item with its cluster, over all days."""
    sizes = briefing_clusters(t).groupBy("cluster_id").agg(F.count("*").alias("size"))
    return briefing_clusters(t).join(sizes, "cluster_id").select(F.col("id").alias("raw_item_id"), "cluster_id", "size")


@query()
def clu1_theme_clusters(t: Tables) -> DataFrame:
    """Themes: clusters by first fit with two items and more."""
    sizes = theme_clusters(t).groupBy("cluster_id").agg(F.count("*").alias("size")).where("size >= 2")
    return theme_clusters(t).join(sizes, "cluster_id").select(F.col("id").alias("raw_item_id"), "cluster_id", "size")


@query()
def clu3_cards(t: Tables) -> DataFrame:
    """A card for each story of relevance."""
    return story_cards(t).select("cluster_id", "raw_item_id", "analysis_id", "size", "sources", "portrayal", "category", "people_issue", "district_canonical", "department_canonical", "title")


@query()
def clu5_cluster_times(t: Tables) -> DataFrame:
    return cl.cluster_stats(members(t, briefing_clusters(t))).select("cluster_id", "size", "latest_ingested", "latest_published", "positive", "negative", "mixed", "neutral")


@query()
def srt2_clusters_in_order(t: Tables) -> DataFrame:
    """Stories as a briefing shows them, most sources first: 200 of them."""
    m = members(t, briefing_clusters(t))
    return cl.in_order(cl.cluster_stats(m).join(cl.representatives(m), "cluster_id"), cl.BRIEFING_ORDER, 200).select("cluster_id", "representative", "sources", "size", "latest_ingested")


@query()
def srt3_themes_in_order(t: Tables) -> DataFrame:
    """Themes, the largest first: 50 of them."""
    m = members(t, theme_clusters(t))
    return cl.in_order(cl.cluster_stats(m).where("size >= 2").join(cl.representatives(m), "cluster_id"), cl.THEME_ORDER, 50).select("cluster_id", "representative", "size", "sources", "latest_published")


@query()
def prj10_themes(t: Tables) -> DataFrame:
    """Themes with their sources and members, sorted."""
    return cl.cluster_stats(members(t, theme_clusters(t))).where("size >= 2").select("cluster_id", "size", F.array_join("source_names", "; ").alias("source_names"), F.array_join("member_ids", ";").alias("member_ids"))


@query()
def agg14_theme_breakdown(t: Tables) -> DataFrame:
    return cl.cluster_stats(members(t, theme_clusters(t))).where("size >= 2").select("cluster_id", "size", "sources", "dominant", "positive", "negative", "mixed", "neutral", "latest_published")


@query()
def win9_cluster_representatives(t: Tables) -> DataFrame:
    return cl.representatives(members(t, briefing_clusters(t)))


@query()
def win18_cluster_momentum(t: Tables) -> DataFrame:
    return st.momentum(members(t, theme_clusters(t)), "cluster_id")


@query()
def win19_cluster_sources(t: Tables) -> DataFrame:
    """The sources of a story, each once, in the order of its members."""
    first = members(t, briefing_clusters(t)).groupBy("cluster_id", "source_name").agg(F.max(F.struct("ord", "id")).alias("f"))
    at = Window.partitionBy("cluster_id").orderBy(F.desc("f"), "source_name")
    return first.select("cluster_id", "source_name", F.row_number().over(at).alias("rank"))


@query()
def mth1_cluster_coordination(t: Tables) -> DataFrame:
    return st.story_stats(members(t, theme_clusters(t)), "cluster_id").select("cluster_id", "size", "sources", "coordination", (F.col("coordination") >= 0.6).alias("coordinated"))


@query()
def set2_stories_and_single_items(t: Tables) -> DataFrame:
    """Clusters, and items without words as stories of their own; which of the two each is."""
    empty = leads(t).where(F.size("buckets") == 0).select("id")
    alone = empty.select(F.col("id").alias("cluster_id"), F.lit("without_vector").alias("kind"))
    rest = briefing_clusters(t).join(empty, "id", "left_anti").select("cluster_id", F.lit("cluster").alias("kind")).distinct()
    return rest.unionByName(alone)


@query()
def agg6_card_counts(t: Tables) -> DataFrame:
    """Counts of story cards by category, adding up to their number."""
    return story_cards(t).agg(F.count("*").alias("briefing_total"), *pl.by_category())


@query()
def srt4_card_alerts(t: Tables) -> DataFrame:
    return cd.alerts(story_cards(t), 5).select("raw_item_id", "cluster_id", "category", "urgency")


@query()
def flt10_briefing_groups(t: Tables) -> DataFrame:
    """The groups of a briefing: positive, of concern, and the first cards."""
    return cd.briefing_groups(story_cards(t).withColumn("ord", F.struct(-F.col("sources"), -F.col("size"))))


@query()
def agg7_card_districts(t: Tables) -> DataFrame:
    districts = t.entities.where("entity_type = 'district'").select(F.col("canonical_name").alias("district")).distinct()
    return pl.district_rollup(story_cards(t), districts)


__all__ = ["briefing_clusters", "members", "relevant", "story_cards", "theme_clusters"]
