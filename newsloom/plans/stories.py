"""Queries on stories, cards, projections and small derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import graph as g
from ..operators import stories as st
from ..operators.current import current_analyses, item_day, relevant, severity_rank, subject_portrayal
from .analyses import GATED, GRAPH_BEST, MOCK, PORTRAYAL, RANK
from .graph import MENTIONS
from .registry import Tables, query

STORY = """(SELECT content_hash, count(*) AS size, count(DISTINCT source_name) AS sources, (epoch(max(published_at)) - epoch(min(published_at))) / 3600.0::DOUBLE AS span_h, count(published_at) AS stamps,
 max(published_at) AS last, min(id) AS representative FROM raw_items GROUP BY 1)"""


@query(f"""SELECT content_hash, size, sources, representative, CASE WHEN size < 2 THEN 0.0 WHEN stamps < 2 THEN least(1.0, sources / 5.0) ELSE round(least(1.0, sources / 4.0::DOUBLE) * greatest(0.0, 1.0 - span_h / 72.0), 3) END::DOUBLE AS coordination FROM {STORY}""")
def mth1_coordination(t: Tables) -> DataFrame:
    """How closely together how many sources carry one content."""
    return st.story_stats(t.raw_items).select("content_hash", "size", "sources", "representative", "coordination")


@query(f"""WITH l AS (SELECT max(published_at) AS now FROM raw_items), c AS (SELECT content_hash, count(*) FILTER (published_at >= now - INTERVAL 3 DAY) AS recent, count(*) FILTER (published_at < now - INTERVAL 3 DAY AND published_at >= now - INTERVAL 7 DAY) AS early FROM raw_items CROSS JOIN l GROUP BY 1)
 SELECT content_hash, CASE WHEN recent + early < 2 THEN 'flat' WHEN recent > early THEN 'rising' WHEN recent < early THEN 'fading' ELSE 'steady' END AS momentum FROM c""")
def win18_theme_momentum(t: Tables) -> DataFrame:
    """The last three days against the four before, up to the last published item."""
    return st.momentum(t.raw_items)


@query(f"""SELECT content_hash, raw_item_id AS representative FROM (SELECT r.content_hash, r.id AS raw_item_id, CASE lower(b.government_relevance) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rel, coalesce(b.needs_human_review, FALSE) AS rev, coalesce(length(r.title), 0) AS len
 FROM raw_items r LEFT JOIN {GRAPH_BEST} b ON b.raw_item_id = r.id) QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY rel DESC, rev DESC, len DESC, raw_item_id) = 1""")
def win9_representatives(t: Tables) -> DataFrame:
    """The item that stands for a story: most relevant, then under review, then with the longest title, then first."""
    best = current_analyses(t.ai_analysis.select("id", "raw_item_id", "model_name", "created_at", "government_relevance", "needs_human_review"))
    items = t.raw_items.select("content_hash", F.col("id").alias("raw_item_id"), F.coalesce(F.length("title"), F.lit(0)).alias("len"))
    joined = items.join(best.drop("id"), "raw_item_id", "left")
    rel = F.lower("government_relevance")
    key = F.struct(F.when(rel == "high", 3).when(rel == "medium", 2).when(rel == "low", 1).otherwise(0).alias("rel"), F.coalesce("needs_human_review", F.lit(False)).alias("rev"), "len", (-F.col("raw_item_id")).alias("id"))
    return joined.groupBy("content_hash").agg(F.max(key).alias("k")).select("content_hash", (-F.col("k.id")).alias("representative"))


@query("""SELECT content_hash, source_name, rank::INTEGER AS rank FROM (SELECT content_hash, source_name, row_number() OVER (PARTITION BY content_hash ORDER BY min(id), source_name) AS rank FROM raw_items GROUP BY 1, 2)""")
def win19_story_sources(t: Tables) -> DataFrame:
    """The sources of a story in the order of their first items."""
    first = t.raw_items.groupBy("content_hash", "source_name").agg(F.min("id").alias("first"))
    at = Window.partitionBy("content_hash").orderBy("first", "source_name")
    return first.select("content_hash", "source_name", F.row_number().over(at).alias("rank"))


@query(f"""SELECT r.content_hash, count(*) AS size, count(DISTINCT r.source_name) AS sources, count(*) FILTER (p = 'positive') AS positive, count(*) FILTER (p = 'negative') AS negative, count(*) FILTER (p = 'mixed') AS mixed, count(*) FILTER (p = 'neutral') AS neutral
 FROM raw_items r LEFT JOIN (SELECT raw_item_id, {PORTRAYAL} AS p FROM {GRAPH_BEST}) b ON b.raw_item_id = r.id GROUP BY 1 HAVING count(*) > 1""")
def agg14_theme_stats(t: Tables) -> DataFrame:
    best = current_analyses(t.ai_analysis).select("raw_item_id", subject_portrayal().alias("p"))
    joined = t.raw_items.select(F.col("id").alias("raw_item_id"), "content_hash", "source_name").join(best, "raw_item_id", "left")
    kinds = [F.count_if(F.col("p") == k).alias(k) for k in ("positive", "negative", "mixed", "neutral")]
    return joined.groupBy("content_hash").agg(F.count("*").alias("size"), F.count_distinct("source_name").alias("sources"), *kinds).where("size > 1")


@query("""SELECT id AS analysis_id, array_to_string(list_slice(list_filter(list_transform(coalesce(positive_points, []), lambda p: trim(p)), lambda p: p <> ''), 1, 3), ' | ') AS shown FROM ai_analysis""")
def prj6_display_lists(t: Tables) -> DataFrame:
    points = F.filter(F.transform(F.coalesce("positive_points", F.array().cast("array<string>")), F.trim), lambda p: p != "")
    return t.ai_analysis.select(F.col("id").alias("analysis_id"), F.array_join(F.slice(points, 1, 3), " | ").alias("shown"))


@query("SELECT id AS analysis_id, coalesce(nullif(trim(summary_english), ''), nullif(trim(summary_original), ''), nullif(trim(public_issue), ''), topic) AS shown FROM ai_analysis")
def prj1_first_text(t: Tables) -> DataFrame:
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return t.ai_analysis.select(F.col("id").alias("analysis_id"), F.coalesce(filled("summary_english"), filled("summary_original"), filled("public_issue"), "topic").alias("shown"))


@query(f"""SELECT id AS analysis_id, {MOCK} = 1 AS stand_in, regexp_matches(lower(model_name), '^local-') AS is_local, {PORTRAYAL} AS portrayal, CASE WHEN people_issue AND {PORTRAYAL} = 'neutral' THEN 'people' ELSE {PORTRAYAL} END AS category FROM ai_analysis""")
def prj3_portrayal_and_category(t: Tables) -> DataFrame:
    p = subject_portrayal()
    return t.ai_analysis.select(
        F.col("id").alias("analysis_id"), F.lower("model_name").startswith("mock").alias("stand_in"), F.lower("model_name").rlike("^local-").alias("is_local"), p.alias("portrayal"),
        F.when(F.col("people_issue") & (p == "neutral"), "people").otherwise(p).alias("category"),
    )


@query("""SELECT id AS analysis_id, array_to_string(list_slice(l, 1, 10), ';') AS actors FROM (SELECT id, (SELECT list(a ORDER BY p) FROM (SELECT a, min(p) AS p FROM (SELECT unnest(political_actors) AS a, generate_subscripts(political_actors, 1) AS p) GROUP BY a)) AS l FROM ai_analysis WHERE len(political_actors) > 0)""")
def set4_distinct_actors(t: Tables) -> DataFrame:
    """The first ten different actors, in order."""
    return t.ai_analysis.where(F.size("political_actors") > 0).select(F.col("id").alias("analysis_id"), F.array_join(F.slice(F.array_distinct("political_actors"), 1, 10), ";").alias("actors"))


@query("SELECT DISTINCT field, value FROM (SELECT field, value FROM labeled_examples WHERE tier = 'gold' UNION ALL SELECT field, value FROM labeled_examples WHERE tier = 'bronze' AND value <> '<none>')")
def set5_label_universe(t: Tables) -> DataFrame:
    gold = t.labeled_examples.where("tier = 'gold'").select("field", "value")
    said = t.labeled_examples.where("tier = 'bronze' and value <> '<none>'").select("field", "value")
    return gold.union(said).distinct()


@query("SELECT source_type, count(*) AS items, count(DISTINCT source_name) AS sources, sum(length(clean_text_original))::BIGINT AS characters FROM raw_items GROUP BY 1")
def agg18_usage(t: Tables) -> DataFrame:
    return t.raw_items.groupBy("source_type").agg(F.count("*").alias("items"), F.count_distinct("source_name").alias("sources"), F.sum(F.length("clean_text_original").cast("long")).alias("characters"))


@query(f"SELECT slug, district, n FROM (SELECT slug, district, count(*) AS n, row_number() OVER (PARTITION BY slug ORDER BY count(*) DESC, district) AS r FROM {MENTIONS} WHERE district <> 'unknown' GROUP BY 1, 2) WHERE r <= 5")
def agg20_entity_districts(t: Tables) -> DataFrame:
    """The five districts that an entity's items name most."""
    counted = g.mentions(t).where("district <> 'unknown'").groupBy("slug", "district").agg(F.count("*").alias("n"))
    at = Window.partitionBy("slug").orderBy(F.desc("n"), "district")
    return counted.withColumn("r", F.row_number().over(at)).where("r <= 5").drop("r")


@query(f"SELECT slug, count(*) AS mentions, count(*) FILTER (portrayal = 'negative') AS negative FROM {MENTIONS} WHERE entity_type = 'district' GROUP BY 1 ORDER BY mentions DESC, slug LIMIT 8")
def agg21_district_leaders(t: Tables) -> DataFrame:
    marks = g.mentions(t).where("entity_type = 'district'")
    return marks.groupBy("slug").agg(F.count("*").alias("mentions"), g.count_of("negative").alias("negative")).orderBy(F.desc("mentions"), "slug").limit(8)


@query(f"SELECT strftime(max(day), '%Y-%m-%d') AS as_of, count(*) AS gated FROM {GATED}")
def dt4_as_of(t: Tables) -> DataFrame:
    return g.gated_items(t).agg(F.date_format(F.max("day"), "yyyy-MM-dd").alias("as_of"), F.count("*").alias("gated"))


QUESTION = "what did renomani nothulamani say about water in sosaakulam"


@query("SELECT entity_id, normalized, min(id) AS alias_id, CASE WHEN regexp_matches(normalized, '[\\x{0B80}-\\x{0BFF}]') THEN 'ta' ELSE 'other' END AS script FROM entity_aliases GROUP BY 1, 2")
def ent15_alias_registry(t: Tables) -> DataFrame:
    out = t.entity_aliases.groupBy("entity_id", "normalized").agg(F.min("id").alias("alias_id"))
    return out.withColumn("script", F.when(F.col("normalized").rlike(x.TAMIL), "ta").otherwise("other"))


@query("""SELECT r.id AS raw_item_id FROM raw_items r WHERE NOT EXISTS (SELECT 1 FROM ai_analysis a WHERE a.raw_item_id = r.id AND a.model_name = 'local-7b' AND a.prompt_version = 'v1')""")
def stm5_work_left(t: Tables) -> DataFrame:
    """Items that a model and prompt haven't seen."""
    done = t.ai_analysis.where("model_name = 'local-7b' and prompt_version = 'v1'").select(F.col("raw_item_id"))
    return t.raw_items.select(F.col("id").alias("raw_item_id")).join(done, "raw_item_id", "left_anti")


@query("""SELECT a.id AS analysis_id, a.needs_human_review OR coalesce(d.n, 0) > 0 AS in_review FROM ai_analysis a LEFT JOIN (SELECT analysis_id, count(*) AS n FROM review_decisions WHERE status = 'escalated' GROUP BY 1) d ON d.analysis_id = a.id""")
def lbl11_review_flags(t: Tables) -> DataFrame:
    """The flag with what reviewers escalated; setting it twice changes nothing."""
    sent = t.review_decisions.where("status = 'escalated'").select("analysis_id").distinct().withColumn("_sent", F.lit(True))
    joined = t.ai_analysis.select(F.col("id").alias("analysis_id"), "needs_human_review").join(sent, "analysis_id", "left")
    return joined.select("analysis_id", (F.col("needs_human_review") | F.coalesce("_sent", F.lit(False))).alias("in_review"))


@query("""SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stm6_events_by_day(t: Tables) -> DataFrame:
    """Late rows land in their own day on a recount."""
    return t.events.groupBy(F.date_format(F.window("ts", "1 day").start, "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query(f"SELECT a.id AS analysis_id, {RANK} AS severity_rank, r.title FROM ai_analysis a JOIN raw_items r ON r.id = a.raw_item_id WHERE a.people_issue AND {RANK} >= 3")
def jn1_people_issues(t: Tables) -> DataFrame:
    kept = t.ai_analysis.where(F.col("people_issue") & (severity_rank() >= 3)).select(F.col("id").alias("analysis_id"), "raw_item_id", severity_rank().alias("severity_rank"))
    return kept.join(t.raw_items.select(F.col("id").alias("raw_item_id"), "title"), "raw_item_id").select("analysis_id", "severity_rank", "title")
