"""Queries on analyses, reviews and labels: current rows, counts, rollups, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.current import best_row, current_analyses, policy, relevant, severity_rank, subject_portrayal
from .registry import Tables, query

MOCK = "CASE WHEN lower(coalesce(model_name,'')) LIKE 'mock%' THEN 1 ELSE 0 END"
RANK = "CASE lower(coalesce(severity,'')) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
PORTRAYAL = """CASE WHEN lower(tvk_portrayal) IN ('positive','negative','mixed','neutral') THEN lower(tvk_portrayal)
 WHEN lower(stance_toward_government) IN ('positive','negative','mixed','neutral') THEN lower(stance_toward_government) ELSE 'neutral' END"""
GATE = "lower(coalesce(government_relevance,'')) <> 'none'"


def best(order: str) -> str:
    return f"(SELECT * FROM ai_analysis QUALIFY row_number() OVER (PARTITION BY raw_item_id ORDER BY {order}) = 1)"


KPI_BEST = best(f"{MOCK}, created_at DESC NULLS LAST, id")
GRAPH_BEST = best(f"{MOCK}, created_at DESC NULLS LAST, id DESC")


@query(f"SELECT raw_item_id, id AS analysis_id, model_name FROM {KPI_BEST}")
def win1_current_kpi(t: Tables) -> DataFrame:
    return current_analyses(t.ai_analysis, "kpi").select("raw_item_id", F.col("id").alias("analysis_id"), "model_name")


@query(f"SELECT raw_item_id, id AS analysis_id, model_name FROM {GRAPH_BEST}")
def win2_current_graph(t: Tables) -> DataFrame:
    return current_analyses(t.ai_analysis).select("raw_item_id", F.col("id").alias("analysis_id"), "model_name")


@query(f"SELECT r.id AS raw_item_id, b.id AS analysis_id FROM {GRAPH_BEST} b JOIN raw_items r ON r.id = b.raw_item_id WHERE r.source_type = 'news'")
def win3_current_cluster(t: Tables) -> DataFrame:
    news = t.raw_items.where("source_type = 'news'").select(F.col("id").alias("raw_item_id"))
    return current_analyses(t.ai_analysis).join(news, "raw_item_id").select("raw_item_id", F.col("id").alias("analysis_id"))


@query("SELECT raw_item_id, max(id) AS analysis_id FROM ai_analysis GROUP BY 1")
def win4_latest_id(t: Tables) -> DataFrame:
    return t.ai_analysis.groupBy("raw_item_id").agg(F.max("id").alias("analysis_id"))


@query(f"""SELECT raw_item_id, id AS analysis_id FROM (
 SELECT a.id, a.raw_item_id, a.created_at FROM ai_analysis a JOIN raw_items r ON r.id = a.raw_item_id
 WHERE r.source_type = 'news' AND {GATE} ORDER BY a.created_at DESC NULLS LAST, a.id DESC LIMIT 1000)
 QUALIFY row_number() OVER (PARTITION BY raw_item_id ORDER BY created_at DESC NULLS LAST, id DESC) = 1""")
def win6_chat_candidates(t: Tables) -> DataFrame:
    """The newest 1,000 joined rows, of which each item keeps its newest: the limit comes first."""
    news = t.raw_items.where("source_type = 'news'").select(F.col("id").alias("raw_item_id"))
    newest = t.ai_analysis.where(relevant()).join(news, "raw_item_id").select("id", "raw_item_id", "created_at").orderBy(*policy("chat")).limit(1000)
    return best_row(newest, ["raw_item_id"], policy("chat")).select("raw_item_id", F.col("id").alias("analysis_id"))


@query("SELECT analysis_id, id AS decision_id, status FROM review_decisions QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY created_at DESC NULLS LAST, id DESC) = 1")
def win7_latest_decision(t: Tables) -> DataFrame:
    return best_row(t.review_decisions, ["analysis_id"], policy("chat")).select("analysis_id", F.col("id").alias("decision_id"), "status")


@query("""SELECT a.raw_item_id, d.id AS decision_id, d.corrected_stance FROM review_decisions d JOIN ai_analysis a ON a.id = d.analysis_id
 WHERE coalesce(trim(d.corrected_stance),'') <> '' QUALIFY row_number() OVER (PARTITION BY a.raw_item_id ORDER BY d.created_at DESC NULLS LAST, d.id DESC) = 1""")
def win8_stance_override(t: Tables) -> DataFrame:
    made = t.review_decisions.where("coalesce(trim(corrected_stance), '') <> ''").select("id", "analysis_id", "corrected_stance", "created_at")
    joined = made.join(t.ai_analysis.select(F.col("id").alias("analysis_id"), "raw_item_id"), "analysis_id")
    return best_row(joined, ["raw_item_id"], policy("chat")).select("raw_item_id", F.col("id").alias("decision_id"), "corrected_stance")


TIER = "CASE tier WHEN 'gold' THEN 3 WHEN 'silver' THEN 2 WHEN 'bronze' THEN 1 ELSE 0 END"


def best_tier(labels: DataFrame) -> DataFrame:
    rank = F.when(F.col("tier") == "gold", 3).when(F.col("tier") == "silver", 2).when(F.col("tier") == "bronze", 1).otherwise(0)
    return best_row(labels.withColumn("_tier", rank), ["raw_item_id", "field"], [F.desc("_tier"), F.col("created_at").desc_nulls_last(), F.desc("id")]).drop("_tier")


@query(f"SELECT raw_item_id, field, value, tier FROM labeled_examples QUALIFY row_number() OVER (PARTITION BY raw_item_id, field ORDER BY {TIER} DESC, created_at DESC NULLS LAST, id DESC) = 1")
def win10_best_tier(t: Tables) -> DataFrame:
    return best_tier(t.labeled_examples).select("raw_item_id", "field", "value", "tier")


@query("SELECT normalized, entity_id, id AS alias_id FROM entity_aliases QUALIFY row_number() OVER (PARTITION BY normalized ORDER BY entity_id, id) = 1")
def win13_first_alias(t: Tables) -> DataFrame:
    return best_row(t.entity_aliases, ["normalized"], [F.asc("entity_id"), F.asc("id")]).select("normalized", "entity_id", F.col("id").alias("alias_id"))


@query("SELECT DISTINCT entity_id, raw_item_id FROM item_entities")
def win14_mention_pairs(t: Tables) -> DataFrame:
    return t.item_entities.select("entity_id", "raw_item_id").distinct()


@query(f"""WITH b AS {KPI_BEST}, g AS (SELECT *, {PORTRAYAL} AS portrayal FROM b WHERE {GATE})
 SELECT (SELECT count(*) FROM raw_items) AS items, (SELECT count(DISTINCT source_name) FROM raw_items) AS sources, (SELECT count(*) FROM ai_analysis) AS analyses,
 (SELECT count(*) FROM ai_analysis WHERE needs_human_review) AS pending_review, (SELECT count(*) FROM ai_analysis WHERE {MOCK} = 1) AS mock_analyses,
 (SELECT count(*) FROM review_decisions) AS decisions, count(*) AS relevant_items,
 count(*) FILTER (portrayal = 'positive') AS positive, count(*) FILTER (portrayal = 'negative') AS negative,
 count(*) FILTER (portrayal = 'mixed') AS mixed, count(*) FILTER (portrayal = 'neutral') AS neutral,
 count(*) FILTER (lower(severity) IN ('high','critical')) AS severe, count(DISTINCT district) AS districts, count(DISTINCT department) AS departments FROM g""")
def agg1_summary(t: Tables) -> DataFrame:
    """Totals over all rows, portrayals over current rows behind the gate; one row from few scans of narrow columns."""
    items = t.raw_items.agg(F.count("*").alias("items"), F.count_distinct("source_name").alias("sources"))
    runs = t.ai_analysis.agg(F.count("*").alias("analyses"), F.count_if("needs_human_review").alias("pending_review"), F.count_if(F.lower("model_name").startswith("mock")).alias("mock_analyses"))
    decisions = t.review_decisions.agg(F.count("*").alias("decisions"))
    narrow = t.ai_analysis.select("id", "raw_item_id", "model_name", "created_at", "government_relevance", "tvk_portrayal", "stance_toward_government", "severity", "district", "department")
    gated = current_analyses(narrow, "kpi").where(relevant()).withColumn("portrayal", subject_portrayal())
    kinds = [F.count_if(F.col("portrayal") == k).alias(k) for k in ("positive", "negative", "mixed", "neutral")]
    now = gated.agg(F.count("*").alias("relevant_items"), *kinds, F.count_if(F.lower("severity").isin("high", "critical")).alias("severe"), F.count_distinct("district").alias("districts"), F.count_distinct("department").alias("departments"))
    return items.crossJoin(runs).crossJoin(decisions).crossJoin(now)  # one row each


@query("SELECT topic, count(*) AS n FROM ai_analysis WHERE coalesce(topic,'') <> '' GROUP BY 1")
def agg2_value_counts(t: Tables) -> DataFrame:
    return t.ai_analysis.where("coalesce(topic, '') <> ''").groupBy("topic").agg(F.count("*").alias("n"))


@query("SELECT source_name, count(*) AS n FROM raw_items GROUP BY 1 ORDER BY n DESC, source_name LIMIT 8")
def agg3_top_sources(t: Tables) -> DataFrame:
    return t.raw_items.groupBy("source_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_name").limit(8)


LABEL = "CASE WHEN lower(trim(coalesce(issue_category,''))) IN ('','unspecified','unknown','none','n/a') THEN 'Unclassified' WHEN lower(trim(issue_category)) = 'general' THEN 'General' ELSE trim(issue_category) END"


@query(f"""SELECT {LABEL} AS label, count(*) AS total, count(*) FILTER (p = 'positive') AS positive, count(*) FILTER (p = 'negative') AS negative,
 count(*) FILTER (p = 'mixed') AS mixed, count(*) FILTER (p = 'neutral') AS neutral FROM (SELECT *, {PORTRAYAL} AS p FROM {KPI_BEST} WHERE {GATE}) GROUP BY 1 ORDER BY total DESC, label LIMIT 6""")
def agg4_category_breakdown(t: Tables) -> DataFrame:
    low = F.lower(F.trim(F.coalesce("issue_category", F.lit(""))))
    label = F.when(low.isin("", "unspecified", "unknown", "none", "n/a"), "Unclassified").when(low == "general", "General").otherwise(F.trim("issue_category"))
    gated = current_analyses(t.ai_analysis, "kpi").where(relevant()).select(label.alias("label"), subject_portrayal().alias("p"))
    kinds = [F.count_if(F.col("p") == k).alias(k) for k in ("positive", "negative", "mixed", "neutral")]
    return gated.groupBy("label").agg(F.count("*").alias("total"), *kinds).orderBy(F.desc("total"), "label").limit(6)


DAY = "coalesce(CAST(coalesce(r.published_at, r.ingested_at, b.created_at) AS DATE), DATE '1970-01-01')"
GATED = f"(SELECT b.id AS analysis_id, b.raw_item_id, {DAY} AS day, {PORTRAYAL} AS portrayal, {RANK} AS severity_rank, b.district, b.department, b.needs_human_review, b.people_issue, r.source_name, r.source_type FROM {GRAPH_BEST} b JOIN raw_items r ON r.id = b.raw_item_id WHERE {GATE})"


@query(f"""WITH g AS {GATED}, s AS (SELECT unnest(generate_series(max(day) - INTERVAL 13 DAY, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM g)
 SELECT strftime(s.day, '%Y-%m-%d') AS day, count(g.day) FILTER (portrayal = 'positive') AS positive, count(g.day) FILTER (portrayal = 'negative') AS negative,
 count(g.day) FILTER (portrayal = 'mixed') AS mixed, count(g.day) FILTER (portrayal = 'neutral') AS neutral, count(g.day) AS total
 FROM s LEFT JOIN g ON g.day = s.day GROUP BY 1""")
def agg5_daily_series(t: Tables) -> DataFrame:
    from ..operators.graph import as_of, gated_items

    gated = gated_items(t)
    kinds = ("positive", "negative", "mixed", "neutral")
    counted = gated.groupBy("day").agg(*[F.count_if(F.col("portrayal") == k).alias(k) for k in kinds], F.count("*").alias("total"))
    spine = as_of(gated).select(F.explode(F.sequence(F.date_sub("as_of", 13), "as_of")).alias("day"))
    return F.broadcast(spine).join(counted, "day", "left").na.fill(0).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""SELECT strftime(CAST(coalesce(r.published_at, r.ingested_at) AS DATE), '%Y-%m-%d') AS day, count(*) AS analyses, count(*) FILTER (stance_toward_government = 'positive') AS positive,
 count(*) FILTER (stance_toward_government = 'negative') AS negative, count(*) FILTER (needs_human_review) AS review FROM ai_analysis a JOIN raw_items r ON r.id = a.raw_item_id GROUP BY 1""")
def agg13_daily_report(t: Tables) -> DataFrame:
    """Counts of all analyses, not only the current ones."""
    items = t.raw_items.select(F.col("id").alias("raw_item_id"), F.date_format(F.coalesce("published_at", "ingested_at"), "yyyy-MM-dd").alias("day"))
    joined = t.ai_analysis.select("raw_item_id", "stance_toward_government", "needs_human_review").join(items, "raw_item_id")
    stance = F.col("stance_toward_government")
    return joined.groupBy("day").agg(F.count("*").alias("analyses"), F.count_if(stance == "positive").alias("positive"), F.count_if(stance == "negative").alias("negative"), F.count_if("needs_human_review").alias("review"))


@query("""SELECT CASE WHEN grouping(tier) = 0 THEN 'tier' WHEN grouping(field) = 0 THEN 'field' WHEN grouping(provenance) = 0 THEN 'provenance' ELSE 'all' END AS dim,
 coalesce(tier, field, provenance, 'all') AS value, count(*) AS n FROM labeled_examples GROUP BY GROUPING SETS ((tier), (field), (provenance), ())""")
def agg15_label_tallies(t: Tables) -> DataFrame:
    t.labeled_examples.createOrReplaceTempView("_newsloom_labels")
    return t.labeled_examples.sparkSession.sql(
        """SELECT CASE WHEN grouping(tier) = 0 THEN 'tier' WHEN grouping(field) = 0 THEN 'field' WHEN grouping(provenance) = 0 THEN 'provenance' ELSE 'all' END AS dim,
        coalesce(tier, field, provenance, 'all') AS value, count(*) AS n FROM _newsloom_labels GROUP BY GROUPING SETS ((tier), (field), (provenance), ())"""
    )


@query(f"""SELECT a.id AS analysis_id, {RANK} AS severity_rank, a.confidence FROM (SELECT * FROM ai_analysis WHERE needs_human_review ORDER BY {RANK} DESC, confidence, created_at DESC, id DESC LIMIT 50) a
 WHERE NOT EXISTS (SELECT 1 FROM review_decisions d WHERE d.analysis_id = a.id)""")
def srt1_review_queue(t: Tables) -> DataFrame:
    """The queue's limit comes before reviewed rows are dropped, so fewer than 50 may come out."""
    first = t.ai_analysis.where("needs_human_review").select(F.col("id").alias("analysis_id"), severity_rank().alias("severity_rank"), "confidence", "created_at")
    first = first.orderBy(F.desc("severity_rank"), "confidence", F.desc("created_at"), F.desc("analysis_id")).limit(50)
    return first.join(t.review_decisions.select("analysis_id"), "analysis_id", "left_anti").select("analysis_id", "severity_rank", "confidence")


@query(f"""SELECT raw_item_id, severity_rank FROM {GATED} WHERE portrayal = 'negative' ORDER BY severity_rank DESC, needs_human_review, day DESC, raw_item_id DESC LIMIT 8""")
def srt10_home_risks(t: Tables) -> DataFrame:
    from ..operators.graph import gated_items

    return gated_items(t).where("portrayal = 'negative'").orderBy(F.desc("severity_rank"), "needs_human_review", F.desc("day"), F.desc("raw_item_id")).limit(8).select("raw_item_id", "severity_rank")


@query("SELECT id AS raw_item_id, source_name FROM raw_items ORDER BY ingested_at DESC, id DESC LIMIT 200")
def srt13_recent_items(t: Tables) -> DataFrame:
    return t.raw_items.select(F.col("id").alias("raw_item_id"), "source_name", "ingested_at").orderBy(F.desc("ingested_at"), F.desc("raw_item_id")).limit(200).drop("ingested_at")


@query("""SELECT a.id AS analysis_id FROM ai_analysis a WHERE lower(severity) IN ('high','critical') OR needs_human_review OR raw_item_id IN (SELECT DISTINCT raw_item_id FROM labeled_examples WHERE tier = 'gold')""")
def flt6_high_value(t: Tables) -> DataFrame:
    gold = t.labeled_examples.where("tier = 'gold'").select("raw_item_id").distinct().withColumn("_gold", F.lit(True))
    joined = t.ai_analysis.select("id", "raw_item_id", "severity", "needs_human_review").join(gold, "raw_item_id", "left")
    return joined.where("lower(severity) in ('high', 'critical') or needs_human_review or _gold").select(F.col("id").alias("analysis_id"))


@query(f"""SELECT count(*) AS rows_before, count(*) FILTER (prompt_version = 'v1') AS rows_kept,
 count(DISTINCT raw_item_id) FILTER (raw_item_id NOT IN (SELECT raw_item_id FROM ai_analysis WHERE prompt_version = 'v1')) AS orphans FROM ai_analysis""")
def set7_prune_plan(t: Tables) -> DataFrame:
    """What a prune to one prompt version would leave, and the items it would leave without analysis."""
    per = t.ai_analysis.groupBy("raw_item_id").agg(F.count("*").alias("n"), F.count_if(F.col("prompt_version") == "v1").alias("kept"))
    return per.agg(F.sum("n").alias("rows_before"), F.sum("kept").alias("rows_kept"), F.count_if(F.col("kept") == 0).alias("orphans"))


@query("SELECT DISTINCT a.raw_item_id FROM ai_analysis a WHERE NOT EXISTS (SELECT 1 FROM item_entities e WHERE e.raw_item_id = a.raw_item_id)")
def jn8_unresolved_items(t: Tables) -> DataFrame:
    return t.ai_analysis.select("raw_item_id").join(t.item_entities.select("raw_item_id"), "raw_item_id", "left_anti").distinct()


@query("SELECT content_hash, min(id) AS first_id, count(*) AS copies FROM raw_items GROUP BY 1")
def set3_content_dedupe(t: Tables) -> DataFrame:
    return t.raw_items.groupBy("content_hash").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
