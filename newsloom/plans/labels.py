"""Queries on labels: tiers, exports, scoring, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.current import best_row, current_analyses, policy
from ..operators.scoring import primary_metric, scores
from .analyses import TIER, best_tier
from .registry import Tables, query

FIELDS = {
    "government_relevance": "government_relevance", "tvk_portrayal": "tvk_portrayal", "sentiment": "sentiment", "district": "district",
    "department": "department", "issue_category": "issue_category", "severity": "severity",
}
LATEST = "(SELECT * FROM ai_analysis QUALIFY row_number() OVER (PARTITION BY raw_item_id ORDER BY id DESC) = 1)"
UNPIVOT = " UNION ALL ".join(f"SELECT raw_item_id, id AS analysis_id, '{f}' AS field, coalesce({c}, '<none>') AS value FROM l" for f, c in FIELDS.items())
BEST_TIER = f"(SELECT * FROM labeled_examples QUALIFY row_number() OVER (PARTITION BY raw_item_id, field ORDER BY {TIER} DESC, created_at DESC NULLS LAST, id DESC) = 1)"


def predictions(analyses: DataFrame) -> DataFrame:
    """(raw_item_id, analysis_id, field, value): the labels that analyses give, null as <none>."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(c), F.lit("<none>")).alias("value")) for f, c in FIELDS.items()])
    return analyses.select("raw_item_id", F.col("id").alias("analysis_id"), F.explode(pairs).alias("p")).select("raw_item_id", "analysis_id", "p.field", "p.value")


@query(f"WITH l AS {LATEST} {UNPIVOT}")
def lbl1_bronze(t: Tables) -> DataFrame:
    return predictions(current_analyses(t.ai_analysis, "latest_id"))


@query("""SELECT a.raw_item_id, c.field, c.value FROM (SELECT analysis_id, id, created_at, 'tvk_portrayal' AS field, corrected_stance AS value FROM review_decisions UNION ALL SELECT analysis_id, id, created_at, 'government_relevance', corrected_relevance FROM review_decisions) c
 JOIN ai_analysis a ON a.id = c.analysis_id WHERE c.value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a.raw_item_id, c.field ORDER BY c.created_at DESC NULLS LAST, c.id DESC) = 1""")
def lbl2_gold(t: Tables) -> DataFrame:
    """Corrections of reviewers as labels; the latest decision on an item and field holds."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in (("tvk_portrayal", "corrected_stance"), ("government_relevance", "corrected_relevance"))])
    made = t.review_decisions.select("analysis_id", "id", "created_at", F.explode(pairs).alias("p")).where("p.value is not null").select("analysis_id", "id", "created_at", "p.*")
    joined = made.join(t.ai_analysis.select(F.col("id").alias("analysis_id"), "raw_item_id"), "analysis_id")
    return best_row(joined, ["raw_item_id", "field"], policy("chat")).select("raw_item_id", "field", "value")


def _model(t: Tables, name: str) -> DataFrame:
    return current_analyses(t.ai_analysis.where(F.col("model_name") == name), "latest_id")


@query(f"""WITH s AS (SELECT * FROM ai_analysis WHERE model_name = 'local-7b' QUALIFY row_number() OVER (PARTITION BY raw_item_id ORDER BY id DESC) = 1),
 m AS (SELECT * FROM ai_analysis WHERE model_name = 'local-13b' QUALIFY row_number() OVER (PARTITION BY raw_item_id ORDER BY id DESC) = 1),
 a AS ({UNPIVOT.replace('FROM l', 'FROM s')}), b AS ({UNPIVOT.replace('FROM l', 'FROM m')}), c AS (SELECT id, confidence FROM s)
 SELECT a.raw_item_id, a.field, a.value, CASE WHEN b.value IS NULL THEN c.confidence >= 0.85 ELSE a.value = b.value END AS agreed FROM a JOIN c ON c.id = a.analysis_id LEFT JOIN b ON b.raw_item_id = a.raw_item_id AND b.field = a.field""")
def lbl3_silver(t: Tables) -> DataFrame:
    """Agreement of a model with its teacher; without one, confidence from 0.85."""
    student, teacher = _model(t, "local-7b"), _model(t, "local-13b")
    said = predictions(student).join(student.select(F.col("id").alias("analysis_id"), "confidence"), "analysis_id")
    other = predictions(teacher).select("raw_item_id", "field", F.col("value").alias("_t"))
    agreed = F.when(F.col("_t").isNull(), F.col("confidence") >= 0.85).otherwise(F.col("value") == F.col("_t"))
    return said.join(other, ["raw_item_id", "field"], "left").select("raw_item_id", "field", "value", agreed.alias("agreed"))


@query(f"""SELECT l.raw_item_id, l.field, l.value, l.tier, length(r.clean_text_original) AS n_chars FROM {BEST_TIER} l JOIN raw_items r ON r.id = l.raw_item_id WHERE l.tier IN ('gold','silver') AND NOT coalesce(l.split_bucket BETWEEN 0 AND 19, FALSE)""")
def lbl4_export(t: Tables) -> DataFrame:
    """Best labels outside the held-out buckets, with the length of their texts."""
    kept = best_tier(t.labeled_examples).where("tier in ('gold', 'silver') and not coalesce(split_bucket between 0 and 19, false)")
    texts = t.raw_items.select(F.col("id").alias("raw_item_id"), F.length("clean_text_original").cast("long").alias("n_chars"))
    return kept.join(texts, "raw_item_id").select("raw_item_id", "field", "value", "tier", "n_chars")


@query("SELECT id AS label_id, raw_item_id, field FROM labeled_examples WHERE tier = 'gold' AND split_bucket BETWEEN 0 AND 19")
def lbl5_gold_test(t: Tables) -> DataFrame:
    return t.labeled_examples.where("tier = 'gold' and split_bucket between 0 and 19").select(F.col("id").alias("label_id"), "raw_item_id", "field")


SCORED = f"""g AS (SELECT raw_item_id, field, value AS gold FROM labeled_examples WHERE tier = 'gold' QUALIFY row_number() OVER (PARTITION BY raw_item_id, field ORDER BY created_at DESC NULLS LAST, id DESC) = 1),
 l AS {LATEST}, p AS ({UNPIVOT}), j AS (SELECT g.*, coalesce(p.value, '<none>') AS pred FROM g LEFT JOIN p ON p.raw_item_id = g.raw_item_id AND p.field = g.field),
 k AS (SELECT field, gold AS class, count(*) AS support, count(*) FILTER (gold = pred) AS tp FROM j GROUP BY 1, 2), q AS (SELECT field, pred AS class, count(*) AS said FROM j GROUP BY 1, 2),
 c AS (SELECT k.field, k.class, support, tp, coalesce(said, 0) AS said, tp / support::DOUBLE AS r, coalesce(tp / nullif(said, 0)::DOUBLE, 0) AS p FROM k LEFT JOIN q ON q.field = k.field AND q.class = k.class),
 f AS (SELECT field, sum(support)::BIGINT AS support, sum(tp) / sum(support)::DOUBLE AS accuracy, avg(p) AS macro_p, avg(r) AS macro_r, avg(coalesce(2 * p * r / nullif(p + r, 0), 0)) AS macro_f1 FROM c GROUP BY 1)"""


def _gold_against_latest(t: Tables) -> DataFrame:
    gold = best_row(t.labeled_examples.where("tier = 'gold'"), ["raw_item_id", "field"], policy("chat")).select("raw_item_id", "field", F.col("value").alias("gold"))
    said = predictions(current_analyses(t.ai_analysis, "latest_id")).select("raw_item_id", "field", F.col("value").alias("predicted"))
    return scores(gold, said)


@query(f"WITH {SCORED} SELECT field, support, round(accuracy, 6) AS accuracy, round(macro_p, 6) AS macro_p, round(macro_r, 6) AS macro_r, round(macro_f1, 6) AS macro_f1 FROM f")
def agg16_macro_f1(t: Tables) -> DataFrame:
    out = _gold_against_latest(t)
    return out.select("field", "support", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_p", "macro_r", "macro_f1")])


@query(f"WITH {SCORED} SELECT round(avg(macro_f1), 6) AS metric FROM f")
def agg17_primary_metric(t: Tables) -> DataFrame:
    return primary_metric(_gold_against_latest(t)).select(F.round("metric", 6).alias("metric"))


@query("SELECT field, count(*) AS n, count(DISTINCT value) AS vals FROM labeled_examples GROUP BY 1")
def agg22_label_counts(t: Tables) -> DataFrame:
    return t.labeled_examples.groupBy("field").agg(F.count("*").alias("n"), F.count_distinct("value").alias("vals"))


PIVOT = f"(SELECT raw_item_id, string_agg(field || '=' || value, ';' ORDER BY field) AS labels FROM {BEST_TIER} GROUP BY 1)"


@query(f"SELECT raw_item_id, labels FROM {PIVOT}")
def agg24_dataset_rows(t: Tables) -> DataFrame:
    """One row per item with its labels in the order of their fields."""
    pairs = F.sort_array(F.collect_list(F.struct("field", "value")))
    return best_tier(t.labeled_examples).groupBy("raw_item_id").agg(F.array_join(F.transform(pairs, lambda s: F.concat(s["field"], F.lit("="), s["value"])), ";").alias("labels"))


@query(f"SELECT part, count(*) AS items, substr(sha256(string_agg(h, '' ORDER BY raw_item_id)), 1, 12) AS fingerprint FROM (SELECT raw_item_id, raw_item_id // 1000000 AS part, sha256(raw_item_id || ':' || labels) AS h FROM {PIVOT}) GROUP BY 1")
def agg25_fingerprint(t: Tables) -> DataFrame:
    """A fingerprint of the labelled set for each million of ids, so that no task gets more than a million hashes."""
    rows = agg24_dataset_rows(t).select("raw_item_id", F.floor(F.col("raw_item_id") / 1_000_000).alias("part"), F.sha2(F.concat_ws(":", F.col("raw_item_id").cast("string"), "labels"), 256).alias("h"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("raw_item_id", "h"))), lambda s: s["h"]), "")
    return rows.groupBy("part").agg(F.count("*").alias("items"), F.substring(F.sha2(joined, 256), 1, 12).alias("fingerprint"))


@query("SELECT id AS label_id, CAST(CAST('0x' || substr(sha256(raw_item_id || ':' || field), 1, 8) AS BIGINT) % 100 AS INTEGER) AS bucket FROM labeled_examples")
def hsh2_split_buckets(t: Tables) -> DataFrame:
    digest = F.sha2(F.concat_ws(":", F.col("raw_item_id").cast("string"), "field"), 256)
    return t.labeled_examples.select(F.col("id").alias("label_id"), (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100).cast("int").alias("bucket"))


@query("""SELECT model_name, count(*) AS analyses, count(DISTINCT raw_item_id) AS items, strftime(max(created_at)::TIMESTAMP, '%Y-%m-%d') AS last_day, arg_max(prompt_version, id) AS prompt FROM ai_analysis GROUP BY 1""")
def lbl8_model_health(t: Tables) -> DataFrame:
    return t.ai_analysis.groupBy("model_name").agg(
        F.count("*").alias("analyses"), F.count_distinct("raw_item_id").alias("items"), F.date_format(F.max("created_at"), "yyyy-MM-dd").alias("last_day"), F.max_by("prompt_version", "id").alias("prompt")
    )


