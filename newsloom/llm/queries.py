"""The queries of the problems, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored, table
from . import garbled, langid, leakage, mainbody, neardup, packing, pieces, sitelines, splits, textform


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, sf_dir, t) for t in ("raw_items", "entities", "entity_aliases"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "raw_items")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("title", "clean_text_original")]))
    return items.select(F.col("id").alias("raw_item_id"), pairs.alias("f")).select("raw_item_id", "f.*")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = textform.to_consistent(_fields(spark, sf_dir), ["raw_item_id", "field_name"])
    return made.where("text <> text_new").select("raw_item_id", "field_name").distinct()


def p1_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title and text in consistent form."""
    fields = _fields(spark, sf_dir)
    made = textform.to_consistent(fields, ["raw_item_id", "field_name"]).select("raw_item_id", "field_name", F.col("text_new").alias("text"))
    return fields.where(F.col("text").isNull() | ~F.col("text").rlike(textform.suspect())).union(made)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, entities, aliases = _sources(spark, sf_dir)
    return splits.labelled_groups(items, table(spark, sf_dir, "labeled_examples"), entities, aliases)


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, entities, aliases = _sources(spark, sf_dir)
    return splits.assign_splits(items, table(spark, sf_dir, "labeled_examples"), entities, aliases)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.site_lines(*_sources(spark, sf_dir))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.without_site_lines(*_sources(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pieces.cut(table(spark, sf_dir, "raw_items"), "id", "clean_text_original")
    return made.where("piece_no = 2").select(F.col("id").alias("raw_item_id")).distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pieces.cut(table(spark, sf_dir, "raw_items"), "id", "clean_text_original")
    return made.withColumnRenamed("id", "raw_item_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _sources(spark, sf_dir)
    return langid.wrong_labels(sources[0], langid.item_languages(*sources, table(spark, sf_dir, "lang_samples")))


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of every text, and as segment 0 the languages of the item."""
    return langid.item_segments(*_sources(spark, sf_dir), table(spark, sf_dir, "lang_samples"))


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    items, entities, aliases = _sources(spark, sf_dir)
    return items.where(F.col("source_type").isin("news", "press_release")), entities, aliases, table(spark, sf_dir, "lang_samples")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainbody.body_lines(*_pages(spark, sf_dir))


def p6_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainbody.main_bodies(*_pages(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.pairs_of_groups(neardup.near_groups(*_sources(spark, sf_dir)))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(*_sources(spark, sf_dir))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(table(spark, sf_dir, "documents"))


def p8_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers each partition took, and fewer than how many it can't."""
    return packing.certificate(stored(packing.containers(table(spark, sf_dir, "documents")), "packed"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(*(table(spark, sf_dir, t) for t in ("documents", "eval_items", "lang_samples")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents with their restored texts."""
    return garbled.garbled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples")).withColumnRenamed("text_new", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_consistent, p2_found, p2_splits, p3_found, p3_clean, p4_found, p4_pieces, p5_found, p5_languages, p6_found, p6_bodies, p7_found, p7_groups, p8_containers, p8_certificate, p9_found, p10_found, p10_restored)}
def _fold(c: str) -> str:
    return f"nullif(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')), '')"


SQL: dict[str, str] = {
    "p2_found": f"""WITH RECURSIVE al AS (SELECT {_fold('alias')} AS name, min(entity_id) AS e FROM entity_aliases a JOIN entities n ON n.id = a.entity_id WHERE n.entity_type = 'source' GROUP BY 1),
 au AS (SELECT {_fold('alias')} AS name, min(entity_id) AS e FROM entity_aliases a JOIN entities n ON n.id = a.entity_id WHERE n.entity_type = 'person' AND n.role = 'journalist' GROUP BY 1),
 it AS (SELECT r.id, coalesce('e' || s.e, 'n' || {_fold('source_name')}) AS s, 'a' || u.e AS a FROM raw_items r LEFT JOIN al s ON s.name = {_fold('source_name')} LEFT JOIN au u ON u.name = {_fold("metadata_json['author']")}),
 ed AS (SELECT DISTINCT s AS x, a AS y FROM it WHERE a IS NOT NULL), bo AS (SELECT x, y FROM ed UNION SELECT y, x FROM ed),
 re AS (SELECT DISTINCT s AS node, s AS other FROM it UNION SELECT re.node, bo.y FROM re JOIN bo ON bo.x = re.other),
 lab AS (SELECT DISTINCT l.raw_item_id, it.s FROM labeled_examples l JOIN it ON it.id = l.raw_item_id),
 fi AS (SELECT re.node, min(lab.raw_item_id) AS f FROM re JOIN lab ON lab.s = re.other GROUP BY 1)
 SELECT lab.raw_item_id, fi.f AS group_first_id FROM lab JOIN fi ON fi.node = lab.s""",
    "p4_found": "SELECT id AS raw_item_id FROM raw_items WHERE length(clean_text_original) > 1200",
}
