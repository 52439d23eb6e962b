"""Entities kept in step with what items mention: seeds, aliases, candidates, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import surface_key
from ..session import small
from .current import best_row, current_analyses

#: Names that stand for nobody, in the form of keys.
GENERIC = ("", "unknown", "none", "n/a", "na", "null", "nil", "unspecified", "not specified", "general", "government", "state government", "public", "others", "various")
FIELDS = ("source", "political_actors", "district", "department", "scheme")
TYPES = {"source": "source", "political_actors": "person", "district": "district", "department": "department", "scheme": "scheme"}
VERSION = "resolver-v2"


def key_slug(key: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(key, r"[^\p{L}\p{M}\p{N}]+", "-"), "^-+|-+$", "")


def with_keys(rows: DataFrame, column: str = "surface") -> DataFrame:
    """Adds `key`, made once for each different name."""
    names = rows.select(column).where(F.col(column).isNotNull()).distinct().withColumn("key", surface_key(column))
    return rows.join(small(names), column, "left") if rows.isStreaming else rows.join(names, column, "left")


def alias_index(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, entity_id, slug): of a key of several entities the first registered; only entities that aren't candidates."""
    kept = entities.where("status <> 'candidate'").select(F.col("id").alias("entity_id"), "slug")
    named = with_keys(aliases.select("id", "entity_id", F.col("alias").alias("surface"))).join(kept, "entity_id").where("key is not null and key <> ''")
    return best_row(named, ["key"], [F.asc("entity_id"), F.asc("id")]).select("key", "entity_id", "slug")


def surfaces(items: DataFrame, analyses: DataFrame) -> DataFrame:
    """(raw_item_id, analysis_id, field, surface): what each item and its current analysis name, trimmed; each once. Items without analysis name nothing."""
    best = current_analyses(analyses.select("id", "raw_item_id", "model_name", "created_at", "political_actors", "district", "department", "scheme")).select(F.col("id").alias("analysis_id"), "raw_item_id", "political_actors", "district", "department", "scheme")
    joined = best.join(items.select(F.col("id").alias("raw_item_id"), "source_name"), "raw_item_id")
    one = lambda f, c: F.struct(F.lit(f).alias("field"), F.array(F.col(c)).alias("names"))
    parts = F.array(one("source", "source_name"), F.struct(F.lit("political_actors").alias("field"), F.coalesce("political_actors", F.array().cast("array<string>")).alias("names")), one("district", "district"), one("department", "department"), one("scheme", "scheme"))
    said = joined.select("raw_item_id", "analysis_id", F.explode(parts).alias("p")).select("raw_item_id", "analysis_id", "p.field", F.explode("p.names").alias("surface"))
    return said.where("trim(coalesce(surface, '')) <> ''").select("raw_item_id", "analysis_id", "field", F.trim("surface").alias("surface")).distinct()


def resolved(said: DataFrame, index: DataFrame) -> DataFrame:
    """Adds key, entity_id, slug and state to surfaces: resolved by its key, else without a closing bracket; a district that isn't known is dropped; a source that isn't known becomes one; any other becomes a candidate. Generic names are left out, but for sources.

    Looked up once for each field and key, however often it is named.
    """
    keyed = with_keys(said).where((F.col("field") == "source") | ~F.coalesce("key", F.lit("")).isin(*GENERIC))
    names = keyed.select("key").distinct().withColumn("_bare", F.trim(F.regexp_replace("key", r"\s*\([^)]*\)\s*$", "")))
    a, b = index.select("key", F.col("entity_id").alias("_e1"), F.col("slug").alias("_s1")), index.select(F.col("key").alias("_bare"), F.col("entity_id").alias("_e2"), F.col("slug").alias("_s2"))
    found = names.join(small(a), "key", "left").join(small(b), "_bare", "left").select("key", F.coalesce("_e1", "_e2").alias("entity_id"), F.coalesce("_s1", "_s2").alias("_slug"))
    joined = keyed.join(found, "key", "left")
    made = F.concat(F.when(F.col("field") == "source", "source-").otherwise("candidate-"), key_slug(F.col("key")))
    state = F.when(F.col("entity_id").isNotNull(), "resolved").when(F.col("field") == "source", "source").otherwise("candidate")
    out = joined.withColumn("state", state).withColumn("slug", F.coalesce("_slug", made)).drop("_slug")
    return out.where((F.col("field") != "district") | F.col("entity_id").isNotNull())


def candidates(edges: DataFrame) -> DataFrame:
    """(slug, entity_type, canonical_name, status, n): entities that surfaces make. The type is that of the first item and field to name it."""
    order = F.coalesce(*[F.when(F.col("field") == f, i) for i, f in enumerate(FIELDS)])
    kind = F.create_map(*[F.lit(v) for pair in TYPES.items() for v in pair])
    new = edges.where("state <> 'resolved'").groupBy("slug").agg(F.min(F.struct("raw_item_id", order.alias("o"), "surface", "field", "state")).alias("f"), F.count("*").alias("n"))
    return new.select("slug", kind[F.col("f.field")].alias("entity_type"), F.col("f.surface").alias("canonical_name"), F.when(F.col("f.state") == "source", "active").otherwise("candidate").alias("status"), "n")


PROFILE = ("canonical_name", "name_ta", "role", "party", "district", "portfolio")


def synced(old: DataFrame, seeds: DataFrame) -> DataFrame:
    """(slug, entity_type, profile, status) after seeds are merged in by slug: a blank never replaces what is there, an active entity stays active; new slugs are added. Of several seeds with a slug the last by name holds."""
    columns = ["slug", "entity_type", *PROFILE, "status"]
    have = set(seeds.columns)
    new = best_row(seeds.select(*[F.col(c) if c in have else F.lit("").alias(c) for c in columns]), ["slug"], [F.desc("canonical_name")])
    renamed = new.select("slug", *[F.col(c).alias(f"_{c}") for c in columns[1:]])
    both = old.select(*columns).join(renamed, "slug", "full")
    filled = [F.coalesce(F.nullif(F.trim(f"_{c}"), F.lit("")), F.col(c), F.lit("")).alias(c) for c in PROFILE]
    active = (F.coalesce("status", F.lit("")) == "active") | (F.coalesce("_status", F.lit("")) == "active")
    return both.select("slug", F.coalesce("entity_type", "_entity_type").alias("entity_type"), *filled, F.when(active, "active").otherwise(F.coalesce("_status", "status")).alias("status"))


def source_seeds(items: DataFrame) -> DataFrame:
    """One active entity for each name of a source; names with one slug are one."""
    names = with_keys(items.select(F.col("source_name").alias("surface")).where("trim(coalesce(source_name, '')) <> ''").distinct())
    return names.select(F.concat(F.lit("source-"), key_slug(F.col("key"))).alias("slug"), F.lit("source").alias("entity_type"), F.trim("surface").alias("canonical_name"), F.lit("active").alias("status"))


def maintained(old: DataFrame, edges: DataFrame) -> DataFrame:
    """(raw_item_id, slug, field, surface, analysis_id, change): one view of each item: edges of another analysis than the current one go (replaced), those that are missing come (created), the others stay (kept). Edges without analysis and those of items without a current analysis stay. old: raw_item_id, slug, field, surface, analysis_id."""
    now = edges.select("raw_item_id", "slug", "field", "surface", F.col("analysis_id").alias("_now")).distinct()
    current = edges.select("raw_item_id", F.col("analysis_id").alias("_current")).distinct()
    seen = old.join(current, "raw_item_id", "left")
    stale = F.col("_current").isNotNull() & F.col("analysis_id").isNotNull() & (F.col("analysis_id") != F.col("_current"))
    marked = seen.select("raw_item_id", "slug", "field", "surface", "analysis_id", F.when(stale, "replaced").otherwise("kept").alias("change"))
    key = ["raw_item_id", "slug", "field", "surface"]
    created = now.join(marked.where("change = 'kept'").select(*key), key, "left_anti").select(*key, F.col("_now").alias("analysis_id"), F.lit("created").alias("change"))
    return marked.unionByName(created)


def resolve_all(items: DataFrame, analyses: DataFrame, entities: DataFrame, aliases: DataFrame, seeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Seeds, then sources, then items: the entities after it, and the edges."""
    kept = synced(entities, seeds) if seeds is not None else entities.select("slug", "entity_type", *PROFILE, "status")
    edges = resolved(surfaces(items, analyses), alias_index(entities, aliases))
    made = candidates(edges)
    return synced(synced(kept, source_seeds(items)), made.where("status = 'candidate'")), edges
