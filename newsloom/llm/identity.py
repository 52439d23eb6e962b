"""Who published and who wrote an item, told apart by the aliases of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small


def folded(c: Column) -> Column:
    """Case folded, runs of white space as one space, trimmed; null for null and for names of white space alone."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " ")), F.lit(""))


def _aliases(entities: DataFrame, aliases: DataFrame, wanted: Column) -> DataFrame:
    """name, entity: one row per folded alias of the wanted entities. An alias of several goes to the first by id."""
    kept = entities.where(wanted).select(F.col("id").alias("entity"))
    named = aliases.select(F.col("entity_id").alias("entity"), folded(F.col("alias")).alias("name")).join(kept, "entity")
    return named.where("name is not null").groupBy("name").agg(F.min("entity").alias("entity"))


def with_identity(items: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds `source_key` (the entity of source_name, else its folded form; null only if there is no name) and `author_key` (null unless the byline is a journalist's).

    The tables of entities and aliases are counted before a broadcast; beyond the
    limit the joins shuffle on the folded name.
    """
    sources = _aliases(entities, aliases, F.col("entity_type") == "source")
    authors = _aliases(entities, aliases, (F.col("entity_type") == "person") & (F.col("role") == "journalist"))
    named = items.withColumns({"_source": folded(F.col("source_name")), "_author": folded(F.col("metadata_json")["author"])})
    named = named.join(small(sources.select(F.col("name").alias("_source"), F.col("entity").alias("_se"))), "_source", "left")
    named = named.join(small(authors.select(F.col("name").alias("_author"), F.col("entity").alias("_ae"))), "_author", "left")
    return named.withColumns(
        {
            "source_key": F.coalesce(F.concat(F.lit("e"), F.col("_se").cast("string")), F.concat(F.lit("n"), F.col("_source"))),
            "author_key": F.concat(F.lit("a"), F.col("_ae").cast("string")),
        }
    ).drop("_source", "_author", "_se", "_ae")
