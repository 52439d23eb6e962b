"""Train, validation and test splits that never part items of one source or author.

Method: each pair of source and author that an item has is an edge; Boruvka's
contraction builds a spanning forest, kept in the shared folder, whose trees are the
groups. The groups, stratified by size band, are dealt systematically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small, stored
from .forest import spanning_forest
from .identity import with_identity

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Groups of a size band that are sorted together, about; a band has as many such parts as it needs.
PART_GROUPS = 100_000
#: Share of all items from which a group is placed by itself.
HEAVY = 0.002


def item_groups(items: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(raw_item_id, root): the group of each item, linked by source or named author, directly or through others.

    An item without source and author is a group of its own; a null id is ignored.
    """
    named = with_identity(items.select("id", "source_name", "metadata_json").where("id is not null"), entities, aliases).select("id", "source_key", "author_key")
    named = named.withColumn("source_key", F.coalesce("source_key", "author_key", F.concat(F.lit("i"), F.col("id").cast("string"))))
    pairs = named.where("author_key is not null").groupBy(F.col("source_key").alias("u"), F.col("author_key").alias("v")).agg(F.min("id").alias("w"))
    _, components = spanning_forest(pairs)
    # Aggregated before the join: one row per source, however many items a source has.
    sources = components.select(F.col("node").alias("source_key"), "root")
    return named.join(sources, "source_key", "left").select(F.col("id").alias("raw_item_id"), F.coalesce("root", "source_key").alias("root"))


def labelled_groups(items: DataFrame, labels: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(raw_item_id, group_first_id) of each labelled item that is among the items; a labelled id without item is a group of its own."""
    wanted = labels.select("raw_item_id").where("raw_item_id is not null").distinct()
    grouped = wanted.join(item_groups(items, entities, aliases).dropDuplicates(["raw_item_id"]), "raw_item_id", "left")
    grouped = grouped.withColumn("root", F.coalesce("root", F.concat(F.lit("i"), F.col("raw_item_id").cast("string"))))
    first = grouped.groupBy("root").agg(F.min("raw_item_id").alias("group_first_id"))
    return grouped.join(first, "root").select("raw_item_id", "group_first_id")


def split_groups(sizes: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """Deals groups (group_first_id, n) to splits: adds `split`.

    Groups of at least HEAVY of all items, 1 / HEAVY of them at most, go one by one, the
    largest first, to the split that lacks most items. The others are dealt in bands, the
    powers of two of their size: within a band each group takes as much of a line as it
    has items, in an order drawn by hash; the line is dealt in turns of ten of the band's
    usual groups, in proportion to what the splits still lack. Ties go by group id, and
    of splits to the one named first. Groups without items count as having one; an empty
    input gives an empty result.
    """
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    names = list(shares)
    lacks = {name: shares[name] * total for name in names}
    heavy = {}
    for r in sizes.where(F.col("n") >= HEAVY * total).orderBy(F.desc("n"), "group_first_id").collect() if total else ():
        name = max(names, key=lambda x: lacks[x])
        heavy[r["group_first_id"]] = name
        lacks[name] -= r["n"]
    left = {name: max(0.0, v) for name, v in lacks.items()}
    whole = sum(left.values()) or 1.0
    ids = {name: [g for g, x in heavy.items() if x == name] for name in names}
    first = F.coalesce(*[F.when(F.col("group_first_id").isin(ids[name]), name) for name in names if ids[name]], F.lit(None).cast("string"))

    band = F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)).cast("double"))).cast("int")
    parted = sizes.withColumns({"_band": band, "_h": F.xxhash64("group_first_id"), "_heavy": first})
    light = parted.where("_heavy is null")
    parts = light.groupBy("_band").agg(F.ceil(F.count("*") / PART_GROUPS).alias("_parts"))  # at most 64 bands
    light = light.join(F.broadcast(parts), "_band").withColumn("_part", F.pmod("_h", F.col("_parts")))
    per = light.groupBy("_band", "_part").agg(F.sum("n").alias("_sum"))
    starts = per.withColumn("_start", F.sum("_sum").over(Window.partitionBy("_band").orderBy("_part")) - F.col("_sum")).drop("_sum")  # a row for PART_GROUPS groups
    own = Window.partitionBy("_band", "_part").orderBy("_h", "group_first_id")
    placed = light.join(small(starts), ["_band", "_part"]).withColumn("_mid", F.col("_start") + F.sum("n").over(own) - F.col("n") / 2)
    turn = F.pmod(F.col("_mid") / (F.pow(F.lit(2.0), F.col("_band")) * 1.5 * 10) + F.pmod(F.xxhash64(F.col("_band")), F.lit(97)) / 97.0, F.lit(1.0))
    split, low = None, 0.0
    for name in names[:-1]:
        low += left[name] / whole
        split = F.when(turn < low, name) if split is None else split.when(turn < low, name)
    split = split.otherwise(names[-1])
    dealt = placed.withColumn("split", split).select(*sizes.columns, "split")
    return dealt.union(parted.where("_heavy is not null").withColumn("split", F.col("_heavy")).select(*sizes.columns, "split"))


def assign_splits(items: DataFrame, labels: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(raw_item_id, group_first_id, split): one row per labelled item."""
    grouped = labelled_groups(items, labels, entities, aliases)
    grouped = stored(grouped, "grouped")
    sizes = stored(grouped.groupBy("group_first_id").agg(F.count("*").alias("n")), "sizes")
    return grouped.join(split_groups(sizes).drop("n"), "group_first_id").select("raw_item_id", "group_first_id", "split")
