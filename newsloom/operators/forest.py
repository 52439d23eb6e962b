"""Spanning forests and connected components of graphs of any size, by Boruvka's contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest given as (node, parent), roots being their own parents: pointer jumping, a round for each doubling of the depth."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = stored(parents.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "jump")
        moved = jumped.where("moved").limit(1).count()
        parents = jumped.select("node", "parent")
        if not moved:
            return parents.select("node", F.col("parent").alias("root"))


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The minimum spanning forest of edges (u, v, w) and the components of its nodes.

    Each round every component takes its least edge by (w, u, v); the chosen edges
    join the forest, which is kept as tables in the shared folder, and what they
    connect is contracted. At least half of the components go in each round. Result:
    forest (u, v, w) and components (node, root). Loops and rows with null ends are
    ignored, parallel edges count once; an empty input gives empty tables. Joins on nodes
    with very many edges are split by the adaptive handling of skewed joins; to salt them
    would repeat every node.
    """
    key = F.struct("w", F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q"))
    live = edges.where("u is not null and v is not null and u <> v").select(F.col("u").alias("a"), F.col("v").alias("b"), key.alias("k"))
    live = stored(live.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("k").alias("k")), "edges")
    ends = live.select(F.col("a").alias("node")).union(live.select(F.col("b").alias("node")))
    components = ends.distinct().select("node", F.col("node").alias("root"))
    forest: list[DataFrame] = []
    while live.limit(1).count():
        both = live.select(F.col("a").alias("node"), F.struct("k", F.col("b").alias("to")).alias("e")).union(live.select(F.col("b").alias("node"), F.struct("k", F.col("a").alias("to")).alias("e")))
        least = stored(both.groupBy("node").agg(F.min("e").alias("e")).select("node", F.col("e.to").alias("to"), F.col("e.k").alias("k")), "least")
        forest.append(least.select(F.col("k.p").alias("u"), F.col("k.q").alias("v"), F.col("k.w").alias("w")).distinct())
        back = least.select(F.col("node").alias("to"), F.col("to").alias("back"))
        # Two components that chose the same edge point at each other: the smaller name becomes the root.
        parents = least.join(back, "to", "left").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("parent"))
        roots = _roots(parents)
        relabel = roots.select(F.col("node").alias("root"), F.col("root").alias("_to"))
        components = stored(components.join(relabel, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "components")
        for end in ("a", "b"):
            live = live.join(roots.select(F.col("node").alias(end), F.col("root").alias("_to")), end).drop(end).withColumnRenamed("_to", end)
        live = stored(live.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("k").alias("k")), "edges")
    chosen = edges.select("u", "v", "w").limit(0)
    for part in forest:
        chosen = chosen.union(part)
    return chosen, components
