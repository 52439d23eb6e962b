"""The current row of a key under the named policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Orders, best first, by which an item's current analysis is told. A model whose name starts with mock is a stand-in.
def _mock() -> Column:
    return F.lower(F.coalesce("model_name", F.lit(""))).startswith("mock").cast("int")


def policy(name: str) -> list[Column]:
    """kpi: no stand-in, latest, least id; graph: the same with the greatest id; latest_id: greatest id alone; chat: latest, greatest id."""
    return {
        "kpi": [_mock().asc(), F.col("created_at").desc_nulls_last(), F.col("id").asc()],
        "graph": [_mock().asc(), F.col("created_at").desc_nulls_last(), F.col("id").desc()],
        "latest_id": [F.col("id").desc()],
        "chat": [F.col("created_at").desc_nulls_last(), F.col("id").desc()],
    }[name]


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by the order. Rows with equal order are equal in all that decides; a null key is a key."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(at)).where("_rank = 1").drop("_rank")


def current_analyses(analyses: DataFrame, name: str = "graph") -> DataFrame:
    return best_row(analyses, ["raw_item_id"], policy(name))


def relevant(column: str = "government_relevance") -> Column:
    """The relevance gate: null passes."""
    return F.lower(F.coalesce(column, F.lit(""))) != "none"


def subject_portrayal() -> Column:
    """The portrayal of the subject, else the stance, else neutral."""
    known = ("positive", "negative", "mixed", "neutral")
    one = lambda c: F.when(F.lower(F.col(c)).isin(*known), F.lower(F.col(c)))
    return F.coalesce(one("tvk_portrayal"), one("stance_toward_government"), F.lit("neutral"))


def severity_rank(column: str = "severity") -> Column:
    s = F.lower(F.coalesce(column, F.lit("")))
    return F.when(s == "critical", 4).when(s == "high", 3).when(s == "medium", 2).when(s == "low", 1).otherwise(0)


def item_day(published: str = "published_at", ingested: str = "ingested_at", analysed: str = "created_at") -> Column:
    """The UTC day of an item: published, else ingested, else analysed, else 1970-01-01."""
    return F.coalesce(F.to_date(F.coalesce(published, ingested, analysed)), F.lit("1970-01-01").cast("date"))
