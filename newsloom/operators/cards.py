"""Cards: facets, pages, alerts and groups for a briefing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def priority_rank() -> Column:
    p = F.lower(F.coalesce(F.nullif(F.col("action_priority"), F.lit("")), F.col("severity"), F.lit("")))
    return F.when(p == "critical", 4).when(p == "high", 3).when(p == "medium", 2).when(p == "low", 1).otherwise(0)


def review() -> Column:
    return F.coalesce("needs_human_review", F.lit(False))


@dataclass(frozen=True)
class Facets:
    """What a reader narrows cards to; what isn't given doesn't narrow. All that are given must hold."""

    #: A category; people also takes cards under review.
    category: str | None = None
    themes: tuple[str, ...] = ()
    source: str | None = None
    district: str | None = None
    in_district: bool = False
    departments: tuple[str, ...] = ()
    issue: str | None = None
    day: str | None = None
    #: Age in days at most, up to as_of.
    days: int | None = None
    as_of: str | None = None
    text: str | None = None

    def of(self, cards: DataFrame) -> DataFrame:
        kept, c = cards, F.col
        if self.category == "people":
            kept = kept.where(F.coalesce("people_issue", F.lit(False)) | review())
        elif self.category:
            kept = kept.where(c("category") == self.category)
        if self.themes:
            kept = kept.where(c("theme_id").cast("string").isin(*self.themes))
        if self.source:
            kept = kept.where(c("source_name") == self.source)
        if self.district:
            kept = kept.where(c("district_canonical") == self.district)
        if self.in_district:
            kept = kept.where(c("district_canonical").isNotNull())
        if self.departments:
            kept = kept.where(F.lower(F.trim("department_canonical")).isin(*[d.strip().lower() for d in self.departments]))
        if self.issue:
            kept = kept.where(F.lower(F.trim("public_issue")) == self.issue.strip().lower())
        if self.day:
            kept = kept.where(F.date_format("day", "yyyy-MM-dd") == self.day)
        elif self.days is not None:
            kept = kept.where(F.datediff(F.lit(self.as_of).cast("date"), c("day")).between(0, self.days))
        if self.text:
            kept = kept.where(F.contains(F.lower(F.concat_ws(" ", "title", "summary")), F.lit(self.text.lower())))
        return kept


def clamped(n: int, least: int = 1, most: int = 200) -> int:
    return max(least, min(n, most))


def page(cards: DataFrame, number: int, size: int = 12) -> DataFrame:
    """One page, newest first, with its number; rows before it are dropped by a limit, so nothing but the pages up to it is ranked."""
    number = max(1, number)
    first = cards.orderBy(F.desc("created_at"), F.desc("id")).limit(number * size)
    at = Window.partitionBy(F.lit(0)).orderBy(F.desc("created_at"), F.desc("id"))  # the rows of a few pages
    return first.withColumn("page", F.floor((F.row_number().over(at) - 1) / size) + 1).where(F.col("page") == number)


def alerts(cards: DataFrame, limit: int = 5) -> DataFrame:
    """The cards to act on first: negative ones and people's issues of high priority or under review, by urgency, priority and time (at)."""
    ranked = cards.where(F.col("category").isin("negative", "people")).withColumns({"_rank": priority_rank(), "_review": review().cast("int")})
    urgent = ranked.where("_rank >= 3 or _review = 1").withColumn("urgency", F.col("_rank") + F.col("_review"))
    return urgent.orderBy(F.desc("urgency"), F.desc("_rank"), F.desc_nulls_last("at"), F.desc("raw_item_id")).limit(limit)


def briefing_groups(cards: DataFrame, each: int = 4, first: int = 8) -> DataFrame:
    """(grp, place, raw_item_id): positive cards, at most `each`; cards of concern, negative, mixed, people's issues or under review, at most `each`; and the first ones at all. Order: ord."""
    concern = F.coalesce("people_issue", F.lit(False)) | F.col("category").isin("negative", "mixed") | review()
    parts = []
    for name, where, most in (("positive", F.col("category") == "positive", each), ("concern", concern, each), ("first", F.lit(True), first)):
        kept = cards.where(where).orderBy("ord", "raw_item_id").limit(most)
        at = Window.partitionBy(F.lit(0)).orderBy("ord", "raw_item_id")  # a few rows
        parts.append(kept.select(F.lit(name).alias("grp"), F.row_number().over(at).alias("place"), "raw_item_id"))
    return parts[0].union(parts[1]).union(parts[2])
