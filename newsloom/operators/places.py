"""Districts and departments: canonical names, who is responsible, rollups by place."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small
from .analyzer import LEFT, RIGHT

#: Endings of district names; names that are none.
SUFFIXES = (" district", " மாவட்டம்")
NO_DISTRICT = ("", "unspecified", "unknown", "statewide", "general", "none", "n/a")
#: Ordered rules for departments: keywords, found anywhere in the folded name, and the canonical name.
DEPARTMENTS = (
    (("drinking water", "water"), "Water Supply"), (("sanitation", "drain", "waste"), "Local Bodies"), (("power", "electric", "energy"), "Energy"), (("road", "transport", "bridge", "bus"), "Roads and Transport"),
    (("health", "hospital", "medical"), "Health"), (("school", "education", "college"), "Education"), (("police", "law"), "Home"), (("revenue", "relief", "flood"), "Revenue and Relief"),
    (("farm", "agri", "crop"), "Agriculture"), (("fish",), "Fisheries"), (("ration", "food", "cooperat"), "Food and Cooperation"), (("welfare", "pension"), "Social Welfare"), (("government", "cabinet", "secretariat"), "Government"),
)
NO_DEPARTMENT = ("", "general", "unspecified", "unknown", "n/a", "none")
PREFIXES, ENDINGS = ("department of ", "directorate of ", "ministry of "), (" department", " wing", " board")
CATEGORIES, DOMINANT = ("positive", "negative", "mixed", "people", "neutral"), ("negative", "people", "mixed", "positive")


def district_key(name: Column) -> Column:
    """The folded name without its ending; null where it names no district."""
    bare = F.trim(name)
    for s in SUFFIXES:
        bare = F.trim(F.regexp_replace(bare, "(?i)" + s + "$", ""))
    key = F.lower(bare)
    return F.when(~key.isin(*NO_DISTRICT), key)


def district_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(alias, district): the folded names of the districts; of a name of several the first by canonical name."""
    kept = entities.where("entity_type = 'district'").select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("district"))
    named = aliases.select("entity_id", district_key(F.col("alias")).alias("alias")).join(kept, "entity_id").select("alias", "district")
    return named.union(kept.select(district_key(F.col("district")), "district")).where("alias is not null").groupBy("alias").agg(F.min("district").alias("district"))


def canonical_districts(rows: DataFrame, column: str, known: DataFrame, out: str = "district_canonical") -> DataFrame:
    """Adds the canonical name of a district as it is written, or without its dots; null if it is none."""
    a, b = known.select(F.col("alias").alias("_k1"), F.col("district").alias("_d1")), known.select(F.col("alias").alias("_k2"), F.col("district").alias("_d2"))
    keyed = rows.withColumn("_k1", district_key(F.col(column))).withColumn("_k2", F.trim(F.regexp_replace("_k1", r"\.", "")))
    return keyed.join(small(a), "_k1", "left").join(small(b), "_k2", "left").withColumn(out, F.coalesce("_d1", "_d2")).drop("_k1", "_k2", "_d1", "_d2")


def canonical_department(name: Column) -> Column:
    """The canonical department: one prefix and one ending off, the first rule whose keyword is in it; else the name, in title case if it has but one case; null for placeholders."""
    clean = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", " "))
    clean = F.regexp_replace(clean, f"(?i)^(?:{'|'.join(PREFIXES)})", "")
    clean = F.trim(F.regexp_replace(clean, f"(?i)(?:{'|'.join(ENDINGS)})$", ""))
    key = F.lower(clean)
    ruled = F.coalesce(*[F.when(key.rlike("|".join(words)), F.lit(to)) for words, to in DEPARTMENTS])
    one_case = (clean == key) | (clean == F.upper(clean))
    return F.when(key.isin(*NO_DEPARTMENT), None).otherwise(F.coalesce(ruled, F.when(one_case, F.initcap(clean)).otherwise(clean)))


def detected_districts(texts: DataFrame, known: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Adds `district`, the one that the texts name first: the columns in order, within one the earliest mention, of mentions at one place the longest. Names of Latin letters match as words without case, others anywhere.

    known: (alias, district), a table of fixed size; one alternation of all names reads
    each text once.
    """
    names = sorted((r["alias"], r["district"]) for r in known.collect())
    if not names:
        return texts.withColumn("district", F.lit(None).cast("string"))
    quoted = [re.escape(a).replace("\\ ", " ") for a, _ in sorted(names, key=lambda x: (-len(x[0]), x[0]))]
    latin, other = [q for q in quoted if q.isascii()], [q for q in quoted if not q.isascii()]
    pattern = "|".join([*([f"{LEFT}(?:{'|'.join(latin)}){RIGHT}"] if latin else []), *other])
    lookup = F.create_map(*[F.lit(v) for pair in names for v in pair])
    first = [F.nullif(F.regexp_extract(F.lower(F.coalesce(F.col(c), F.lit(""))), f"({pattern})", 1), F.lit("")) for c in columns]
    return texts.withColumn("district", lookup[F.coalesce(*first)])


def dominant() -> Column:
    return F.coalesce(*[F.when(F.col(k) > 0, k) for k in DOMINANT], F.lit("quiet"))


def by_category() -> list[Column]:
    """Counts of cards by category; an unknown category counts in none."""
    return [F.count_if(F.coalesce("category", F.lit("neutral")) == k).alias(k) for k in CATEGORIES]


def district_rollup(cards: DataFrame, districts: DataFrame, issues: int = 3) -> DataFrame:
    """(district, total, counts, dominant, top_issues): every district, those without cards with zeros; cards of no district under <unmapped>. cards: district_canonical, category, public_issue. Counted before the join; top issues by count, then name."""
    name = F.coalesce("district_canonical", F.lit("<unmapped>"))
    counted = cards.groupBy(name.alias("district")).agg(F.count("*").alias("total"), *by_category())
    per = cards.where("trim(coalesce(public_issue, '')) <> '' and district_canonical is not null").groupBy(F.col("district_canonical").alias("district"), F.trim("public_issue").alias("issue")).agg(F.count("*").alias("n"))
    at = Window.partitionBy("district").orderBy(F.desc("n"), "issue")
    top = per.withColumn("r", F.row_number().over(at)).where(F.col("r") <= issues).groupBy("district").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "issue", "n"))), lambda s: F.concat(s["issue"], F.lit(" x"), s["n"])), "; ").alias("top_issues"))
    every = districts.select("district").union(districts.sparkSession.range(1).select(F.lit("<unmapped>").alias("district")))
    filled = every.join(counted, "district", "left").join(top, "district", "left").na.fill(0).na.fill("", ["top_issues"])
    return filled.withColumn("dominant", dominant())


def department_rollup(cards: DataFrame, limit: int = 14) -> DataFrame:
    """(department, total, counts, dominant): the departments with most cards by canonical name, ties by name."""
    named = cards.withColumn("department", canonical_department(F.col("department"))).where("department is not null")
    return named.groupBy("department").agg(F.count("*").alias("total"), *by_category()).orderBy(F.desc("total"), "department").limit(limit).withColumn("dominant", dominant())


def responsibility(cards: DataFrame, members: DataFrame, most: int = 6) -> DataFrame:
    """Adds who is to act on a card: department_owner, district_office, members, member_count, escalate, actionable.

    cards: public_issue, department, district, district_canonical, category, people_issue,
    action_priority, severity. members: (district, name) of those elected there.
    """
    text = F.concat_ws(" ", F.coalesce("public_issue", F.lit("")), F.coalesce("department", F.lit("")))
    low = F.lower(text)
    ruled = F.coalesce(*[F.when(low.rlike("|".join(words)), F.lit(to)) for words, to in DEPARTMENTS])
    said = F.trim(F.coalesce("department", F.lit("")))
    owner = F.coalesce(ruled, F.when(~F.lower(said).isin(*NO_DEPARTMENT), F.initcap(said)), F.lit(""))
    grouped = members.groupBy(F.col("district").alias("district_canonical")).agg(F.sort_array(F.collect_list("name")).alias("_names"))
    joined = cards.join(small(grouped), "district_canonical", "left")
    priority = F.lower(F.coalesce(F.nullif(F.col("action_priority"), F.lit("")), F.col("severity"), F.lit("")))
    problem = F.coalesce("people_issue", F.lit(False)) | F.col("category").isin("negative", "people")
    placed = F.col("district_canonical").isNotNull()
    escalate = problem & priority.isin("high", "critical")
    return joined.withColumns(
        {
            "department_owner": owner,
            "district_office": F.when(placed, F.concat("district_canonical", F.lit(" Collector"))).otherwise(""),
            "members": F.array_join(F.slice(F.coalesce("_names", F.array().cast("array<string>")), 1, most), "; "),
            "member_count": F.coalesce(F.size("_names"), F.lit(0)),
            "escalate": escalate,
            "actionable": (owner != "") | (placed & problem) | escalate,
        }
    ).drop("_names")
