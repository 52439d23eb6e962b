"""Queries on entities: mentions, series, surges, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph as g
from ..session import small
from .analyses import GATED
from .registry import Tables, query

MENTIONS = f"""(SELECT DISTINCT e.entity_id, n.slug, n.canonical_name, n.entity_type, x.* FROM item_entities e JOIN entities n ON n.id = e.entity_id
 JOIN {GATED} x ON x.raw_item_id = e.raw_item_id WHERE n.status <> 'candidate')"""
KINDS = ("positive", "negative", "mixed", "neutral")
COUNTS = ", ".join(f"count(*) FILTER (portrayal = '{k}') AS {k}" for k in KINDS)


def fav(p: str, n: str) -> str:
    return f"CAST(round_even(50 + 50 * ({p} - {n}) / nullif({p} + {n}, 0)::DOUBLE, 0) AS INTEGER)"


@query(f"SELECT slug, count(*) AS mentions, {COUNTS}, {fav("count(*) FILTER (portrayal = 'positive')", "count(*) FILTER (portrayal = 'negative')")} AS favourability FROM {MENTIONS} GROUP BY 1")
def agg9_entity_split(t: Tables) -> DataFrame:
    out = g.mentions(t).groupBy("slug").agg(F.count("*").alias("mentions"), *[g.count_of(k).alias(k) for k in KINDS])
    return out.withColumn("favourability", g.favourability(F.col("positive"), F.col("negative")))


@query(f"""SELECT slug, CASE WHEN greatest(p, n, m) = 0 THEN 'neutral' WHEN n >= p AND n >= m THEN 'negative' WHEN p >= m THEN 'positive' ELSE 'mixed' END AS dominant FROM
 (SELECT slug, count(*) FILTER (portrayal = 'positive') AS p, count(*) FILTER (portrayal = 'negative') AS n, count(*) FILTER (portrayal = 'mixed') AS m FROM {MENTIONS} GROUP BY 1)""")
def agg11_dominant_lean(t: Tables) -> DataFrame:
    """The greatest of negative, positive and mixed; ties go to the earlier, nothing at all to neutral."""
    c = g.mentions(t).groupBy("slug").agg(*[g.count_of(k).alias(k) for k in KINDS])
    most = F.greatest("negative", "positive", "mixed")
    lean = F.when(most == 0, "neutral").when(F.col("negative") == most, "negative").when(F.col("positive") == most, "positive").otherwise("mixed")
    return c.select("slug", lean.alias("dominant"))


@query(f"""WITH m AS {MENTIONS}, l AS (SELECT date_trunc('week', max(day))::DATE AS last FROM {GATED}), w AS (SELECT unnest(generate_series(last - INTERVAL 49 DAY, last::TIMESTAMP, INTERVAL 7 DAY))::DATE AS week_start FROM l),
 c AS (SELECT s.slug, w.week_start, count(m.day) FILTER (portrayal = 'positive') AS positive, count(m.day) FILTER (portrayal = 'negative') AS negative, count(m.day) FILTER (portrayal = 'mixed') AS mixed, count(m.day) FILTER (portrayal = 'neutral') AS neutral
 FROM (SELECT DISTINCT slug FROM m) s CROSS JOIN w LEFT JOIN m ON m.slug = s.slug AND date_trunc('week', m.day)::DATE = w.week_start GROUP BY 1, 2)
 SELECT slug, strftime(week_start, '%Y-%m-%d') AS week_start, positive, negative, mixed, neutral, {fav('positive', 'negative')} AS favourability FROM c""")
def agg12_weekly_series(t: Tables) -> DataFrame:
    gated = g.gated_items(t)
    return g.weekly(g.mentions(t), g.as_of(gated)).withColumn("week_start", F.date_format("week_start", "yyyy-MM-dd")).drop("entity_id")


@query(f"""SELECT slug, arg_max(raw_item_id, (CASE WHEN portrayal = 'negative' THEN 1 ELSE 0 END) * 1000000000000000 + severity_rank * 100000000000000 + datediff('day', DATE '1970-01-01', day) * 1000000000 + raw_item_id) AS headline_item
 FROM {MENTIONS}, (SELECT max(day) AS as_of FROM {GATED}) l WHERE datediff('day', day, as_of) < 3 GROUP BY 1""")
def win12_headlines(t: Tables) -> DataFrame:
    """The item that stands for an entity's last three days: a negative one if there is any, by severity, day and id."""
    recent = g.mentions(t).crossJoin(F.broadcast(g.as_of(g.gated_items(t)))).where(F.datediff("as_of", "day") < 3)
    key = F.struct((F.col("portrayal") == "negative").cast("int").alias("n"), "severity_rank", "day", "raw_item_id")
    return recent.groupBy("slug").agg(F.max(key).alias("k")).select("slug", F.col("k.raw_item_id").alias("headline_item"))


@query(f"""SELECT slug, raw_item_id, strftime(day, '%Y-%m-%d') AS day FROM {MENTIONS}, (SELECT max(day) AS as_of FROM {GATED}) l WHERE datediff('day', day, as_of) <= 90
 QUALIFY row_number() OVER (PARTITION BY slug ORDER BY day DESC, raw_item_id DESC) <= 50""")
def win15_evidence_log(t: Tables) -> DataFrame:
    recent = g.mentions(t).crossJoin(F.broadcast(g.as_of(g.gated_items(t)))).where(F.datediff("as_of", "day") <= 90)
    at = Window.partitionBy("slug").orderBy(F.desc("day"), F.desc("raw_item_id"))
    return recent.withColumn("r", F.row_number().over(at)).where("r <= 50").select("slug", "raw_item_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query(f"""WITH m AS (SELECT * FROM {MENTIONS} WHERE entity_type = 'person'), l AS (SELECT max(day) AS as_of, date_trunc('week', max(day))::DATE AS last FROM {GATED}),
 c AS (SELECT slug, count(*) AS mentions, count(*) FILTER (datediff('day', day, as_of) <= 30) AS mentions_30d,
 count(*) FILTER (portrayal = 'positive' AND w BETWEEN last - 49 AND last - 28) AS p1, count(*) FILTER (portrayal = 'negative' AND w BETWEEN last - 49 AND last - 28) AS n1,
 count(*) FILTER (portrayal = 'positive' AND w BETWEEN last - 21 AND last) AS p2, count(*) FILTER (portrayal = 'negative' AND w BETWEEN last - 21 AND last) AS n2
 FROM (SELECT m.*, l.*, date_trunc('week', day)::DATE AS w FROM m CROSS JOIN l) GROUP BY 1)
 SELECT slug, mentions, mentions_30d, {fav('p1', 'n1')} AS fav_first, {fav('p2', 'n2')} AS fav_last, {fav('p2', 'n2')} - {fav('p1', 'n1')} AS momentum FROM c WHERE mentions >= 2""")
def win17_scorecard_momentum(t: Tables) -> DataFrame:
    """Favourability of the last four weeks against the four before, from one pass over the mentions."""
    last = g.as_of(g.gated_items(t)).withColumn("_last", F.date_trunc("week", "as_of").cast("date"))
    placed = g.mentions(t).where("entity_type = 'person'").crossJoin(F.broadcast(last)).withColumn("_w", F.datediff("_last", F.date_trunc("week", "day").cast("date")))
    half = {"1": F.col("_w").between(28, 49), "2": F.col("_w").between(0, 21)}
    sums = [F.count_if((F.col("portrayal") == kind) & when).alias(f"{kind[0]}{h}") for h, when in half.items() for kind in ("positive", "negative")]
    c = placed.groupBy("slug").agg(F.count("*").alias("mentions"), F.count_if(F.datediff("as_of", "day") <= 30).alias("mentions_30d"), *sums).where("mentions >= 2")
    c = c.withColumns({"fav_first": g.favourability(F.col("p1"), F.col("n1")), "fav_last": g.favourability(F.col("p2"), F.col("n2"))})
    return c.select("slug", "mentions", "mentions_30d", "fav_first", "fav_last", (F.col("fav_last") - F.col("fav_first")).alias("momentum"))


@query(f"SELECT slug, canonical_name AS name, count(*) AS mentions FROM {MENTIONS} GROUP BY 1, 2 ORDER BY mentions DESC, name LIMIT 200")
def srt7_entity_list(t: Tables) -> DataFrame:
    return g.mentions(t).groupBy("slug", F.col("canonical_name").alias("name")).agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "name").limit(200)


@query(f"""SELECT slug, other_slug, n::BIGINT AS n, rank::INTEGER AS rank FROM (SELECT m.slug, o.slug AS other_slug, count(*) AS n, row_number() OVER (PARTITION BY m.slug ORDER BY count(*) DESC, o.slug) AS rank
 FROM {MENTIONS} m JOIN item_entities e ON e.raw_item_id = m.raw_item_id JOIN entities o ON o.id = e.entity_id WHERE e.entity_id <> m.entity_id AND o.status <> 'candidate' AND o.entity_type <> 'source' GROUP BY 1, 2) WHERE rank <= 6""")
def ent6_co_mentions(t: Tables) -> DataFrame:
    return g.co_mentions(g.mentions(t), t.item_entities, t.entities)


@query(f"SELECT n.slug, count(*) AS n FROM item_entities e JOIN entities n ON n.id = e.entity_id JOIN {GATED} x ON x.raw_item_id = e.raw_item_id WHERE n.status = 'candidate' GROUP BY 1 ORDER BY n DESC, slug LIMIT 15")
def agg26_candidates(t: Tables) -> DataFrame:
    edges = t.item_entities.join(t.entities.where("status = 'candidate'").select(F.col("id").alias("entity_id"), "slug"), "entity_id")
    return edges.join(g.gated_items(t).select("raw_item_id"), "raw_item_id").groupBy("slug").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "slug").limit(15)


SURFACES = """(SELECT id AS raw_item_id, 'source' AS field, source_name AS surface FROM raw_items
 UNION ALL SELECT raw_item_id, 'political_actors', unnest(political_actors) FROM ai_analysis UNION ALL SELECT raw_item_id, 'district', district FROM ai_analysis
 UNION ALL SELECT raw_item_id, 'department', department FROM ai_analysis UNION ALL SELECT raw_item_id, 'scheme', scheme FROM ai_analysis)"""
FOLDED = r"nullif(trim(regexp_replace(lower(surface), '\s+', ' ', 'g')), '')"
GENERIC = ("unknown", "none", "n/a", "unspecified", "general", "state government")


def surfaces(t: Tables) -> DataFrame:
    """(raw_item_id, field, surface, key): the names that an item and its analyses mention; placeholders are left out."""
    source = t.raw_items.select(F.col("id").alias("raw_item_id"), F.lit("source").alias("field"), F.col("source_name").alias("surface"))
    parts = F.array(
        *[F.struct(F.lit(c).alias("field"), F.array(F.col(c)).alias("names")) for c in ("district", "department", "scheme")],
        F.struct(F.lit("political_actors").alias("field"), F.coalesce("political_actors", F.array().cast("array<string>")).alias("names")),
    )
    said = t.ai_analysis.select("raw_item_id", F.explode(parts).alias("p")).select("raw_item_id", "p.field", F.explode("p.names").alias("surface"))
    key = F.nullif(F.trim(F.regexp_replace(F.lower("surface"), r"\s+", " ")), F.lit(""))
    return source.union(said).withColumn("key", key).where(F.col("key").isNotNull() & ~F.col("key").isin(*GENERIC))


@query(f"""WITH s AS (SELECT field, {FOLDED} AS key, count(*) AS n FROM {SURFACES} GROUP BY 1, 2), a AS (SELECT normalized, min(entity_id) AS entity_id FROM entity_aliases GROUP BY 1)
 SELECT field, key, n, coalesce(a.entity_id, b.entity_id) AS entity_id, CASE WHEN coalesce(a.entity_id, b.entity_id) IS NULL THEN 'candidate' ELSE 'resolved' END AS status
 FROM s LEFT JOIN a ON a.normalized = key LEFT JOIN a b ON b.normalized = trim(regexp_replace(key, '\\s*\\([^)]*\\)\\s*$', '')) WHERE key IS NOT NULL AND key NOT IN {GENERIC}""")
def ent3_alias_resolution(t: Tables) -> DataFrame:
    """Surfaces resolved by alias, else without their closing bracket; counted before the join, so a hot name joins once."""
    counted = surfaces(t).groupBy("field", "key").agg(F.count("*").alias("n"))
    aliases = small(t.entity_aliases.groupBy("normalized").agg(F.min("entity_id").alias("e")))
    one = aliases.select(F.col("normalized").alias("key"), F.col("e").alias("e1"))
    two = aliases.select(F.col("normalized").alias("bare"), F.col("e").alias("e2"))
    joined = counted.withColumn("bare", F.trim(F.regexp_replace("key", r"\s*\([^)]*\)\s*$", ""))).join(small(one), "key", "left").join(small(two), "bare", "left")
    found = F.coalesce("e1", "e2")
    return joined.select("field", "key", "n", found.alias("entity_id"), F.when(found.isNull(), "candidate").otherwise("resolved").alias("status"))


@query(f"""WITH s AS (SELECT {FOLDED} AS key FROM {SURFACES}), a AS (SELECT DISTINCT normalized FROM entity_aliases)
 SELECT count(*) AS surfaces, count(a.normalized) AS resolved, round(coalesce(count(a.normalized) / nullif(count(*), 0)::DOUBLE, 1.0), 6) AS rate FROM s LEFT JOIN a ON a.normalized = key WHERE key IS NOT NULL AND key NOT IN {GENERIC}""")
def agg23_resolution_rate(t: Tables) -> DataFrame:
    counted = surfaces(t).groupBy("key").agg(F.count("*").alias("n"))
    known = t.entity_aliases.select(F.col("normalized").alias("key")).distinct().withColumn("_known", F.lit(1))
    per = counted.join(small(known), "key", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("surfaces"), F.coalesce(F.sum(F.col("n") * F.col("_known")), F.lit(0)).alias("resolved"))
    return per.withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("resolved"), F.col("surfaces")), F.lit(1.0)), 6))


@query("""SELECT raw_item_id, entity_id, rank::INTEGER AS rank FROM (SELECT raw_item_id, entity_id, row_number() OVER (PARTITION BY raw_item_id ORDER BY CASE mention_field WHEN 'source' THEN 0 WHEN 'district' THEN 1 WHEN 'political_actors' THEN 2 WHEN 'department' THEN 3 WHEN 'scheme' THEN 4 ELSE 5 END, id) AS rank FROM item_entities) WHERE rank <= 4""")
def srt14_item_links(t: Tables) -> DataFrame:
    order = F.coalesce(*[F.when(F.col("mention_field") == f, i) for i, f in enumerate(("source", "district", "political_actors", "department", "scheme"))], F.lit(5))
    at = Window.partitionBy("raw_item_id").orderBy(order, "id")
    return t.item_entities.select("raw_item_id", "entity_id", F.row_number().over(at).alias("rank")).where("rank <= 4")


@query("""SELECT raw_item_id, count(*) AS superseded FROM item_entities e WHERE resolver_version = 'resolver-v0' AND raw_item_id IN (SELECT raw_item_id FROM item_entities WHERE resolver_version = 'resolver-v1') GROUP BY 1""")
def set6_superseded_edges(t: Tables) -> DataFrame:
    """Edges of an older resolver on items that a newer one has seen."""
    per = t.item_entities.groupBy("raw_item_id").agg(F.count_if(F.col("resolver_version") == "resolver-v0").alias("superseded"), F.count_if(F.col("resolver_version") == "resolver-v1").alias("_new"))
    return per.where("superseded > 0 and _new > 0").drop("_new")


@query("SELECT party, count(*) AS seats FROM entities WHERE entity_type = 'person' AND role = 'mla' GROUP BY 1 ORDER BY seats DESC, party")
def agg19_party_seats(t: Tables) -> DataFrame:
    return t.entities.where("entity_type = 'person' and role = 'mla'").groupBy("party").agg(F.count("*").alias("seats")).orderBy(F.desc("seats"), "party")


@query("""SELECT d.canonical_name AS district, coalesce(string_agg(p.canonical_name, '; ' ORDER BY p.canonical_name, p.id), '') AS members FROM entities d
 LEFT JOIN entities p ON p.entity_type = 'person' AND p.role = 'mla' AND lower(trim(p.district)) = lower(trim(d.canonical_name)) WHERE d.entity_type = 'district' GROUP BY 1""")
def jn15_roster(t: Tables) -> DataFrame:
    people = t.entities.where("entity_type = 'person' and role = 'mla'").select("id", F.col("canonical_name").alias("name"), F.lower(F.trim("district")).alias("key"))
    grouped = people.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "id"))), lambda s: s["name"]), "; ").alias("members"))
    districts = t.entities.where("entity_type = 'district'").select(F.col("canonical_name").alias("district"), F.lower(F.trim("canonical_name")).alias("key"))
    return districts.join(grouped, "key", "left").select("district", F.coalesce("members", F.lit("")).alias("members"))
