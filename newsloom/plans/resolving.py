"""Queries on entities as a writer keeps them, dossiers, scorecards and the brief."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import cards as cd
from ..operators import graph as g
from ..operators import places as pl
from ..operators import resolver as rs
from ..operators import retrieval as rt
from ..session import stored
from .analyses import GATED, GRAPH_BEST
from .graph import COUNTS, KINDS, MENTIONS, fav
from .registry import Tables, query
from .rulings import CARDS, SPACES, item_cards

def key_of(e: str) -> str:
    """The key of a name, for DuckDB."""
    return "trim(regexp_replace(regexp_replace(lower(nfc_normalize(" + e + r")), '[.’''\x{200B}]', '', 'g'), '" + SPACES + "', ' ', 'g'), ' -–—:;,&')"


def slug_of(e: str) -> str:
    return rf"regexp_replace(regexp_replace({e}, '[^\p{{L}}\p{{M}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"


INDEX = f"(SELECT key, entity_id, slug FROM (SELECT {key_of('a.alias')} AS key, a.id, a.entity_id, e.slug FROM entity_aliases a JOIN entities e ON e.id = a.entity_id WHERE e.status <> 'candidate') WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY entity_id, id) = 1)"
SAID = f"""(SELECT DISTINCT raw_item_id, analysis_id, field, trim(surface) AS surface FROM (WITH b AS (SELECT b.id AS analysis_id, b.*, r.source_name FROM {GRAPH_BEST} b JOIN raw_items r ON r.id = b.raw_item_id)
 SELECT raw_item_id, analysis_id, 'source' AS field, source_name AS surface FROM b UNION ALL SELECT raw_item_id, analysis_id, 'political_actors', unnest(political_actors) FROM b UNION ALL SELECT raw_item_id, analysis_id, 'district', district FROM b
 UNION ALL SELECT raw_item_id, analysis_id, 'department', department FROM b UNION ALL SELECT raw_item_id, analysis_id, 'scheme', scheme FROM b) WHERE trim(coalesce(surface, '')) <> '')"""
EDGES = rf"""(WITH i AS {INDEX}, s AS (SELECT *, {key_of('surface')} AS key FROM {SAID}), f AS (SELECT s.*, coalesce(i.entity_id, j.entity_id) AS entity_id, coalesce(i.slug, j.slug) AS found FROM s LEFT JOIN i ON i.key = s.key LEFT JOIN i j ON j.key = trim(regexp_replace(s.key, '\s*\([^)]*\)\s*$', '')))
 SELECT raw_item_id, analysis_id, field, surface, entity_id, CASE WHEN entity_id IS NOT NULL THEN 'resolved' WHEN field = 'source' THEN 'source' ELSE 'candidate' END AS state,
 coalesce(found, CASE WHEN field = 'source' THEN 'source-' ELSE 'candidate-' END || {slug_of('key')}) AS slug FROM f WHERE (field = 'source' OR key NOT IN {rs.GENERIC}) AND (field <> 'district' OR entity_id IS NOT NULL))"""


def edges(t: Tables) -> DataFrame:
    return rs.resolved(rs.surfaces(t.raw_items, t.ai_analysis), rs.alias_index(t.entities, t.entity_aliases))


@query(f"SELECT id, {key_of('surface')} AS key FROM item_entities")
def str4_surface_keys(t: Tables) -> DataFrame:
    return t.item_entities.select("id", x.surface_key("surface").alias("key"))


@query(f"SELECT raw_item_id, analysis_id, field, surface FROM {SAID}")
def ent2_surfaces(t: Tables) -> DataFrame:
    """What items and their current analyses name."""
    return rs.surfaces(t.raw_items, t.ai_analysis)


@query(f"SELECT raw_item_id, field, surface, state, slug FROM {EDGES}")
def ent3_resolved_edges(t: Tables) -> DataFrame:
    """Every name with the entity it leads to, or the candidate it makes."""
    return edges(t).select("raw_item_id", "field", "surface", "state", "slug")


ORDER = "CASE field " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(rs.FIELDS)) + " END"
TYPE = "CASE field " + " ".join(f"WHEN '{f}' THEN '{k}'" for f, k in rs.TYPES.items()) + " END"
MADE = f"(SELECT slug, {TYPE} AS entity_type, surface AS canonical_name, CASE WHEN state = 'source' THEN 'active' ELSE 'candidate' END AS status, n FROM (SELECT *, count(*) OVER (PARTITION BY slug) AS n, row_number() OVER (PARTITION BY slug ORDER BY raw_item_id, {ORDER}, surface) AS r FROM {EDGES} WHERE state <> 'resolved') WHERE r = 1)"


@query(f"SELECT slug, entity_type, canonical_name, status, n FROM {MADE}")
def ent3_candidates(t: Tables) -> DataFrame:
    return rs.candidates(edges(t))


@query(f"""WITH s AS (SELECT * FROM (SELECT 'source-' || {slug_of(key_of('source_name'))} AS slug, trim(source_name) AS name FROM (SELECT DISTINCT source_name FROM raw_items WHERE trim(coalesce(source_name, '')) <> '')) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY name DESC) = 1)
 SELECT coalesce(e.slug, s.slug) AS slug, coalesce(e.entity_type, 'source') AS entity_type, coalesce(s.name, e.canonical_name, '') AS canonical_name, CASE WHEN e.status = 'active' OR s.slug IS NOT NULL THEN 'active' ELSE e.status END AS status FROM entities e FULL JOIN s ON s.slug = e.slug""")
def ent1_synced_sources(t: Tables) -> DataFrame:
    """The entities after every source was merged in."""
    return rs.synced(t.entities, rs.source_seeds(t.raw_items)).select("slug", "entity_type", "canonical_name", "status")


OLD = "(SELECT DISTINCT i.raw_item_id, e.slug, i.mention_field AS field, trim(i.surface) AS surface, i.analysis_id FROM item_entities i JOIN entities e ON e.id = i.entity_id)"
CHANGES = f"""(WITH n AS (SELECT DISTINCT raw_item_id, slug, field, surface, analysis_id FROM {EDGES}), c AS (SELECT DISTINCT raw_item_id, analysis_id FROM n), o AS (SELECT o.*, CASE WHEN c.analysis_id IS NOT NULL AND o.analysis_id IS NOT NULL AND o.analysis_id <> c.analysis_id THEN 'replaced' ELSE 'kept' END AS change FROM {OLD} o LEFT JOIN c ON c.raw_item_id = o.raw_item_id)
 SELECT * FROM o UNION ALL SELECT n.raw_item_id, n.slug, n.field, n.surface, n.analysis_id, 'created' FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.change = 'kept' AND o.raw_item_id = n.raw_item_id AND o.slug = n.slug AND o.field = n.field AND o.surface = n.surface))"""


def changes(t: Tables) -> DataFrame:
    slugs = t.entities.select(F.col("id").alias("entity_id"), "slug")
    old = t.item_entities.join(slugs, "entity_id").select("raw_item_id", "slug", F.col("mention_field").alias("field"), F.trim("surface").alias("surface"), "analysis_id").distinct()
    return rs.maintained(old, stored(edges(t), "edges"))


@query(f"SELECT change, count(*) AS n, count(DISTINCT raw_item_id) AS items FROM {CHANGES} GROUP BY 1")
def ent4_edge_changes(t: Tables) -> DataFrame:
    """What keeping one view per item changes."""
    return changes(t).groupBy("change").agg(F.count("*").alias("n"), F.count_distinct("raw_item_id").alias("items"))


@query(f"SELECT raw_item_id, slug, field, surface, analysis_id FROM {CHANGES} WHERE change <> 'replaced'")
def set6_current_edges(t: Tables) -> DataFrame:
    """The edges after superseded ones are gone."""
    return changes(t).where("change <> 'replaced'").drop("change")


@query(f"SELECT count(*) FILTER (status = 'candidate') AS candidates, count(*) FILTER (status = 'active') AS new_sources, coalesce(sum(n), 0)::BIGINT AS mentions FROM {MADE}")
def ent16_resolve_counts(t: Tables) -> DataFrame:
    return rs.candidates(edges(t)).agg(F.count_if(F.col("status") == "candidate").alias("candidates"), F.count_if(F.col("status") == "active").alias("new_sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"))


@query("SELECT e.slug, h.slug AS holder FROM entities e LEFT JOIN entities h ON h.slug = e.metadata_json['holder'] WHERE e.entity_type IN ('person', 'department')")
def jn17_holders(t: Tables) -> DataFrame:
    """The entity that holds an office, where the office names one."""
    holders = t.entities.select(F.col("slug").alias("holder"), F.col("slug").alias("_h"))
    rows = t.entities.where("entity_type in ('person', 'department')").select("slug", F.col("metadata_json")["holder"].alias("_h"))
    return rows.join(holders, "_h", "left").select("slug", "holder")


M30 = "datediff('day', day, as_of) <= 30"
TOPS = "SELECT slug, string_agg({0}, '; ' ORDER BY n DESC, {0}) AS {1} FROM (SELECT slug, {0}, count(*) AS n, row_number() OVER (PARTITION BY slug ORDER BY count(*) DESC, {0}) AS r FROM {2} WHERE coalesce({0}, '') NOT IN ('', 'unspecified', 'unknown') GROUP BY 1, 2) WHERE r <= {3} GROUP BY 1"
DOSSIERS = f"""(WITH l AS (SELECT max(day) AS as_of FROM {GATED}), m AS (SELECT m.*, b.cat FROM {MENTIONS} m JOIN (SELECT id, lower(trim(coalesce(issue_category, ''))) AS cat FROM ai_analysis) b ON b.id = m.analysis_id),
 c AS (SELECT slug, canonical_name AS name, entity_type, count(*) AS mentions, count(*) FILTER ({M30}) AS mentions_30d, {COUNTS}, count(*) FILTER (portrayal = 'positive' AND {M30}) AS p30, count(*) FILTER (portrayal = 'negative' AND {M30}) AS n30, count(*) FILTER (severity_rank >= 3) AS severe FROM m CROSS JOIN l GROUP BY 1, 2, 3),
 k AS ({TOPS.format('cat', 'top_categories', 'm', 4)}), d AS ({TOPS.format('district', 'top_districts', 'm', 5)})
 SELECT c.slug, name, c.entity_type, coalesce(e.party, '') AS party, mentions, mentions_30d, positive, negative, mixed, neutral, severe, {fav('positive', 'negative')} AS favourability, {fav('p30', 'n30')} AS favourability_30d,
 CASE WHEN greatest(positive, negative, mixed) = 0 THEN 'neutral' WHEN negative >= positive AND negative >= mixed THEN 'negative' WHEN positive >= mixed THEN 'positive' ELSE 'mixed' END AS dominant, coalesce(top_categories, '') AS top_categories, coalesce(top_districts, '') AS top_districts
 FROM c LEFT JOIN k ON k.slug = c.slug LEFT JOIN d ON d.slug = c.slug JOIN entities e ON e.slug = c.slug)"""


def tops(marks: DataFrame, column: str, name: str, most: int) -> DataFrame:
    """(slug, name): the most frequent values of a column, ties by value."""
    counted = marks.where(~F.coalesce(column, F.lit("")).isin("", "unspecified", "unknown")).groupBy("slug", column).agg(F.count("*").alias("n"))
    at = Window.partitionBy("slug").orderBy(F.desc("n"), column)
    return counted.withColumn("r", F.row_number().over(at)).where(F.col("r") <= most).groupBy("slug").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", column))), lambda s: s[column]), "; ").alias(name))


def dossiers(t: Tables) -> DataFrame:
    """What is known of each entity that is mentioned: counts of all and of the last 30 days, favourability, lean, issues, districts."""
    gated = g.gated_items(t)
    categories = t.ai_analysis.select(F.col("id").alias("analysis_id"), F.lower(F.trim(F.coalesce("issue_category", F.lit("")))).alias("cat"))
    marks = stored(g.mentions(t).join(categories, "analysis_id").crossJoin(F.broadcast(g.as_of(gated))), "marks")  # one row
    recent = F.datediff("as_of", "day") <= 30
    two = [F.count_if((F.col("portrayal") == k) & recent).alias(f"{k[0]}30") for k in ("positive", "negative")]
    c = marks.groupBy("slug", F.col("canonical_name").alias("name"), "entity_type").agg(F.count("*").alias("mentions"), F.count_if(recent).alias("mentions_30d"), *[g.count_of(k).alias(k) for k in KINDS], *two, F.count_if(F.col("severity_rank") >= 3).alias("severe"))
    most = F.greatest("negative", "positive", "mixed")
    lean = F.when(most == 0, "neutral").when(F.col("negative") == most, "negative").when(F.col("positive") == most, "positive").otherwise("mixed")
    c = c.withColumns({"favourability": g.favourability(F.col("positive"), F.col("negative")), "favourability_30d": g.favourability(F.col("p30"), F.col("n30")), "dominant": lean}).drop("p30", "n30")
    party = t.entities.select("slug", F.coalesce("party", F.lit("")).alias("party"))
    return c.join(party, "slug").join(tops(marks, "cat", "top_categories", 4), "slug", "left").join(tops(marks, "district", "top_districts", 5), "slug", "left").na.fill("", ["top_categories", "top_districts"])


@query(f"SELECT * FROM {DOSSIERS}")
def ent7_dossiers(t: Tables) -> DataFrame:
    return dossiers(t)


@query(f"SELECT slug, mentions_30d, mentions, favourability, dominant FROM {DOSSIERS} WHERE entity_type = 'person' AND mentions >= 2 ORDER BY mentions_30d DESC, mentions DESC, name LIMIT 12")
def srt6_scorecards(t: Tables) -> DataFrame:
    """Persons by recent, then all mentions, then name."""
    kept = dossiers(t).where("entity_type = 'person' and mentions >= 2")
    return kept.orderBy(F.desc("mentions_30d"), F.desc("mentions"), "name").limit(12).select("slug", "mentions_30d", "mentions", "favourability", "dominant")


@query(f"""SELECT slug, '- ' || name || CASE WHEN party <> '' THEN ' (' || party || ')' ELSE '' END || ': ' || mentions || ' mentions (' || mentions_30d || ' in 30 days), favourability ' || coalesce(favourability::VARCHAR, 'n/a') || ', ' || dominant
 || CASE WHEN top_categories <> '' THEN '; issues: ' || top_categories ELSE '' END || CASE WHEN top_districts <> '' THEN '; districts: ' || top_districts ELSE '' END AS line FROM {DOSSIERS}""")
def ent11_dossier_lines(t: Tables) -> DataFrame:
    """A line on each entity, as a chat is given it."""
    return dossiers(t).withColumn("co_mentions", F.lit("")).select("slug", rt.dossier_line().alias("line"))


@query(f"SELECT slug, mentions, severe, positive, negative, mixed, neutral, top_categories FROM {DOSSIERS}")
def agg20_severe_and_categories(t: Tables) -> DataFrame:
    return dossiers(t).select("slug", "mentions", "severe", *KINDS, "top_categories")


@query(f"""WITH p AS (SELECT count(*) AS n, {COUNTS} FROM {GATED}), m AS (SELECT slug, count(*) AS n, count(*) FILTER (portrayal = 'negative') AS neg FROM {MENTIONS} WHERE entity_type <> 'source' GROUP BY 1 ORDER BY n DESC, slug LIMIT 10),
 d AS (SELECT slug, count(*) AS n, count(*) FILTER (portrayal = 'negative') AS neg FROM {MENTIONS} WHERE entity_type = 'district' GROUP BY 1 ORDER BY neg DESC, n DESC, slug LIMIT 8)
 SELECT 'pulse' AS part, 'items' AS name, n, negative AS negative FROM p UNION ALL SELECT 'leader', slug, n, neg FROM m UNION ALL SELECT 'district', slug, n, neg FROM d""")
def agg21_home(t: Tables) -> DataFrame:
    """The front page: the pulse, ten leaders by mentions, eight districts by negative items."""
    pulse = g.gated_items(t).agg(F.lit("pulse").alias("part"), F.lit("items").alias("name"), F.count("*").alias("n"), g.count_of("negative").alias("negative"))
    counted = stored(g.mentions(t).groupBy("slug", "entity_type").agg(F.count("*").alias("n"), g.count_of("negative").alias("negative")), "counted")
    leaders = counted.where("entity_type <> 'source'").orderBy(F.desc("n"), "slug").limit(10).select(F.lit("leader").alias("part"), F.col("slug").alias("name"), "n", "negative")
    districts = counted.where("entity_type = 'district'").orderBy(F.desc("negative"), F.desc("n"), "slug").limit(8).select(F.lit("district").alias("part"), F.col("slug").alias("name"), "n", "negative")
    return pulse.union(leaders).union(districts)


BUSIEST = f"(SELECT arg_max(day, n * 100000 + datediff('day', DATE '1970-01-01', day)) AS as_of FROM (SELECT day, count(*) AS n FROM {MENTIONS} GROUP BY 1))"
WATCHED = f"(SELECT m.* FROM {MENTIONS} m JOIN entities e ON e.slug = m.slug WHERE e.status = 'active' AND m.entity_type IN {g.WATCHED})"
SPIKES = f"""(WITH l AS {BUSIEST}, a AS (SELECT m.*, datediff('day', m.day, as_of) AS age FROM {WATCHED} m CROSS JOIN l), d AS (SELECT slug, age, count(*) AS n, count(*) FILTER (portrayal = 'negative') AS neg, count(*) FILTER (severity_rank >= 3) AS sev FROM a WHERE age BETWEEN 0 AND 12 GROUP BY 1, 2),
 s AS (SELECT slug, coalesce(sum(n) FILTER (age < 3), 0) AS recent, coalesce(sum(neg) FILTER (age < 3), 0) AS recent_negative, coalesce(sum(sev) FILTER (age < 3), 0) AS severe, coalesce(sum(n) FILTER (age >= 3), 0) / 10.0::DOUBLE AS mean_daily, coalesce(sum(n * n) FILTER (age >= 3), 0) / 10.0::DOUBLE AS sq FROM d GROUP BY 1),
 z AS (SELECT *, (recent / 3.0::DOUBLE - mean_daily) / greatest(sqrt(greatest(sq - mean_daily * mean_daily, 0)), 0.75) AS z, recent_negative / recent::DOUBLE AS share FROM s WHERE recent >= 2)
 SELECT slug, recent::BIGINT AS recent, recent_negative::BIGINT AS recent_negative, severe::BIGINT AS severe, round(mean_daily, 6) AS mean_daily, round(z, 6) AS z, share >= 0.3 AS is_threat,
 round(CASE WHEN share >= 0.3 THEN 10 ELSE 0 END + z * (0.5 + share) * (1 + severe), 6)::DOUBLE AS score FROM z WHERE z >= 0.2 ORDER BY score DESC, slug LIMIT 20)"""


@query(f"SELECT * FROM {SPIKES}")
def ent8_spikes(t: Tables) -> DataFrame:
    """Surges up to the busiest day, the highest scores first, twenty at most; thresholds low enough for the thin test tables, as parameters."""
    marks = g.mentions(t)
    day = marks.groupBy("day").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "day"))["day"].alias("as_of"))
    watched = marks.where(F.col("entity_type").isin(*g.WATCHED) & (F.col("status") == "active")).join(F.broadcast(day), F.col("day") <= F.col("as_of")).drop("as_of")
    return g.spikes(watched, day, least=2, z_least=0.2).drop("entity_id").orderBy(F.desc("score"), "slug").limit(20)


FAVOUR = f"(SELECT count(*) FILTER (portrayal = 'positive') AS p, count(*) FILTER (portrayal = 'negative') AS n FROM {GATED})"
RISK = f"""(SELECT raw_item_id, CASE lower(coalesce(nullif(action_priority, ''), severity, '')) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS pr, coalesce(needs_human_review, FALSE)::INT AS rv FROM {CARDS} WHERE category IN ('negative', 'people'))"""


@query(f"""WITH f AS (SELECT {fav('p', 'n')} AS fv, p, n FROM {FAVOUR}), s AS (SELECT * FROM {SPIKES} ORDER BY is_threat DESC, score DESC, slug LIMIT 1), a AS (SELECT k.raw_item_id, i.title, coalesce(i.published_at, i.ingested_at) AS seen, pr, rv FROM {RISK} k JOIN raw_items i ON i.id = k.raw_item_id WHERE pr >= 3 OR rv = 1 ORDER BY pr + rv DESC, pr DESC, seen DESC NULLS LAST, k.raw_item_id DESC LIMIT 1),
 h AS (SELECT district_canonical AS d, count(*) FILTER (category IN ('negative', 'people')) AS c FROM {CARDS} WHERE district_canonical IS NOT NULL GROUP BY 1 ORDER BY c DESC, d LIMIT 1), r AS (SELECT * FROM {DOSSIERS} d WHERE entity_type = 'person' AND mentions >= 2 AND NOT coalesce((SELECT is_tvk FROM entities e WHERE e.slug = d.slug), FALSE) ORDER BY mentions_30d DESC, mentions DESC, name LIMIT 1)
 SELECT 1 AS place, 'standing' AS kind, CASE WHEN fv >= 55 THEN 'good' WHEN fv <= 45 THEN 'bad' ELSE 'watch' END AS tone, 'Standing: ' || fv || '/100' AS title FROM f WHERE p + n > 0 UNION ALL SELECT 2, 'signal', CASE WHEN is_threat THEN 'bad' ELSE 'watch' END, 'Surge: ' || slug FROM s
 UNION ALL SELECT 3, 'alert', 'bad', 'Act now: ' || substr(coalesce(title, ''), 1, 90) FROM a UNION ALL SELECT 4, 'hotspot', 'watch', 'Hotspot: ' || d || ' (' || c || ')' FROM h WHERE c > 0 UNION ALL SELECT 5, 'rival', 'watch', 'Rival: ' || name || ', favourability ' || coalesce(favourability::VARCHAR, 'n/a') FROM r""")
def ent13_brief_lines(t: Tables) -> DataFrame:
    """The few lines of a daily brief: standing, signal, alert, hotspot, rival; a line without ground is left out."""
    one = lambda df, place, kind, tone, title: df.select(F.lit(place).alias("place"), F.lit(kind).alias("kind"), tone.alias("tone"), title.alias("title"))
    f = g.gated_items(t).agg(g.count_of("positive").alias("p"), g.count_of("negative").alias("n")).where("p + n > 0").withColumn("fv", g.favourability(F.col("p"), F.col("n")))
    standing = one(f, 1, "standing", F.when(F.col("fv") >= 55, "good").when(F.col("fv") <= 45, "bad").otherwise("watch"), F.concat(F.lit("Standing: "), F.col("fv").cast("string"), F.lit("/100")))
    s = ent8_spikes(t).orderBy(F.desc("is_threat"), F.desc("score"), "slug").limit(1)
    signal = one(s, 2, "signal", F.when(F.col("is_threat"), "bad").otherwise("watch"), F.concat(F.lit("Surge: "), "slug"))
    cards = stored(item_cards(t), "cards")
    times = t.raw_items.select(F.col("id").alias("raw_item_id"), "title", F.coalesce("published_at", "ingested_at").alias("at"))
    first = cd.alerts(cards.where(F.col("category").isin("negative", "people")).join(times, "raw_item_id"), 1)
    alert = one(first, 3, "alert", F.lit("bad"), F.concat(F.lit("Act now: "), F.substring(F.coalesce("title", F.lit("")), 1, 90)))
    hot = cards.where("district_canonical is not null").groupBy("district_canonical").agg(F.count_if(F.col("category").isin("negative", "people")).alias("c")).orderBy(F.desc("c"), "district_canonical").limit(1).where("c > 0")
    hotspot = one(hot, 4, "hotspot", F.lit("watch"), F.concat(F.lit("Hotspot: "), "district_canonical", F.lit(" ("), F.col("c").cast("string"), F.lit(")")))
    others = t.entities.where("not coalesce(is_tvk, false)").select("slug")
    r = dossiers(t).where("entity_type = 'person' and mentions >= 2").join(others, "slug", "left_semi").orderBy(F.desc("mentions_30d"), F.desc("mentions"), "name").limit(1)
    rival = one(r, 5, "rival", F.lit("watch"), F.concat(F.lit("Rival: "), "name", F.lit(", favourability "), F.coalesce(F.col("favourability").cast("string"), F.lit("n/a"))))
    return standing.union(signal).union(alert).union(hotspot).union(rival)


@query()
def ent14_dossier_pages(t: Tables) -> DataFrame:
    """A page on each entity: front matter, line of counts, links."""
    from ..sources.pages_out import dossier_page

    return dossiers(t).select("slug", dossier_page().alias("page"))


@query(f"SELECT raw_item_id, slug, strftime(day, '%Y-%m-%d') AS day, portrayal, severity_rank, source_name FROM {MENTIONS} WHERE entity_type <> 'source'")
def prj9_evidence_rows(t: Tables) -> DataFrame:
    """What a dossier shows of an item."""
    return g.mentions(t).where("entity_type <> 'source'").select("raw_item_id", "slug", F.date_format("day", "yyyy-MM-dd").alias("day"), "portrayal", "severity_rank", "source_name")


__all__ = ["pl"]
