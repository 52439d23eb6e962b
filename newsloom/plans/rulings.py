"""Queries on the rule analyzer, districts, departments and who is responsible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import analyzer as a
from ..operators import places as pl
from ..operators.current import current_analyses, relevant, severity_rank, subject_portrayal
from .analyses import GATE, GRAPH_BEST, PORTRAYAL
from .registry import Tables, query

L = a.Lens()
EDGE, SPACES = r"[^\p{L}\p{N}_]", r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def items(t: Tables) -> DataFrame:
    return t.raw_items.select(F.col("id").alias("raw_item_id"), "title", F.col("clean_text_original").alias("body"), F.col("source_url").alias("url"))


def has(terms: a.Terms, text: str = "txt") -> str:
    """Whether terms are found, for DuckDB."""
    parts = []
    if terms.words:
        parts.append(f"regexp_matches(lower({text}), '(^|{EDGE})({terms.word_pattern()})($|{EDGE})')")
    if terms.parts:
        parts.append(f"regexp_matches({text}, '{terms.part_pattern()}')")
    return "(" + (" OR ".join(parts) or "FALSE") + ")"


TEXTS = "(SELECT id AS raw_item_id, coalesce(title, '') AS ti, coalesce(clean_text_original, '') AS bo, lower(coalesce(source_url, '')) AS url, coalesce(title, '') || chr(10) || coalesce(clean_text_original, '') AS txt FROM raw_items)"
LISTING = f"(length(trim(bo)) < 160 OR regexp_matches(lower(ti), '{'|'.join(L.listing_titles)}') OR length(regexp_replace(substr(trim(bo), 1, 1200), '[^!?]', '', 'g')) >= 5)"
HARD = f"(regexp_matches(url, '{'|'.join(L.sections)}') OR {has(L.off_topic)})"
SOFT = f"({HARD} OR {has(L.foreign)} OR {has(L.elsewhere)})"
TAMIL_SHARE = r"coalesce(length(regexp_replace(txt, '[^\x{0B80}-\x{0BFF}]', '', 'g')) / nullif(length(txt), 0)::DOUBLE, 0)"
SCOPE = f"(NOT {HARD} AND ({has(L.places)} OR regexp_matches(txt, '(^|{EDGE})({'|'.join(L.ambiguous)})($|{EDGE})') OR ({TAMIL_SHARE} >= 0.3 AND NOT {SOFT})))"
PEOPLE = f"(NOT {SOFT} AND ({has(L.danger)} OR ({has(L.civic)} AND {has(L.problem)})))"


def profile(part: str, rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(i.terms)} THEN '{getattr(i, part)}'" for i in L.issues) + f" ELSE '{rest}' END"


@query(f"SELECT raw_item_id, {LISTING} AS listing FROM {TEXTS}")
def cls1_listing_pages(t: Tables) -> DataFrame:
    return items(t).select("raw_item_id", a.Rules(L).listing().alias("listing"))


@query(f"SELECT raw_item_id, {HARD} AS hard, {SOFT} AS soft FROM {TEXTS}")
def cls2_out_of_scope(t: Tables) -> DataFrame:
    """Hard: never in scope. Soft: hard, foreign or of another place."""
    r = a.Rules(L)
    return items(t).select("raw_item_id", r.hard_out().alias("hard"), r.soft_out().alias("soft"))


@query(f"SELECT raw_item_id, {SCOPE} AS in_scope FROM {TEXTS}")
def cls4_in_scope(t: Tables) -> DataFrame:
    return items(t).select("raw_item_id", a.Rules(L).in_scope().alias("in_scope"))


@query(f"SELECT raw_item_id, {PEOPLE} AS people_issue FROM {TEXTS}")
def cls5_people_issues(t: Tables) -> DataFrame:
    return items(t).select("raw_item_id", a.Rules(L).people_issue().alias("people_issue"))


@query(f"SELECT raw_item_id, {profile('category', 'concern')} AS category, {profile('name', 'public concern')} AS issue, {profile('severity', 'low')} AS severity, {profile('action', 'monitor')} AS action FROM {TEXTS}")
def cls6_issue_profiles(t: Tables) -> DataFrame:
    p = items(t).select("raw_item_id", a.Rules(L).profile().alias("p"))
    return p.select("raw_item_id", "p.category", "p.issue", "p.severity", "p.action")


NAMED = ", ".join(f"CASE WHEN {has(terms)} THEN '{label}' END" for label, terms in [*L.actors, *L.persons])


@query(f"SELECT raw_item_id, array_to_string(list_slice(list_filter([{NAMED}], lambda n: n IS NOT NULL), 1, 10), '; ') AS actors FROM {TEXTS}")
def cls7_actors(t: Tables) -> DataFrame:
    """Groups and persons that a text names, in the order of the lists, ten at most."""
    return items(t).select("raw_item_id", F.array_join(a.Rules(L).actors(), "; ").alias("actors"))


FLAGS = f"""(SELECT *, {has(L.good)} AS good, {has(L.bad)} AS bad, {has(L.subject)} AS subj, {has(L.government)} AS gov, {PEOPLE} AS people FROM {TEXTS})"""
STANCE = "CASE WHEN good AND bad THEN 'mixed' WHEN good THEN 'positive' WHEN bad THEN 'negative' ELSE 'neutral' END"
RELEVANCE = "CASE WHEN gov THEN 'high' WHEN subj THEN 'medium' ELSE 'low' END"
SUBJECT = "CASE WHEN gov OR subj THEN 'high' WHEN people THEN 'medium' ELSE 'low' END"
OWNER = "CASE WHEN subj THEN 'leadership office' WHEN people THEN 'field team' WHEN gov THEN 'policy team' ELSE 'monitoring desk' END"
ACTION = f"CASE WHEN subj AND {STANCE} = 'negative' THEN 'internal_review' WHEN people THEN 'field_verification' WHEN {STANCE} = 'positive' THEN 'amplify' ELSE 'monitor' END"


@query(f"SELECT raw_item_id, {STANCE} AS stance FROM {FLAGS}")
def cls8_stance(t: Tables) -> DataFrame:
    return items(t).select("raw_item_id", a.Rules(L).stance().alias("stance"))


@query(f"SELECT raw_item_id, {RELEVANCE} AS relevance, {SUBJECT} AS subject_relevance, {OWNER} AS owner, {ACTION} AS action FROM {FLAGS}")
def cls9_relevance_and_routing(t: Tables) -> DataFrame:
    r, c = a.Rules(L), F.col
    flags = items(t).select("raw_item_id", L.government.found(r.text).alias("gov"), L.subject.found(r.text).alias("subj"), r.people_issue().alias("people"), r.stance().alias("stance"))
    return flags.select(
        "raw_item_id", a.relevance(c("gov"), c("subj")).alias("relevance"), a.subject_relevance(c("gov"), c("subj"), c("people"), True).alias("subject_relevance"),
        a.action_owner(c("subj"), c("people"), c("gov")).alias("owner"), a.action_type(c("stance"), c("subj"), c("people")).alias("action"),
    )


FIRST = r"trim(regexp_extract(regexp_replace(bo, '^\s+|\s+$', '', 'g'), '^((?s:.*?)[.!?।。])\s|^([^\n]*)\n|^((?s:.*))$', 0))"


@query(f"""WITH f AS (SELECT *, CASE WHEN {LISTING} THEN 'listing' WHEN NOT {SCOPE} THEN 'out-of-scope' END AS gate, {profile('category', 'concern')} AS cat, {profile('name', 'public concern')} AS iss, {profile('severity', 'low')} AS sev, {profile('owner', 'monitoring desk')} AS own FROM {FLAGS})
 SELECT raw_item_id, gate, CASE WHEN gate IS NULL THEN {RELEVANCE} ELSE 'none' END AS government_relevance, CASE WHEN gate IS NULL THEN {STANCE} ELSE 'neutral' END AS stance,
 CASE WHEN gate IS NULL AND {STANCE} IN ('positive','negative') THEN {STANCE} ELSE 'neutral' END AS sentiment, CASE WHEN gate IS NULL THEN {SUBJECT} ELSE 'none' END AS subject_relevance,
 CASE WHEN gate IS NULL AND (subj OR gov) THEN {STANCE} ELSE 'neutral' END AS portrayal, gate IS NULL AND people AS people_issue, coalesce(gate, CASE WHEN people THEN cat ELSE 'general' END) AS issue_category,
 CASE WHEN gate IS NULL AND people THEN iss ELSE '' END AS public_issue, CASE WHEN gate IS NULL AND people THEN sev ELSE 'low' END AS severity,
 CASE WHEN gate IS NOT NULL THEN '' WHEN people THEN own ELSE {OWNER} END AS action_owner, CASE WHEN gate IS NULL THEN {ACTION} ELSE 'monitor' END AS action_type,
 CASE WHEN gate IS NULL AND people THEN sev ELSE 'low' END AS action_priority, CASE WHEN gate IS NULL THEN 0.72 ELSE 0.25 END::DOUBLE AS confidence,
 gate IS NULL AND ((people AND sev IN ('high','critical')) OR {STANCE} = 'mixed') AS needs_human_review,
 CASE WHEN gate IS NULL AND people THEN 'Reported: ' || iss || '; its cause is to be checked on the spot.' ELSE '' END AS root_cause FROM f""")
def cls11_full_record(t: Tables) -> DataFrame:
    """The record of the analyzer for every item; texts, lists and templates are left to the tests."""
    out = a.analyze(items(t), L)
    return out.select("raw_item_id", "gate", "government_relevance", "stance", "sentiment", "subject_relevance", "portrayal", "people_issue", "issue_category", "public_issue", "severity", "action_owner", "action_type", "action_priority", F.col("confidence").cast("double").alias("confidence"), "needs_human_review", "root_cause")


@query()
def cls22_templates(t: Tables) -> DataFrame:
    """What the templates make of each item: focus, next step, what to verify, summary and points."""
    return a.analyze(items(t), L).select("raw_item_id", "focus", "next_step", "verify", "summary", "positive_points", "negative_points", "actors")


S = a.SECOND
SECOND_FLAGS = f"(SELECT *, {has(S.good)} AS good, {has(S.bad)} AS bad, {has(S.subject)} AS subj, {has(S.government)} AS gov, NOT {SOFT} AND ({has(S.danger)} OR ({has(S.civic)} AND {has(S.problem)})) AS people FROM {TEXTS})"


@query(f"""WITH f AS (SELECT *, {LISTING} OR NOT {SCOPE} AS stopped FROM {SECOND_FLAGS}) SELECT raw_item_id, CASE WHEN stopped THEN 'neutral' ELSE {STANCE} END AS stance,
 CASE WHEN stopped THEN 'none' WHEN subj THEN 'high' WHEN gov OR people THEN 'medium' ELSE 'low' END AS subject_relevance, CASE WHEN stopped THEN 0.25 ELSE 0.65 END::DOUBLE AS confidence FROM f""")
def cls12_second_analyzer(t: Tables) -> DataFrame:
    out = a.analyze(items(t), a.SECOND)
    return out.select("raw_item_id", "stance", "subject_relevance", F.col("confidence").cast("double").alias("confidence"))


def latest_of(model: str) -> str:
    return f"(SELECT raw_item_id, stance_toward_government AS stance FROM ai_analysis WHERE model_name = '{model}' QUALIFY row_number() OVER (PARTITION BY raw_item_id ORDER BY id DESC) = 1)"


@query(f"""SELECT f.raw_item_id, coalesce(m.stance, n.stance, {STANCE}) AS stance, CASE WHEN m.stance IS NOT NULL THEN 'local-13b' WHEN n.stance IS NOT NULL THEN 'local-7b' ELSE 'rules' END AS tier
 FROM {FLAGS} f LEFT JOIN {latest_of('local-13b')} m ON m.raw_item_id = f.raw_item_id LEFT JOIN {latest_of('local-7b')} n ON n.raw_item_id = f.raw_item_id""")
def cls13_cascade(t: Tables) -> DataFrame:
    """The stance of the first tier that has one: two models in the order of TIERS, then the rules."""
    made = [(m, current_analyses(t.ai_analysis.where(F.col("model_name") == m), "latest_id").select("raw_item_id", F.col("stance_toward_government").alias("stance")).join(t.raw_items.select(F.col("id").alias("raw_item_id")), "raw_item_id", "left_semi")) for m in a.TIERS[:-1]]
    rules = items(t).select("raw_item_id", a.Rules(L).stance().alias("stance"))
    return a.cascade([*made, ("rules", rules)], "raw_item_id", "stance")


@query("SELECT * FROM (VALUES (1, 'local-13b'), (2, 'local-7b'), (3, 'rules')) v(place, tier)")
def cls26_tiers(t: Tables) -> DataFrame:
    """Which analyzers are asked, and in which order."""
    return t.raw_items.sparkSession.createDataFrame(list(enumerate(a.TIERS, 1)), "place int, tier string")


FOLDED_DISTRICT = r"nullif(trim(regexp_replace(regexp_replace(lower(trim({0})), ' district$', ''), ' மாவட்டம்$', '')), '')"
NO_DISTRICT = "('', 'unspecified', 'unknown', 'statewide', 'general', 'none', 'n/a')"
KNOWN = f"""(SELECT alias, min(district) AS district FROM (SELECT {FOLDED_DISTRICT.format('a.alias')} AS alias, e.canonical_name AS district FROM entity_aliases a JOIN entities e ON e.id = a.entity_id WHERE e.entity_type = 'district'
 UNION ALL SELECT {FOLDED_DISTRICT.format('canonical_name')}, canonical_name FROM entities WHERE entity_type = 'district') WHERE alias IS NOT NULL GROUP BY 1)"""


def known(t: Tables) -> DataFrame:
    return pl.district_aliases(t.entities, t.entity_aliases)


@query(f"""WITH k AS {KNOWN}, d AS MATERIALIZED (SELECT doc_id, lower(coalesce(title, '')) AS ti, lower(coalesce(text, '')) AS bo FROM documents),
 n AS MATERIALIZED (SELECT doc_id, part, s, ' ' || regexp_replace(s, '{EDGE}', ' ', 'g') || ' ' AS w FROM (SELECT doc_id, 1 AS part, ti AS s FROM d UNION ALL SELECT doc_id, 2, bo FROM d)), q AS MATERIALIZED (SELECT *, regexp_matches(alias, '^[\\x00-\\x7F]+$') AS latin FROM k),
 p AS (SELECT doc_id, part, CASE WHEN latin THEN strpos(w, ' ' || alias || ' ') ELSE strpos(s, alias) END AS pos, -length(alias) AS len, district FROM n JOIN q ON CASE WHEN latin THEN contains(w, ' ' || alias || ' ') ELSE contains(s, alias) END),
 f AS (SELECT doc_id, arg_min(district, part * 1000000000000 + pos * 1000 + 500 + len) AS district FROM p GROUP BY 1) SELECT d.doc_id, f.district FROM d LEFT JOIN f ON f.doc_id = d.doc_id""")
def cls14_detected_districts(t: Tables) -> DataFrame:
    """The district that a title names first, else the text; all names of the districts are taken."""
    return pl.detected_districts(t.documents.select("doc_id", "title", "text"), known(t), ("title", "text")).select("doc_id", "district")


@query(f"""WITH k AS {KNOWN} SELECT a.id AS analysis_id, coalesce(k.district, l.district) AS district FROM (SELECT id, CASE WHEN {FOLDED_DISTRICT.format('district')} NOT IN {NO_DISTRICT} THEN {FOLDED_DISTRICT.format('district')} END AS f FROM ai_analysis) a
 LEFT JOIN k ON k.alias = a.f LEFT JOIN k l ON l.alias = trim(replace(a.f, '.', ''))""")
def cls15_canonical_districts(t: Tables) -> DataFrame:
    rows = t.ai_analysis.select(F.col("id").alias("analysis_id"), F.col("district").alias("_said"))
    return pl.canonical_districts(rows, "_said", known(t), "district").select("analysis_id", "district")


RULED = " ".join(f"WHEN regexp_matches(lower(c), '{'|'.join(w)}') THEN '{to}'" for w, to in pl.DEPARTMENTS)
CLEAN = f"trim(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(department, ''), '{SPACES}', ' ', 'g')), '(?i)^(?:{'|'.join(pl.PREFIXES)})', ''), '(?i)(?:{'|'.join(pl.ENDINGS)})$', ''))"
DEPARTMENT = f"CASE WHEN lower(c) IN {pl.NO_DEPARTMENT} THEN NULL {RULED} WHEN c = lower(c) OR c = upper(c) THEN array_to_string(list_transform(string_split(lower(c), ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE c END"


@query(f"SELECT id AS analysis_id, {DEPARTMENT} AS department FROM (SELECT id, {CLEAN} AS c FROM ai_analysis)")
def cls16_canonical_departments(t: Tables) -> DataFrame:
    return t.ai_analysis.select(F.col("id").alias("analysis_id"), pl.canonical_department(F.col("department")).alias("department"))


CATEGORY = f"CASE WHEN people_issue AND {PORTRAYAL} = 'neutral' THEN 'people' ELSE {PORTRAYAL} END"
CARDS = f"""(WITH k AS {KNOWN}, b AS (SELECT *, {CATEGORY} AS category, CASE WHEN {FOLDED_DISTRICT.format('district')} NOT IN {NO_DISTRICT} THEN {FOLDED_DISTRICT.format('district')} END AS f, {CLEAN} AS c FROM {GRAPH_BEST} WHERE {GATE} AND raw_item_id IN (SELECT id FROM raw_items))
 SELECT b.*, coalesce(k.district, l.district) AS district_canonical, {DEPARTMENT} AS department_canonical FROM b LEFT JOIN k ON k.alias = b.f LEFT JOIN k l ON l.alias = trim(replace(b.f, '.', '')))"""


def item_cards(t: Tables) -> DataFrame:
    """A card for each relevant item: its current analysis with category and canonical district."""
    names = ("id", "raw_item_id", "model_name", "created_at", "government_relevance", "tvk_portrayal", "stance_toward_government", "people_issue", "public_issue", "department", "district", "severity", "action_priority", "needs_human_review")
    best = current_analyses(t.ai_analysis.select(*names)).where(relevant()).join(t.raw_items.select(F.col("id").alias("raw_item_id")), "raw_item_id", "left_semi")
    category = F.when(F.col("people_issue") & (subject_portrayal() == "neutral"), "people").otherwise(subject_portrayal())
    return pl.canonical_districts(best.withColumn("category", category), "district", known(t))


COUNTS = ", ".join(f"count(*) FILTER (category = '{k}') AS {k}" for k in pl.CATEGORIES)
LEAN = "CASE " + " ".join(f"WHEN {k} > 0 THEN '{k}'" for k in pl.DOMINANT) + " ELSE 'quiet' END"


@query(f"""WITH g AS {CARDS}, d AS (SELECT DISTINCT canonical_name AS district FROM entities WHERE entity_type = 'district' UNION ALL SELECT '<unmapped>'),
 n AS (SELECT coalesce(district_canonical, '<unmapped>') AS district, count(*) AS total, {COUNTS} FROM g GROUP BY 1),
 i AS (SELECT district_canonical AS district, trim(public_issue) AS issue, count(*) AS n, row_number() OVER (PARTITION BY district_canonical ORDER BY count(*) DESC, trim(public_issue)) AS r FROM g WHERE trim(coalesce(public_issue, '')) <> '' AND district_canonical IS NOT NULL GROUP BY 1, 2),
 p AS (SELECT district, string_agg(issue || ' x' || n, '; ' ORDER BY r) AS top_issues FROM i WHERE r <= 3 GROUP BY 1),
 o AS (SELECT d.district, coalesce(total, 0) AS total, {', '.join(f'coalesce({k}, 0) AS {k}' for k in pl.CATEGORIES)}, coalesce(top_issues, '') AS top_issues FROM d LEFT JOIN n ON n.district = d.district LEFT JOIN p ON p.district = d.district)
 SELECT *, {LEAN} AS dominant FROM o""")
def agg7_district_rollup(t: Tables) -> DataFrame:
    districts = t.entities.where("entity_type = 'district'").select(F.col("canonical_name").alias("district")).distinct()
    return pl.district_rollup(item_cards(t), districts)


@query(f"WITH o AS (SELECT department_canonical AS department, count(*) AS total, {COUNTS} FROM {CARDS} WHERE department_canonical IS NOT NULL GROUP BY 1 ORDER BY total DESC, department LIMIT 14) SELECT *, {LEAN} AS dominant FROM o")
def agg8_department_rollup(t: Tables) -> DataFrame:
    return pl.department_rollup(item_cards(t))


OWNERS = " ".join(f"WHEN regexp_matches(q, '{'|'.join(w)}') THEN '{to}'" for w, to in pl.DEPARTMENTS)
TITLE = "array_to_string(list_transform(string_split(lower(trim(department)), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query(f"""WITH m AS (SELECT d.canonical_name AS district, p.canonical_name AS name FROM entities p JOIN entities d ON d.entity_type = 'district' AND lower(trim(d.canonical_name)) = lower(trim(p.district)) WHERE p.entity_type = 'person' AND p.role = 'mla'),
 q AS (SELECT *, lower(coalesce(public_issue, '') || ' ' || coalesce(department, '')) AS q, lower(coalesce(nullif(action_priority, ''), severity, '')) AS prio, coalesce(people_issue, FALSE) OR category IN ('negative', 'people') AS problem FROM {CARDS}),
 o AS (SELECT q.id AS analysis_id, CASE {OWNERS} WHEN lower(trim(coalesce(department, ''))) NOT IN {pl.NO_DEPARTMENT} THEN {TITLE} ELSE '' END AS department_owner, district_canonical, problem, problem AND prio IN ('high', 'critical') AS escalate FROM q)
 SELECT analysis_id, department_owner, coalesce(district_canonical || ' Collector', '') AS district_office, coalesce((SELECT array_to_string(list_slice(list(name ORDER BY name), 1, 6), '; ') FROM m WHERE m.district = o.district_canonical), '') AS members,
 (SELECT count(*) FROM m WHERE m.district = o.district_canonical)::INTEGER AS member_count, escalate, department_owner <> '' OR (district_canonical IS NOT NULL AND problem) OR escalate AS actionable FROM o""")
def cls17_responsibility(t: Tables) -> DataFrame:
    """Who is to act on each relevant item: department, district office, its members, and whether it goes further up."""
    named = t.entities.where("entity_type = 'district'").select(F.col("canonical_name").alias("district"), F.lower(F.trim("canonical_name")).alias("k"))
    people = t.entities.where("entity_type = 'person' and role = 'mla'").select(F.col("canonical_name").alias("name"), F.lower(F.trim("district")).alias("k"))
    out = pl.responsibility(item_cards(t), people.join(named, "k").select("district", "name"))
    return out.select(F.col("id").alias("analysis_id"), "department_owner", "district_office", "members", "member_count", "escalate", "actionable")


CATEGORY_OF = profile("category", "concern")
EXPECTED = f"CASE WHEN NOT people OR cat = 'concern' THEN FALSE WHEN cat IN {a.SERIOUS} THEN TRUE ELSE {has(a.IMPACT)} AND NOT (cat = 'education' AND {has(a.CEREMONY)} AND NOT {has(a.IMPACT)}) END"


@query(f"""WITH f AS (SELECT t.*, {CATEGORY_OF} AS cat, {PEOPLE} AS people, {has(L.subject)} AS subj FROM {TEXTS} t), e AS (SELECT f.*, {EXPECTED} AS expected FROM f),
 j AS (SELECT b.id AS analysis_id, e.*, b.people_issue, lower(coalesce(b.severity, '')) AS sev, b.needs_human_review, lower(coalesce(b.tvk_relevance, '')) AS rel FROM {GRAPH_BEST} b JOIN e ON e.raw_item_id = b.raw_item_id WHERE {GATE} AND lower(coalesce(b.issue_category, '')) NOT IN ('out-of-scope', 'listing')),
 c AS (SELECT raw_item_id, analysis_id, unnest([CASE WHEN expected AND NOT coalesce(people_issue, FALSE) THEN 'people_issue_missing' END, CASE WHEN people AND cat IN {a.SERIOUS} AND sev NOT IN ('high', 'critical') THEN 'serious_issue_low_severity' END,
 CASE WHEN people AND cat IN {a.SERIOUS} AND NOT coalesce(needs_human_review, FALSE) THEN 'serious_issue_not_reviewed' END, CASE WHEN subj AND rel <> 'high' THEN 'subject_relevance_missing' END, CASE WHEN expected THEN 'generic_next_step' END, CASE WHEN expected THEN 'missing_action_owner' END]) AS code FROM j)
 SELECT raw_item_id, analysis_id, code FROM c WHERE code IS NOT NULL""")
def cls18_quality_audit(t: Tables) -> DataFrame:
    """Contradictions between texts and their current analyses (WIN5); the tables have no next step and no owner, so these count as blank."""
    best = current_analyses(t.ai_analysis).select("raw_item_id", F.col("id").alias("analysis_id"), "government_relevance", "issue_category", "people_issue", "severity", "needs_human_review", F.col("tvk_relevance").alias("subject_relevance"))
    joined = best.join(items(t), "raw_item_id").withColumns({"next_step": F.lit(""), "action_owner": F.lit("")})
    return a.audit(joined, L)


@query(f"SELECT raw_item_id, {profile('category', 'concern')} AS category, CASE WHEN people THEN {EXPECTED} ELSE FALSE END AS expected FROM (SELECT *, {PEOPLE} AS people, {CATEGORY_OF} AS cat FROM {TEXTS})")
def cls24_expected_people_issues(t: Tables) -> DataFrame:
    r = a.Rules(L)
    seen = items(t).withColumns({"category": r.profile()["category"], "_people": r.people_issue()})
    return seen.select("raw_item_id", "category", (F.col("_people") & a.expected_people_issue(F.col("category"), r.text)).alias("expected"))


@query(f"""WITH f AS (SELECT *, {PEOPLE} AS people, {profile('severity', 'low')} AS sev, {profile('name', 'public concern')} AS iss FROM {TEXTS}) SELECT b.id AS analysis_id, 'enriched-v1' AS prompt_version, coalesce(c.department_canonical, b.department) AS department, coalesce(c.district_canonical, b.district) AS district,
 CASE WHEN f.people THEN f.sev ELSE b.action_priority END AS action_priority, CASE WHEN f.people THEN f.iss ELSE b.public_issue END AS public_issue FROM {GRAPH_BEST} b JOIN f ON f.raw_item_id = b.raw_item_id JOIN {CARDS} c ON c.id = b.id""")
def cls19_enriched_versions(t: Tables) -> DataFrame:
    """Current analyses with canonical places and what the rules say of people's issues, as new versions; the old ones stay."""
    r = a.Rules(L)
    said = items(t).select("raw_item_id", r.people_issue().alias("_people"), r.profile().alias("_p"))
    joined = item_cards(t).join(said, "raw_item_id")
    return joined.select(
        F.col("id").alias("analysis_id"), F.lit("enriched-v1").alias("prompt_version"), F.coalesce(pl.canonical_department(F.col("department")), "department").alias("department"), F.coalesce("district_canonical", "district").alias("district"),
        F.when(F.col("_people"), F.col("_p.severity")).otherwise(F.col("action_priority")).alias("action_priority"), F.when(F.col("_people"), F.col("_p.issue")).otherwise(F.col("public_issue")).alias("public_issue"),
    )


@query(f"""SELECT b.raw_item_id, coalesce(o.s, {PORTRAYAL}) AS portrayal, o.s IS NOT NULL AS overridden FROM {GRAPH_BEST} b LEFT JOIN
 (SELECT a.raw_item_id, d.corrected_stance AS s FROM review_decisions d JOIN ai_analysis a ON a.id = d.analysis_id WHERE coalesce(trim(d.corrected_stance), '') <> '' QUALIFY row_number() OVER (PARTITION BY a.raw_item_id ORDER BY d.created_at DESC NULLS LAST, d.id DESC) = 1) o ON o.raw_item_id = b.raw_item_id""")
def cls20_overridden_portrayals(t: Tables) -> DataFrame:
    """What a person said of an item goes before what the analysis says."""
    from .analyses import win8_stance_override

    said = win8_stance_override(t).select("raw_item_id", "corrected_stance")
    joined = current_analyses(t.ai_analysis).join(said, "raw_item_id", "left")
    return joined.select("raw_item_id", F.coalesce("corrected_stance", subject_portrayal()).alias("portrayal"), F.col("corrected_stance").isNotNull().alias("overridden"))


@query(f"SELECT raw_item_id, CASE WHEN {LISTING} THEN 'listing' ELSE 'out-of-scope' END AS issue_category, 'none' AS relevance, 'monitor' AS action_type, 0.25::DOUBLE AS confidence FROM {TEXTS} WHERE {LISTING} OR NOT {SCOPE}")
def cls21_irrelevant_records(t: Tables) -> DataFrame:
    out = a.analyze(items(t), L).where("gate is not null")
    return out.select("raw_item_id", "issue_category", F.col("government_relevance").alias("relevance"), "action_type", F.col("confidence").cast("double").alias("confidence"))


WITHOUT_FALSE = "regexp_replace(regexp_replace(regexp_replace(txt, '(?i)school street', '', 'g'), '(?i)old school road', '', 'g'), 'பள்ளிக்கரை', '', 'g')"


@query(f"SELECT raw_item_id, {has(a.SCHOOL, 's')} AS school, CASE WHEN {has(a.Terms(('fire', 'cyclone', 'fever', 'collapse', 'accident'), ('விபத்து',)))} THEN 'high' ELSE 'medium' END AS severity FROM (SELECT *, {WITHOUT_FALSE} AS s FROM {TEXTS})")
def cls23_school_context(t: Tables) -> DataFrame:
    r = a.Rules(L)
    return items(t).select("raw_item_id", a.school_context(r.text).alias("school"), a.fallback_severity(r.text).alias("severity"))


@query()
def cls25_explicit_subject(t: Tables) -> DataFrame:
    return items(t).select("raw_item_id", a.explicit_subject(F.col("title"), F.col("body"), L.government).alias("explicit"))


@query(f"""WITH f AS (SELECT id AS analysis_id, created_at, {CATEGORY} AS category, coalesce(department_canonical, '') AS dep, district_canonical, coalesce(needs_human_review, FALSE) AS rev, coalesce(people_issue, FALSE) AS ppl FROM {CARDS}),
 k AS (SELECT analysis_id, created_at FROM f WHERE (ppl OR rev) AND dep IN ('Water Supply', 'Energy', 'Roads and Transport') AND district_canonical IS NOT NULL)
 SELECT analysis_id, page FROM (SELECT analysis_id, ((row_number() OVER (ORDER BY created_at DESC, analysis_id DESC) - 1) // 12 + 1)::BIGINT AS page FROM k) WHERE page BETWEEN 1 AND 2""")
def flt8_faceted_page(t: Tables) -> DataFrame:
    """Two pages of twelve of the cards that facets leave: of the people matcher, some departments, any known district."""
    from ..operators.cards import Facets, page

    cards = item_cards(t).withColumn("department_canonical", pl.canonical_department(F.col("department")))
    kept = Facets(category="people", departments=("Water Supply", "Energy", "Roads and Transport"), in_district=True).of(cards)
    one, two = page(kept, 1), page(kept, 2)
    return one.union(two).select(F.col("id").alias("analysis_id"), F.col("page").cast("long").alias("page"))


@query(f"""WITH f AS (SELECT * FROM {CARDS}), r AS (SELECT *, CASE lower(coalesce(nullif(action_priority, ''), severity, '')) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS pr, coalesce(needs_human_review, FALSE)::INT AS rv FROM f),
 w AS (SELECT r.*, coalesce(i.published_at, i.ingested_at) AS seen FROM r JOIN raw_items i ON i.id = r.raw_item_id)
 SELECT raw_item_id, (pr + rv)::INTEGER AS urgency FROM w WHERE category IN ('negative', 'people') AND (pr >= 3 OR rv = 1) ORDER BY pr + rv DESC, pr DESC, seen DESC NULLS LAST, raw_item_id DESC LIMIT 20""")
def srt4_alerts(t: Tables) -> DataFrame:
    from ..operators.cards import alerts

    times = t.raw_items.select(F.col("id").alias("raw_item_id"), F.coalesce("published_at", "ingested_at").alias("at"))
    return alerts(item_cards(t).join(times, "raw_item_id"), 20).select("raw_item_id", "urgency")


@query(f"SELECT count(*) AS briefing_total, {COUNTS} FROM {CARDS}")
def agg6_category_counts(t: Tables) -> DataFrame:
    """Counts by category; they add up to the number of cards."""
    return item_cards(t).agg(F.count("*").alias("briefing_total"), *pl.by_category())


__all__ = ["item_cards", "items", "known", "severity_rank", "x"]
