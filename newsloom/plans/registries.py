"""Queries on models, repairs of their answers, tables that are written, tenants, sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import repair as rp
from ..functions import text as x
from ..operators import analyzer as a
from ..operators import registry as rg
from ..operators.cards import clamped
from ..operators.current import best_row, current_analyses, policy, severity_rank
from ..session import shared_dir, stored
from ..sources import pages
from ..sources.tables import SnapshotTable, write_jsonl
from .analyses import GATE, GRAPH_BEST, MOCK, PORTRAYAL, RANK
from .index import bare
from .labels import FIELDS, predictions
from .registry import Tables, query
from .rulings import FLAGS, L, OWNER, PEOPLE, STANCE, items, profile

SAID = " UNION ALL ".join(f"SELECT model_name, prompt_version AS version, raw_item_id, '{f}' AS field, coalesce({c}, '<none>') AS pred FROM m" for f, c in FIELDS.items())
REGISTRY = f"""(WITH m AS (SELECT * FROM ai_analysis QUALIFY row_number() OVER (PARTITION BY model_name, prompt_version, raw_item_id ORDER BY id DESC) = 1), p AS ({SAID}),
 g AS (SELECT raw_item_id, field, value AS gold FROM labeled_examples WHERE tier = 'gold' QUALIFY row_number() OVER (PARTITION BY raw_item_id, field ORDER BY created_at DESC NULLS LAST, id DESC) = 1), v AS (SELECT DISTINCT model_name, version FROM p),
 j AS (SELECT v.model_name, v.version, g.field, g.gold, coalesce(p.pred, '<none>') AS pred FROM g CROSS JOIN v LEFT JOIN p ON p.model_name = v.model_name AND p.version = v.version AND p.raw_item_id = g.raw_item_id AND p.field = g.field),
 k AS (SELECT model_name, version, field, gold AS class, count(*) AS support, count(*) FILTER (gold = pred) AS tp FROM j GROUP BY 1, 2, 3, 4), q AS (SELECT model_name, version, field, pred AS class, count(*) AS said FROM j GROUP BY 1, 2, 3, 4),
 c AS (SELECT k.*, tp / support::DOUBLE AS r, coalesce(tp / nullif(said, 0)::DOUBLE, 0) AS p FROM k LEFT JOIN q ON q.model_name = k.model_name AND q.version = k.version AND q.field = k.field AND q.class = k.class),
 f AS (SELECT model_name, version, field, avg(coalesce(2 * p * r / nullif(p + r, 0), 0)) AS f1, sum(support)::BIGINT AS support FROM c GROUP BY 1, 2, 3)
 SELECT model_name, version, avg(f1) AS primary_metric, sum(support)::BIGINT AS eval_examples, version = 'v1' AS is_live FROM f GROUP BY 1, 2)"""


def registry(t: Tables) -> DataFrame:
    """The registry of the models in the analyses: each version scored on the gold labels, the first one live."""
    latest = best_row(t.ai_analysis, ["model_name", "prompt_version", "raw_item_id"], [F.desc("id")])
    names = latest.select(F.col("id").alias("analysis_id"), "model_name", F.col("prompt_version").alias("version"))
    said = predictions(latest).join(names, "analysis_id").select("model_name", "version", "raw_item_id", "field", F.col("value").alias("predicted"))
    gold = best_row(t.labeled_examples.where("tier = 'gold'"), ["raw_item_id", "field"], policy("chat")).select("raw_item_id", "field", F.col("value").alias("gold"))
    return rg.evaluated(gold, said).withColumn("is_live", F.col("version") == "v1")


@query(f"""WITH r AS {REGISTRY} SELECT r.model_name, r.version, round(r.primary_metric, 6) AS candidate_metric, round(l.primary_metric, 6) AS incumbent_metric,
 CASE WHEN r.eval_examples <= 0 THEN 'no gold' WHEN l.version IS NULL THEN 'first' WHEN l.version = r.version THEN 'live' WHEN r.primary_metric >= l.primary_metric + 0.0 THEN 'better' ELSE 'kept incumbent' END AS reason FROM r LEFT JOIN (SELECT * FROM r WHERE is_live) l ON l.model_name = r.model_name""")
def lbl7_promotion_gate(t: Tables) -> DataFrame:
    """Every version against the live one of its name, by its score on gold labels."""
    rows = stored(registry(t), "registry")
    out = rg.promotions(rows, rows.select("model_name", "version"))
    return out.select("model_name", "version", *[F.round(c, 6).alias(c) for c in ("candidate_metric", "incumbent_metric")], "reason")


@query(f"SELECT model_name, version, round(primary_metric, 6) AS metric FROM {REGISTRY} WHERE is_live")
def lbl13_live_models(t: Tables) -> DataFrame:
    return rg.live_models(registry(t)).select("model_name", "version", F.round("primary_metric", 6).alias("metric"))


GOLD = "(SELECT raw_item_id, field, value AS gold FROM labeled_examples WHERE tier = 'gold' QUALIFY row_number() OVER (PARTITION BY raw_item_id, field ORDER BY created_at DESC NULLS LAST, id DESC) = 1)"


@query(f"""WITH p AS (SELECT raw_item_id, 'tvk_portrayal' AS field, CASE WHEN subj OR gov THEN {STANCE} ELSE 'neutral' END AS pred FROM {FLAGS} UNION ALL SELECT raw_item_id, 'severity', CASE WHEN people THEN {profile('severity', 'low')} ELSE 'low' END FROM {FLAGS}),
 j AS (SELECT g.field, g.gold, coalesce(p.pred, '<none>') AS pred FROM {GOLD} g LEFT JOIN p ON p.raw_item_id = g.raw_item_id AND p.field = g.field WHERE g.field IN ('tvk_portrayal', 'severity'))
 SELECT field, count(*) AS support, round(avg((gold = pred)::INT), 6) AS accuracy FROM j GROUP BY 1""")
def lbl12_evaluation(t: Tables) -> DataFrame:
    """The rules run over the items with gold labels and scored."""
    r, c = a.Rules(L), F.col
    gold = best_row(t.labeled_examples.where("tier = 'gold' and field in ('tvk_portrayal', 'severity')"), ["raw_item_id", "field"], policy("chat")).select("raw_item_id", "field", c("value").alias("gold"))
    wanted = items(t).join(gold.select("raw_item_id").distinct(), "raw_item_id", "left_semi")
    portrayal = F.when(L.subject.found(r.text) | L.government.found(r.text), r.stance()).otherwise("neutral")
    severity = F.when(r.people_issue(), r.profile()["severity"]).otherwise("low")
    said = wanted.select("raw_item_id", portrayal.alias("tvk_portrayal"), severity.alias("severity")).unpivot(["raw_item_id"], ["tvk_portrayal", "severity"], "field", "predicted")
    return rg.scores(gold, said).select("field", "support", F.round("accuracy", 6).alias("accuracy"))


@query("""SELECT (SELECT count(DISTINCT raw_item_id) * 7 FROM ai_analysis) AS bronze, (SELECT count(*) FROM labeled_examples WHERE tier = 'silver') AS silver, (SELECT count(*) FROM labeled_examples WHERE tier = 'gold') AS gold,
 (SELECT count(*) FROM (SELECT DISTINCT a.raw_item_id FROM review_decisions d JOIN ai_analysis a ON a.id = d.analysis_id WHERE d.corrected_stance IS NOT NULL OR d.corrected_relevance IS NOT NULL)) AS corrected""")
def lbl9_loop_counts(t: Tables) -> DataFrame:
    """One pass of the label loop in counts: bronze from all current analyses, silver and gold as stored, items that reviewers corrected."""
    bronze = predictions(current_analyses(t.ai_analysis, "latest_id")).agg(F.count("*").alias("bronze"))
    tiers = t.labeled_examples.agg(F.count_if(F.col("tier") == "silver").alias("silver"), F.count_if(F.col("tier") == "gold").alias("gold"))
    made = t.review_decisions.where("corrected_stance is not null or corrected_relevance is not null").select("analysis_id").join(t.ai_analysis.select(F.col("id").alias("analysis_id"), "raw_item_id"), "analysis_id").agg(F.count_distinct("raw_item_id").alias("corrected"))
    return bronze.crossJoin(tiers).crossJoin(made)  # one row each


@query()
def lbl10_stub_trainer(t: Tables) -> DataFrame:
    """The version that a trainer would give a model trained on each part of the labelled set."""
    from .labels import agg25_fingerprint

    return agg25_fingerprint(t).select("part", "items", F.concat(F.lit(rg.stub_version("")), "fingerprint").alias("version"))


@query("SELECT id AS label_id, CASE WHEN value IS NULL THEN '<none>' ELSE value END AS value, CASE WHEN split_bucket IS NULL THEN '<none>' WHEN split_bucket < 20 THEN 'true' ELSE 'false' END AS held_out FROM labeled_examples")
def prj11_label_strings(t: Tables) -> DataFrame:
    """Labels as strings: null as <none>, truth values as true and false."""
    return t.labeled_examples.select(F.col("id").alias("label_id"), x.label_string(F.col("value")).alias("value"), x.label_string(F.col("split_bucket") < 20).alias("held_out"))


@query("""SELECT id AS analysis_id, CASE WHEN lower(trim(coalesce(scheme, ''))) IN ('', 'none', 'n/a', 'null') THEN '' ELSE scheme END AS scheme, array_to_string(list_filter(list_transform(coalesce(positive_points, []), lambda p: trim(p)), lambda p: p <> ''), '|') AS positive_points,
 CASE WHEN trim(coalesce(topic, '')) = '' THEN '' ELSE trim(topic) END AS political_actors, needs_human_review, people_issue, CASE WHEN confidence IS NULL THEN 0.7 ELSE confidence END AS confidence, CASE WHEN needs_human_review THEN '' ELSE 'general' END AS department FROM ai_analysis""")
def str16_repaired_json(t: Tables) -> DataFrame:
    """Answers of models with fences, nulls, lists given as strings, truth values as words, numbers as strings, missing keys; and what the repair makes of them."""
    c = F.col
    payload = F.to_json(F.struct(
        F.coalesce("scheme", F.lit("None")).alias("scheme"), F.coalesce("positive_points", F.array().cast("array<string>")).alias("positive_points"), F.coalesce("topic", F.lit("")).alias("political_actors"),
        F.when(c("needs_human_review"), "Yes").otherwise("no").alias("needs_human_review"), c("people_issue"), F.coalesce(c("confidence").cast("string"), F.lit("unsure")).alias("confidence"), F.when(c("needs_human_review"), F.lit(True)).alias("department"),
    ))
    f = rp.parsed(F.concat(F.lit("```json\n"), payload, F.lit("\n```")))
    made = t.ai_analysis.select(c("id").alias("analysis_id"), f.alias("f"))
    return made.select(
        "analysis_id", rp.text_field(c("f"), "scheme").alias("scheme"), F.array_join(rp.list_field(c("f"), "positive_points"), "|").alias("positive_points"), F.array_join(rp.list_field(c("f"), "political_actors"), "|").alias("political_actors"),
        rp.flag_field(c("f"), "needs_human_review").alias("needs_human_review"), rp.flag_field(c("f"), "people_issue").alias("people_issue"), rp.number_field(c("f"), "confidence").alias("confidence"), rp.text_field(c("f"), "department", "general").alias("department"),
    )


def _coerced(kind: str, value: str) -> str:
    known, default = rp.SYNONYMS[kind]
    return "CASE " + " ".join(f"WHEN lower(trim({value})) IN {(label, *words)} THEN '{label}'" for label, words in known.items()) + f" ELSE '{default}' END"


@query(f"SELECT id AS analysis_id, {_coerced('stance', 'stance_toward_government')} AS stance, {_coerced('sentiment', 'sentiment')} AS sentiment, {_coerced('relevance', 'government_relevance')} AS relevance, {_coerced('severity', 'severity')} AS severity FROM ai_analysis")
def str17_enum_synonyms(t: Tables) -> DataFrame:
    c = F.col
    return t.ai_analysis.select(c("id").alias("analysis_id"), rp.coerced(c("stance_toward_government"), "stance").alias("stance"), rp.coerced(c("sentiment"), "sentiment").alias("sentiment"), rp.coerced(c("government_relevance"), "relevance").alias("relevance"), rp.coerced(c("severity"), "severity").alias("severity"))


@query(r"SELECT doc_id, trim(CASE WHEN regexp_matches(s, '[.!?।。]\s') OR contains(s, chr(10)) THEN regexp_extract(s, '^((?s:.*?)(?:[.!?।。](?:\s)|\n))', 1) ELSE s END, ' ' || chr(10) || chr(9) || chr(13)) AS first FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS s FROM documents)")
def str6_first_sentences(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", x.first_sentence(F.coalesce("text", F.lit(""))).alias("first"))


@query(f"""SELECT id AS raw_item_id, CASE WHEN length(p) <= 60 THEN p ELSE rtrim(substr(p, 1, 59)) || '…' END AS plain, CASE WHEN length(s) <= 60 THEN s ELSE rtrim(substr(s, 1, 57)) || '...' END AS dots FROM (SELECT id, regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS p, {bare('title')} AS s FROM raw_items WHERE title IS NOT NULL AND NOT regexp_matches(title, '[\\x{{0085}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]'))""")
def str7_other_short_titles(t: Tables) -> DataFrame:
    """The two other ways to shorten, on titles without unusual spaces."""
    usual = t.raw_items.where(F.col("title").isNotNull() & ~F.col("title").rlike(r"[\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"))
    return usual.select(F.col("id").alias("raw_item_id"), x.cut_with_ellipsis(F.col("title"), 60).alias("plain"), x.cut_with_dots(F.col("title"), 60).alias("dots"))


@query(r"SELECT doc_id, regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])council($|[^\p{L}\p{N}_])') AS has_council, contains(text, 'குடிநீர்') AS has_water FROM documents WHERE text IS NOT NULL")
def str12_word_match(t: Tables) -> DataFrame:
    """A Latin word between edges, one in another script anywhere."""
    return t.documents.where("text is not null").select("doc_id", x.has_word(F.col("text"), "council").alias("has_council"), x.has_word(F.col("text"), "குடிநீர்").alias("has_water"))


@query(f"SELECT id AS raw_item_id, regexp_replace({bare('title')}, '([\\\\\\\\`*_{{}}\\[\\]()#+!|>-])', '\\\\\\1', 'g') AS shown FROM raw_items WHERE title IS NOT NULL")
def str13_markdown_titles(t: Tables) -> DataFrame:
    return t.raw_items.where("title is not null").select(F.col("id").alias("raw_item_id"), x.markdown_escaped(F.col("title")).alias("shown"))


@query(f"""SELECT id AS analysis_id, CASE {PORTRAYAL} WHEN 'positive' THEN 'Favourable' WHEN 'negative' THEN 'Critical' WHEN 'mixed' THEN 'Mixed' ELSE 'Neutral' END AS label, regexp_matches(lower(coalesce(model_name, '')), '^openai') AS openai,
 regexp_matches(lower(coalesce(model_name, '')), 'openai|gemma|sentence-transformers|indic-bert') AS semantic, NOT regexp_matches(lower(coalesce(model_name, '')), 'openai|gemma|sentence-transformers|indic-bert') AS fallback FROM ai_analysis""")
def prj2_labels_and_families(t: Tables) -> DataFrame:
    """What a portrayal is shown as, and which family of models gave it."""
    from ..operators.current import subject_portrayal

    shown = F.create_map(*[F.lit(v) for pair in (("positive", "Favourable"), ("negative", "Critical"), ("mixed", "Mixed"), ("neutral", "Neutral")) for v in pair])
    name = F.lower(F.coalesce("model_name", F.lit("")))
    semantic = name.rlike("openai|gemma|sentence-transformers|indic-bert")
    return t.ai_analysis.select(F.col("id").alias("analysis_id"), shown[subject_portrayal()].alias("label"), name.startswith("openai").alias("openai"), semantic.alias("semantic"), (~semantic).alias("fallback"))


@query("SELECT id AS raw_item_id, 'Post by ' || source_name AS title, trim(clean_text_original) AS text, coalesce(metadata_json['author'], '') AS author FROM raw_items WHERE source_type = 'x' AND trim(coalesce(clean_text_original, '')) <> ''")
def prj7_posts(t: Tables) -> DataFrame:
    """Posts as items, with what is kept of their metadata."""
    posts = t.raw_items.where("source_type = 'x' and trim(coalesce(clean_text_original, '')) <> ''")
    return posts.select(F.col("id").alias("raw_item_id"), F.concat(F.lit("Post by "), "source_name").alias("title"), F.trim("clean_text_original").alias("text"), F.coalesce(F.col("metadata_json")["author"], F.lit("")).alias("author"))


@query("SELECT id AS raw_item_id, concat_ws(chr(10) || chr(10), nullif(trim(coalesce(title, '')), ''), nullif(trim(coalesce(clean_text_original, '')), '')) AS text FROM raw_items WHERE source_type = 'youtube'")
def prj8_transcripts(t: Tables) -> DataFrame:
    """Descriptions and transcripts, here title and text, joined by a blank line; blanks are left out."""
    from ..sources.tables import transcript_items

    return transcript_items(t.raw_items.where("source_type = 'youtube'").select(F.col("id").alias("raw_item_id"), F.col("title").alias("description"), F.col("clean_text_original").alias("transcript")))


@query("""SELECT slug, coalesce(nullif(upper(substr(party, 1, 3)), ''), 'IND') AS code, canonical_name || ' (' || coalesce(nullif(party, ''), 'independent') || ')' AS label FROM entities WHERE entity_type = 'person'""")
def prj12_party_codes(t: Tables) -> DataFrame:
    """A short code of a person's party, and how a roster shows them."""
    party = F.nullif(F.coalesce("party", F.lit("")), F.lit(""))
    return t.entities.where("entity_type = 'person'").select("slug", F.coalesce(F.upper(F.substring(party, 1, 3)), F.lit("IND")).alias("code"), F.concat("canonical_name", F.lit(" ("), F.coalesce(party, F.lit("independent")), F.lit(")")).alias("label"))


@query("SELECT count(*) AS rows, count(*) FILTER (title IS NOT NULL AND source_name IS NOT NULL AND source_url IS NOT NULL) AS complete, coalesce(string_agg(DISTINCT CASE WHEN title IS NULL THEN 'title' END, ','), '') AS lacking FROM raw_items")
def flt13_required_keys(t: Tables) -> DataFrame:
    """Rows of a report that have what it needs, and what others lack."""
    needed = ("title", "source_name", "source_url")
    whole = F.lit(True)
    for c in needed:
        whole = whole & F.col(c).isNotNull()
    lacking = F.array_join(F.array_compact(F.array(*[F.max(F.when(F.col(c).isNull(), c)) for c in needed])), ",")
    return t.raw_items.agg(F.count("*").alias("rows"), F.count_if(whole).alias("complete"), lacking.alias("lacking"))


@query("SELECT strftime(max(published_at)::TIMESTAMP, '%Y-%m-%d') AS published, strftime(max(ingested_at)::TIMESTAMP, '%Y-%m-%d') AS ingested FROM raw_items")
def agg27_latest_times(t: Tables) -> DataFrame:
    return t.raw_items.agg(F.date_format(F.max("published_at"), "yyyy-MM-dd").alias("published"), F.date_format(F.max("ingested_at"), "yyyy-MM-dd").alias("ingested"))


@query(f"""WITH c AS (SELECT (SELECT count(*) FROM raw_items) AS items, (SELECT count(*) FROM ai_analysis) AS analyses, (SELECT count(*) FROM ai_analysis WHERE {MOCK} = 1) AS mock, (SELECT count(*) FROM ai_analysis WHERE needs_human_review) AS review)
 SELECT 'ingest' AS step, CASE WHEN items > 0 THEN 'ready' ELSE 'empty' END AS status, items AS n FROM c UNION ALL SELECT 'analysis', CASE WHEN analyses = 0 THEN 'empty' WHEN mock = analyses THEN 'stand-in' ELSE 'ready' END, analyses FROM c UNION ALL SELECT 'review', CASE WHEN review > 0 THEN 'waiting' ELSE 'clear' END, review FROM c""")
def agg28_pipeline_status(t: Tables) -> DataFrame:
    """Where each step of the pipeline stands, from counts."""
    c, n = F.col, t.raw_items.agg(F.count("*").alias("items"))
    one = n.crossJoin(t.ai_analysis.agg(F.count("*").alias("analyses"), F.count_if(F.lower(F.coalesce("model_name", F.lit(""))).startswith("mock")).alias("mock"), F.count_if("needs_human_review").alias("review")))  # one row each
    rows = F.array(
        F.struct(F.lit("ingest").alias("step"), F.when(c("items") > 0, "ready").otherwise("empty").alias("status"), c("items").alias("n")),
        F.struct(F.lit("analysis").alias("step"), F.when(c("analyses") == 0, "empty").when(c("mock") == c("analyses"), "stand-in").otherwise("ready").alias("status"), c("analyses").alias("n")),
        F.struct(F.lit("review").alias("step"), F.when(c("review") > 0, "waiting").otherwise("clear").alias("status"), c("review").alias("n")),
    )
    return one.select(F.inline(rows))


@query("SELECT count(*) AS items, count(DISTINCT source_name) AS sources, count(published_at) AS dated, count(DISTINCT language) AS languages, max(length(clean_text_original))::INTEGER AS longest, count(*) FILTER (source_type = 'news') AS news, count(*) FILTER (source_type = 'x') AS posts, count(*) FILTER (source_type = 'youtube') AS videos, count(DISTINCT content_hash) AS contents FROM raw_items")
def agg1_item_totals(t: Tables) -> DataFrame:
    """Further figures of a summary, over all items."""
    of = lambda k: F.count_if(F.col("source_type") == k)
    return t.raw_items.agg(F.count("*").alias("items"), F.count_distinct("source_name").alias("sources"), F.count("published_at").alias("dated"), F.count_distinct("language").alias("languages"), F.max(F.length("clean_text_original")).alias("longest"), of("news").alias("news"), of("x").alias("posts"), of("youtube").alias("videos"), F.count_distinct("content_hash").alias("contents"))


@query("SELECT id AS raw_item_id FROM raw_items ORDER BY ingested_at DESC, id DESC LIMIT 200")
def mth4_clamped_list(t: Tables) -> DataFrame:
    """A list whose asked length, here 1,000, is kept between 1 and 200."""
    return t.raw_items.select(F.col("id").alias("raw_item_id"), "ingested_at").orderBy(F.desc("ingested_at"), F.desc("raw_item_id")).limit(clamped(1000)).drop("ingested_at")


@query("SELECT id AS raw_item_id, 'https://x.example/' || regexp_replace(source_name, '^@', '') || '/status/' || id AS url FROM raw_items WHERE source_type = 'x'")
def url2_post_urls(t: Tables) -> DataFrame:
    from ..streaming.ingest import post_url

    posts = t.raw_items.where("source_type = 'x'")
    return posts.select(F.col("id").alias("raw_item_id"), post_url(F.regexp_replace("source_name", "^@", ""), F.col("id").cast("string")).alias("url"))


@query("""SELECT topic AS theme, count(*) AS article_count, count(DISTINCT regexp_extract(source_url, '^https?://([^/?#]+)', 1)) AS distinct_domains, count(*) >= 3 AS has_signal FROM (SELECT DISTINCT a.topic, r.id, r.source_url FROM ai_analysis a JOIN raw_items r ON r.id = a.raw_item_id WHERE coalesce(a.topic, '') <> '') GROUP BY 1""")
def src8_cross_reference(t: Tables) -> DataFrame:
    """How many articles of how many hosts bear on each theme; three make a signal. The hits are given, here by the topics of analyses."""
    from ..sources.tables import cross_reference

    hits = t.ai_analysis.where("coalesce(topic, '') <> ''").select("raw_item_id", F.col("topic").alias("theme")).distinct().join(t.raw_items.select(F.col("id").alias("raw_item_id"), F.col("source_url").alias("url")), "raw_item_id")
    return cross_reference(hits)


FEEDABLE = "source_type = 'news' AND published_at IS NOT NULL AND title IS NOT NULL AND title = trim(title) AND title <> ''"


@query(f"SELECT id AS raw_item_id, source_url AS url, title, strftime(published_at::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS published FROM raw_items WHERE {FEEDABLE}")
def src2_feed_entries(t: Tables) -> DataFrame:
    """Items written as feeds and read back: RSS with a link, RSS with a guid alone, Atom; dates as each of them gives them."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    title, url, at, text = esc(F.col("title")), esc(F.col("source_url")), F.col("published_at"), F.lit
    rss = lambda tag: F.concat(text("<rss><channel><item><title>"), title, text(f"</title><{tag}>"), url, text(f"</{tag}><pubDate>"), F.date_format(at, "E, dd MMM yyyy HH:mm:ss"), text(" +0000</pubDate></item></channel></rss>"))
    atom = F.concat(text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), title, text('</title><link href="'), F.replace(url, F.lit('"'), F.lit("&quot;")), text('"/><updated>'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), text("Z</updated></entry></feed>"))
    turn = F.pmod(F.xxhash64("id"), F.lit(3))
    news = t.raw_items.where(FEEDABLE).select(F.col("id").cast("string").alias("raw_item_id"), F.when(turn == 0, rss("link")).when(turn == 1, rss("guid")).otherwise(atom).alias("xml"))
    return pages.parse_feeds(news, "raw_item_id").select(F.col("raw_item_id").cast("long").alias("raw_item_id"), "url", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.raw_items.sparkSession).rstrip('/')}/newsloom/{name}-{uuid.uuid4().hex}"


@query("SELECT source_type, count(DISTINCT content_hash) AS rows FROM (SELECT content_hash, min(source_type) AS source_type FROM raw_items GROUP BY 1) GROUP BY 1")
def snk1_inserted_items(t: Tables) -> DataFrame:
    """Items inserted by content, twice: the second time adds none."""
    table = SnapshotTable(t.raw_items.sparkSession, _folder(t, "items"))
    rows = t.raw_items.groupBy("content_hash").agg(F.min("source_type").alias("source_type"), F.min("id").alias("id"))
    for _ in range(2):
        table.insert_new(rows, ["content_hash"])
    return table.read().groupBy("source_type").agg(F.count("*").alias("rows"))


@query("SELECT model_name, count(*) AS rows FROM (SELECT DISTINCT raw_item_id, model_name, prompt_version FROM ai_analysis) GROUP BY 1")
def snk2_inserted_analyses(t: Tables) -> DataFrame:
    """Analyses inserted where their item, model and version has none yet, again and again."""
    table, keys = SnapshotTable(t.raw_items.sparkSession, _folder(t, "analyses")), ["raw_item_id", "model_name", "prompt_version"]
    table.insert_new(t.ai_analysis.where("model_name like 'local%'").select("id", *keys), keys)
    table.insert_new(t.ai_analysis.select("id", *keys), keys)
    return table.read().groupBy("model_name").agg(F.count("*").alias("rows"))


@query("SELECT raw_item_id, field, tier, value FROM labeled_examples QUALIFY row_number() OVER (PARTITION BY raw_item_id, field, tier ORDER BY created_at DESC NULLS LAST, id DESC) = 1")
def snk3_upserted_labels(t: Tables) -> DataFrame:
    """Labels upserted by item, field and tier, the latest holding, in two batches that overlap."""
    table = SnapshotTable(t.raw_items.sparkSession, _folder(t, "labels"))
    rows = t.labeled_examples.select("id", "raw_item_id", "field", "tier", "value", "created_at")
    for part in (rows.where("tier <> 'gold'"), rows):
        table.upsert(part, ["raw_item_id", "field", "tier"], policy("chat"))
    return table.read().select("raw_item_id", "field", "tier", "value")


@query("SELECT id AS decision_id, trim(reviewer_name) AS reviewer_name, trim(note) AS note FROM review_decisions")
def snk4_appended_decisions(t: Tables) -> DataFrame:
    table = SnapshotTable(t.raw_items.sparkSession, _folder(t, "decisions"))
    rows = t.review_decisions.select(F.col("id").alias("decision_id"), "status", "reviewer_name", "note")
    table.append(rows.where("status = 'escalated'"))
    table.append(rows.where("status <> 'escalated' or status is null"))
    return table.read().select("decision_id", "reviewer_name", "note")


@query("SELECT r.id AS raw_item_id, r.title AS text, l.value FROM labeled_examples l JOIN raw_items r ON r.id = l.raw_item_id WHERE l.tier = 'gold' AND r.title IS NOT NULL")
def snk5_jsonl_export(t: Tables) -> DataFrame:
    """Labels with their titles as lines of JSON, and read back."""
    gold = t.labeled_examples.where("tier = 'gold'").select("raw_item_id", "value")
    rows = gold.join(t.raw_items.where("title is not null").select(F.col("id").alias("raw_item_id"), F.col("title").alias("text")), "raw_item_id")
    path = _folder(t, "export")
    write_jsonl(rows, path)
    return rows.sparkSession.read.schema("raw_item_id long, text string, value string").json(path)


@query("""SELECT reviewer_name AS user, model_name AS tenant, count(*) AS decisions FROM review_decisions d JOIN ai_analysis a ON a.id = d.analysis_id WHERE reviewer_name IS NOT NULL GROUP BY 1, 2""")
def jn6_memberships(t: Tables) -> DataFrame:
    """Users with the tenants they belong to, here reviewers and the models they reviewed."""
    made = t.review_decisions.where("reviewer_name is not null").select("analysis_id", F.col("reviewer_name").alias("user"))
    return made.join(t.ai_analysis.select(F.col("id").alias("analysis_id"), F.col("model_name").alias("tenant")), "analysis_id").groupBy("user", "tenant").agg(F.count("*").alias("decisions"))


@query("SELECT r.source_type AS tenant, count(DISTINCT r.id) AS items, count(a.id) AS analyses FROM raw_items r LEFT JOIN ai_analysis a ON a.raw_item_id = r.id GROUP BY 1")
def agg18_tenant_usage(t: Tables) -> DataFrame:
    """Rows of each tenant, here a source type, counted in one pass over each table."""
    per = t.ai_analysis.groupBy("raw_item_id").agg(F.count("*").alias("n"))
    joined = t.raw_items.select(F.col("id").alias("raw_item_id"), F.col("source_type").alias("tenant")).join(per, "raw_item_id", "left")
    return joined.groupBy("tenant").agg(F.count("*").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("analyses"))


@query(f"""SELECT a.id AS analysis_id FROM {GRAPH_BEST} a WHERE {GATE} AND ({RANK} >= 3 OR a.id IN (SELECT analysis_id FROM review_decisions WHERE status = 'escalated'))""")
def jn7_semi_joined(t: Tables) -> DataFrame:
    """Current relevant analyses that are severe or were escalated: two semi joins, no row twice."""
    from ..operators.current import relevant

    best = current_analyses(t.ai_analysis.select("id", "raw_item_id", "model_name", "created_at", "government_relevance", "severity")).where(relevant()).select(F.col("id").alias("analysis_id"), severity_rank().alias("r"))
    sent = t.review_decisions.where("status = 'escalated'").select("analysis_id").distinct()
    return best.where("r >= 3").select("analysis_id").union(best.where("r < 3").join(sent, "analysis_id", "left_semi").select("analysis_id"))


@query("SELECT raw_item_id, id AS analysis_id FROM ai_analysis WHERE prompt_version = 'v1' OR raw_item_id NOT IN (SELECT raw_item_id FROM ai_analysis WHERE prompt_version = 'v1')")
def set7_pruned(t: Tables) -> DataFrame:
    """What a prune to one version leaves; items that would be left without any keep theirs."""
    kept = t.ai_analysis.where("prompt_version = 'v1'").select("raw_item_id", F.col("id").alias("analysis_id"))
    rest = t.ai_analysis.select("raw_item_id", F.col("id").alias("analysis_id")).join(kept.select("raw_item_id"), "raw_item_id", "left_anti")
    return kept.union(rest)


@query("""SELECT id AS raw_item_id, sha256('{"clean_text":' || to_json(coalesce(clean_text_original, '')) || ',"source_name":' || to_json(coalesce(source_name, '')) || ',"source_type":' || to_json(coalesce(source_type, '')) || ',"source_url":' || to_json(coalesce(source_url, '')) || ',"title":' || to_json(coalesce(title, '')) || '}') AS hash FROM raw_items""")
def hsh1_item_hash(t: Tables) -> DataFrame:
    """The hash of what makes an item: type, source, url, title and text."""
    c = F.col
    return t.raw_items.select(c("id").alias("raw_item_id"), x.content_hash(source_type=c("source_type"), source_name=c("source_name"), source_url=c("source_url"), title=c("title"), clean_text=c("clean_text_original")).alias("hash"))


@query("SELECT id AS raw_item_id, strftime(ingested_at::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS at FROM raw_items")
def dt5_parsed_dates(t: Tables) -> DataFrame:
    """Times written in four ways and read back."""
    at, turn = F.col("ingested_at"), F.pmod(F.xxhash64("id"), F.lit(4))
    said = F.when(turn == 0, F.concat(F.date_format(at, "E, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))).when(turn == 1, F.concat(F.date_format(at, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(turn == 2, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    return t.raw_items.select(F.col("id").alias("raw_item_id"), F.date_format(pages.lenient_time(said), "yyyy-MM-dd HH:mm:ss").alias("at"))


__all__ = ["OWNER", "PEOPLE"]
