"""Queries on chunks, vectors, retrieval and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..functions.chunks import chunk_rows, lead_chunk
from ..operators import retrieval as rt
from ..operators import vectors
from ..operators.clusters import STOP
from ..session import stored
from .analyses import GATE, GRAPH_BEST
from .registry import Tables, query
from .rulings import SPACES



def bare(e: str) -> str:
    """In single spaces, for DuckDB."""
    return f"trim(regexp_replace(coalesce({e}, ''), '{SPACES}', ' ', 'g'))"


LEAD = "CASE WHEN length(s) <= 1200 THEN s WHEN regexp_extract(substr(s, 1, 1201), '(?s)^(.*) ', 1) <> '' THEN regexp_extract(substr(s, 1, 1201), '(?s)^(.*) ', 1) ELSE regexp_extract(s, '^[^ ]*', 0) END"
LEADS = f"(SELECT id AS raw_item_id, {LEAD} AS lead FROM (SELECT id, {bare('clean_text_original')} AS s FROM raw_items WHERE source_type = 'news'))"
WORDS = f"(SELECT raw_item_id, unnest(regexp_extract_all(lower(lead), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS w FROM {LEADS})"
BUCKETS = f"(SELECT raw_item_id, CAST(('0x' || substr(md5(w), 1, 16))::UHUGEINT % 1024 AS INTEGER) AS bucket, count(*) AS n FROM {WORDS} WHERE length(w) >= 2 AND w NOT IN {STOP} GROUP BY 1, 2)"


def leads(t: Tables) -> DataFrame:
    return t.raw_items.where("source_type = 'news'").select(F.col("id").alias("raw_item_id"), lead_chunk(F.col("clean_text_original")).alias("lead"))


@query(f"SELECT raw_item_id, length(lead)::INTEGER AS n_chars, sha256(lead) AS content_hash FROM {LEADS} WHERE lead <> ''")
def flt4_lead_chunks(t: Tables) -> DataFrame:
    """The first chunk of each news item."""
    return leads(t).where("lead <> ''").select("raw_item_id", F.length("lead").alias("n_chars"), F.sha2("lead", 256).alias("content_hash"))


def lead_buckets(t: Tables) -> DataFrame:
    return vectors.word_buckets(leads(t), "raw_item_id", "lead", stop=STOP)


@query(f"SELECT r.id AS raw_item_id, r.source_name, count(*) AS buckets, round(sqrt(sum(b.n * b.n)), 6) AS norm FROM raw_items r JOIN {LEADS} l ON l.raw_item_id = r.id JOIN {BUCKETS} b ON b.raw_item_id = l.raw_item_id GROUP BY 1, 2")
def jn2_items_chunks_vectors(t: Tables) -> DataFrame:
    """News items with their lead chunk and its vector."""
    items = t.raw_items.where("source_type = 'news'").select(F.col("id").alias("raw_item_id"), "source_name")
    per = lead_buckets(t).groupBy("raw_item_id").agg(F.count("*").alias("buckets"), F.round(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")), 6).alias("norm"))
    return items.join(per, "raw_item_id")


@query(f"SELECT id AS raw_item_id FROM raw_items WHERE source_type = 'news' AND id NOT IN (SELECT raw_item_id FROM {BUCKETS})")
def jn10_items_without_vector(t: Tables) -> DataFrame:
    news = t.raw_items.where("source_type = 'news'").select(F.col("id").alias("raw_item_id"))
    return news.join(lead_buckets(t).select("raw_item_id"), "raw_item_id", "left_anti")


@query("SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY 1")
def win11_first_embedding(t: Tables) -> DataFrame:
    """Of the embeddings of one thing, here a label, the first by id."""
    from ..operators.current import best_row

    return best_row(t.embeddings.select("label", "vec_id"), ["label"], [F.asc("vec_id")]).select("label", "vec_id")


STOPPED = f"(SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 16))::UHUGEINT % 1024 AS INTEGER) AS bucket, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS w FROM documents) WHERE length(w) >= 2 AND w NOT IN {STOP} GROUP BY 1, 2)"


@query(f"SELECT doc_id, bucket, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM {STOPPED}")
def vec4_word_buckets(t: Tables) -> DataFrame:
    """Unit vectors of words without stop words, as rows of what isn't zero."""
    counts = stored(vectors.word_buckets(t.documents, "doc_id", "text", stop=STOP), "buckets")
    return vectors.unit_words(counts, "doc_id").withColumn("weight", F.round("weight", 6))


BYTES = " || ".join(f"list_transform(range(0, 32), lambda i: ('0x' || substr(sha256('{n}:' || text), 2 * i + 1, 2))::INTEGER / 127.5::DOUBLE - 1)" for n in (0, 1))


@query(f"SELECT doc_id, round(v[1] / n, 6) AS first, round(v[40] / n, 6) AS fortieth, round(v[64] / n, 6) AS last FROM (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda e: e * e))) AS n FROM (SELECT doc_id, {BYTES} AS v FROM documents WHERE text IS NOT NULL))")
def vec5_hash_embeddings(t: Tables) -> DataFrame:
    made = t.documents.where("text is not null").select("doc_id", vectors.hash_embedding(F.col("text")).alias("v"))
    return made.select("doc_id", *[F.round(F.element_at("v", i), 6).alias(name) for i, name in ((1, "first"), (40, "fortieth"), (64, "last"))])


@query()
def vec6_provider_embeddings(t: Tables) -> DataFrame:
    """Vectors of a provider, here one that counts; what it returns is checked."""
    return vectors.provider_embeddings(t.documents, "doc_id", "text", lambda texts: [[float(len(s)), float(s.count(" ")), 1.0] for s in texts], 3)


@query()
def vec3_quantised_topk(t: Tables) -> DataFrame:
    """The five nearest by an index of bytes over all rows; its recall is measured in a test."""
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = stored(vectors.quantised(t.embeddings), "codes")
    return vectors.top_k_quantised(index, t.embeddings, asked, 5).select("query_id", "vec_id", "rank")


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.label IN (0, 1, 2))
 SELECT query_id, vec_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 3""")
def vec2_allowed_topk(t: Tables) -> DataFrame:
    """The three nearest among the vectors that are allowed."""
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.top_k(t.embeddings, asked, 3, allowed=t.embeddings.where("label in (0, 1, 2)").select("vec_id")).select("query_id", "vec_id", "rank")


@query()
def vec8_chunk_metadata(t: Tables) -> DataFrame:
    return chunk_rows(t.documents, "doc_id", "text").drop("chunk_text")


@query()
def vec9_incremental_index(t: Tables) -> DataFrame:
    """An index made in two runs: (run, chunks, missing, present). The second run finds the chunks of labelled documents there and embeds only the others."""
    chunks = stored(chunk_rows(t.documents.select("doc_id", "lang", "text"), "doc_id", "text").select("doc_id", "chunk_index", "content_hash"), "chunks")
    first = chunks.join(t.documents.where("lang is not null").select("doc_id"), "doc_id", "left_semi").select("content_hash").distinct()
    out = None
    for run, have in ((1, first.limit(0)), (2, first)):
        seen = chunks.join(have.withColumn("_have", F.lit(1)), "content_hash", "left")
        one = seen.agg(F.lit(run).alias("run"), F.count("*").alias("chunks"), F.count_distinct(F.when(F.col("_have").isNull(), F.col("content_hash"))).alias("missing"), F.count("_have").alias("present"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT vec_id, label FROM embeddings WHERE len(embedding) = 64 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label DESC) = 1")
def vec10_upserted_vectors(t: Tables) -> DataFrame:
    """Vectors by id, of the right dimension, the last of each."""
    from ..operators.current import best_row

    return best_row(t.embeddings.where(F.size("embedding") == 64), ["vec_id"], [F.desc("label")]).select("vec_id", "label")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda e: (e::DOUBLE / n) * (e::DOUBLE / n))), 6) AS squared FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE))) AS n FROM embeddings)")
def vec11_unit_vectors(t: Tables) -> DataFrame:
    u = vectors.unit(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(F.aggregate(u, F.lit(0.0), lambda s, e: s + e * e), 6).alias("squared"))


QUESTION = "shortage of ration and water in the ward"
TERMS = rt.terms_of(QUESTION)


def _norm(e: str) -> str:
    return f"lower(trim(regexp_replace({e}, '{SPACES}', ' ', 'g')))"


def _joined(c: str) -> str:
    return f"array_to_string(list_filter(coalesce({c}, []), lambda q: trim(q) <> ''), ' ')"


CANDIDATES = f"""(SELECT * FROM (SELECT a.*, r.title, r.source_name, r.clean_text_original FROM ai_analysis a JOIN raw_items r ON r.id = a.raw_item_id WHERE r.source_type = 'news' AND {GATE} ORDER BY a.created_at DESC NULLS LAST, a.id DESC LIMIT 1000)
 QUALIFY row_number() OVER (PARTITION BY raw_item_id ORDER BY created_at DESC NULLS LAST, id DESC) = 1)"""
SCORES = f"""(SELECT *, ti || ' ' || qu || ' ' || su || ' ' || la || ' ' || bo AS every FROM (SELECT *, {_norm("coalesce(title, '')")} AS ti, {_norm(_joined('evidence_quotes_original') + " || ' ' || " + _joined('evidence_quotes_english'))} AS qu, {_norm("coalesce(summary_english, '') || ' ' || coalesce(summary_original, '')")} AS su,
 {_norm(" || ' ' || ".join([*(f"coalesce({c}, '')" for c in rt.LABEL_COLUMNS), _joined('positive_points'), _joined('negative_points')]))} AS la, {_norm("coalesce(clean_text_original, '')")} AS bo FROM {CANDIDATES}))"""
SCORE = f"CASE WHEN contains(every, '{QUESTION}') THEN 12 ELSE 0 END + " + " + ".join(f"contains({c}, '{w}')::INT * {n}" for w in TERMS for c, n in (("ti", 7), ("qu", 6), ("su", 5), ("la", 4), ("bo", 1))) + " + (" + " AND ".join(f"contains(every, '{w}')" for w in TERMS) + f")::INT * {min(len(TERMS), 5)}"


def _news(t: Tables) -> DataFrame:
    return t.raw_items.where("source_type = 'news'").select("id", "title", "source_name", "clean_text_original")


@query(f"SELECT raw_item_id, id AS analysis_id, score::BIGINT AS score FROM (SELECT raw_item_id, id, {SCORE} AS score FROM {SCORES}) WHERE score > 0 ORDER BY score DESC, raw_item_id DESC LIMIT 8")
def ent10_keyword_retrieval(t: Tables) -> DataFrame:
    """The evidence for a question: all six parts count, over the newest joined rows."""
    return rt.retrieve(_news(t), t.ai_analysis, QUESTION).select("raw_item_id", "analysis_id", "score")


@query()
def srt9_evidence(t: Tables) -> DataFrame:
    """The same with what is shown of it, three rows."""
    return rt.retrieve(_news(t), t.ai_analysis, QUESTION, 3)


QUESTIONS = ("what did renomani nothulamani say about water in sosaakulam", "Which department halted the bridge in Rosipatti?", "ரோசிபட்டி குடிநீர் பற்றி என்ன?")
ASKED = " UNION ALL ".join(f"""SELECT * FROM (SELECT '{q}' AS question, slug, max(length(normalized))::INTEGER AS letters FROM n WHERE CASE WHEN regexp_matches(normalized, '^[\\x00-\\x7F]{{1,3}}$') THEN contains(' ' || regexp_replace('{' '.join(q.lower().split())}', '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g') || ' ', ' ' || normalized || ' ') ELSE contains('{' '.join(q.lower().split())}', normalized) END GROUP BY 2 ORDER BY letters DESC, slug LIMIT 3)""" for q in QUESTIONS)


@query(f"WITH n AS (SELECT a.normalized, e.slug FROM entity_aliases a JOIN entities e ON e.id = a.entity_id WHERE e.status <> 'candidate' AND trim(coalesce(a.normalized, '')) <> '') SELECT question, slug, letters, row_number() OVER (PARTITION BY question ORDER BY letters DESC, slug)::INTEGER AS rank FROM ({ASKED})")
def ent9_question_entities(t: Tables) -> DataFrame:
    """The entities that questions name, by the longest alias, three at most."""
    return rt.question_entities(list(QUESTIONS), t.entities, t.entity_aliases)


@query(f"""WITH w AS (SELECT id, regexp_replace(unnest(l), '^_+|_+$', '', 'g') AS w, generate_subscripts(l, 1) AS p FROM (SELECT id, regexp_extract_all(lower(title), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS l FROM raw_items WHERE title IS NOT NULL)),
 f AS (SELECT id, w, min(p) AS p FROM w WHERE length(w) >= 2 AND w NOT IN ('the','and','of','in','to','a','is','for','on','what','who') GROUP BY 1, 2)
 SELECT id AS raw_item_id, string_agg(w, ' ' ORDER BY p) AS terms FROM f GROUP BY 1""")
def str9_query_terms(t: Tables) -> DataFrame:
    made = t.raw_items.where("title is not null").select(F.col("id").alias("raw_item_id"), F.array_join(x.query_terms(F.col("title")), " ").alias("terms"))
    return made.where("terms <> ''")


def _short(c: str) -> str:
    return f"CASE WHEN length({c}) <= 320 THEN {c} ELSE rtrim(substr({c}, 1, 317)) || '...' END"


WINDOW = f"CASE WHEN seen IS NULL OR seen = 0 THEN {_short('cl')} ELSE (CASE WHEN st > 0 THEN '...' ELSE '' END) || trim(substr(cl, st + 1, 320)) || (CASE WHEN st + 320 < length(cl) THEN '...' ELSE '' END) END"


@query(f"""WITH b AS (SELECT a.raw_item_id, list_filter(coalesce(evidence_quotes_original, []) || coalesce(evidence_quotes_english, []), lambda q: trim(q) <> '') AS q, nullif(trim(coalesce(summary_english, '')), '') AS s, {bare('r.clean_text_original')} AS cl FROM {GRAPH_BEST} a JOIN raw_items r ON r.id = a.raw_item_id),
 c AS (SELECT *, {bare("coalesce(list_filter(q, lambda v: contains(lower(v), 'water') OR contains(lower(v), 'road'))[1], q[1], s)")} AS c, coalesce(nullif(strpos(lower(cl), 'water'), 0), strpos(lower(cl), 'road')) AS seen FROM b),
 d AS (SELECT *, greatest(0, seen - 1 - 106) AS st FROM c) SELECT raw_item_id, CASE WHEN c <> '' THEN {_short('c')} ELSE {WINDOW} END AS snippet FROM d""")
def str10_snippets(t: Tables) -> DataFrame:
    """What is shown of an item for two terms: a quote, else the summary, else the text around a term."""
    from ..operators.current import current_analyses

    best = current_analyses(t.ai_analysis.select("id", "raw_item_id", "model_name", "created_at", "evidence_quotes_original", "evidence_quotes_english", "summary_english"))
    joined = best.join(t.raw_items.select(F.col("id").alias("raw_item_id"), "clean_text_original"), "raw_item_id")
    none = F.array().cast("array<string>")
    quotes = F.concat(F.coalesce("evidence_quotes_original", none), F.coalesce("evidence_quotes_english", none))
    return joined.select("raw_item_id", x.snippet(quotes, F.col("summary_english"), F.col("clean_text_original"), ["water", "road"]).alias("snippet"))


@query("""SELECT reviewer_name AS conversation, concat_ws(' ', trim(arg_max(note, id) FILTER (status <> 'escalated' AND trim(coalesce(note, '')) <> '')), 'and the bridge?') AS query FROM review_decisions WHERE reviewer_name IS NOT NULL GROUP BY 1""")
def str14_retrieval_queries(t: Tables) -> DataFrame:
    """The last note of each reviewer before a question; notes on escalations count as another's turn."""
    turns = t.review_decisions.where("reviewer_name is not null").select(F.col("reviewer_name").alias("conversation"), F.col("id").alias("turn"), F.when(F.col("status") == "escalated", "assistant").otherwise("user").alias("role"), F.col("note").alias("text"))
    return rt.retrieval_query(turns, "and the bridge?")


@query(f"""SELECT id AS raw_item_id, CASE WHEN title = '' THEN 'state' ELSE coalesce(nullif(array_to_string(list_slice(list_filter(regexp_split_to_array(replace(replace(replace(title, '|', ' '), ':', ' '), '·', ' '), '{SPACES}'), lambda w: length(w) > 2), 1, 8), ' '), ''), 'state') || ' state' END AS query FROM (SELECT id, coalesce(title, '') AS title FROM raw_items)""")
def str15_theme_queries(t: Tables) -> DataFrame:
    """Titles as queries for another service: eight longer words and where."""
    return t.raw_items.select(F.col("id").alias("raw_item_id"), x.theme_query(F.col("title"), "state").alias("query"))


@query("""SELECT raw_item_id, rank::INTEGER AS rank, source_name FROM (SELECT raw_item_id, source_name, row_number() OVER (ORDER BY raw_item_id DESC) AS rank FROM (SELECT id AS raw_item_id, source_name, ingested_at FROM raw_items ORDER BY ingested_at DESC, id DESC LIMIT 200)) WHERE rank <= 12""")
def srt12_second_order_page(t: Tables) -> DataFrame:
    """The first page of twelve of the newest 200."""
    newest = t.raw_items.select(F.col("id").alias("raw_item_id"), "source_name", "ingested_at").orderBy(F.desc("ingested_at"), F.desc("raw_item_id")).limit(200)
    at = Window.partitionBy(F.lit(0)).orderBy(F.desc("raw_item_id"))  # 200 rows
    return newest.withColumn("rank", F.row_number().over(at)).where("rank <= 12").select("raw_item_id", "rank", "source_name")
