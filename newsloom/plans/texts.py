"""Queries on texts, URLs, vectors and streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..functions.chunks import word_chunks
from ..operators import vectors
from ..sources import pages
from .registry import Tables, query

SPACE = r"trim(regexp_replace({0}, '[\s ]+', ' ', 'g'))"


@query("SELECT id AS raw_item_id, source_type, source_name FROM raw_items WHERE source_type = 'news'")
def src1_scan_news(t: Tables) -> DataFrame:
    return t.raw_items.where("source_type = 'news'").select(F.col("id").alias("raw_item_id"), "source_type", "source_name")


@query()
def src3_listing_links(t: Tables) -> DataFrame:
    return pages.parse_listings(t.raw_items.where("source_type in ('news', 'press_release')"), "id", "raw_text_original", "source_url")


@query()
def src4_article_text(t: Tables) -> DataFrame:
    return pages.extract_articles(t.raw_items.where("source_type in ('news', 'press_release')"), "id", "raw_text_original")


@query("SELECT id AS raw_item_id, source_url FROM raw_items WHERE starts_with(source_url, 'https://vethukulam0.example/')")
def src12_prefix_lookup(t: Tables) -> DataFrame:
    return t.raw_items.where(F.col("source_url").startswith("https://vethukulam0.example/")).select(F.col("id").alias("raw_item_id"), "source_url")


@query(r"""SELECT id AS raw_item_id, CASE WHEN regexp_matches(clean_text_original, '[\x{0B80}-\x{0BFF}]') AND regexp_matches(clean_text_original, '[A-Za-z]') THEN 'ta-en-mixed'
 WHEN regexp_matches(clean_text_original, '[\x{0B80}-\x{0BFF}]') THEN 'ta' WHEN regexp_matches(clean_text_original, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS label,
 round(length(regexp_replace(clean_text_original, '[^\x{0B80}-\x{0BFF}]', '', 'g')) / nullif(length(clean_text_original), 0)::DOUBLE, 6) AS tamil_share FROM raw_items WHERE clean_text_original <> ''""")
def str1_script_labels(t: Tables) -> DataFrame:
    c = F.col("clean_text_original")
    return t.raw_items.where(c != "").select(F.col("id").alias("raw_item_id"), x.script_label(c).alias("label"), F.round(x.share_of(c, x.TAMIL), 6).alias("tamil_share"))


@query(r"SELECT doc_id, round(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / length(text)::DOUBLE, 6) AS ascii_share, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / length(text)::DOUBLE >= 0.85 AS looks_english FROM documents WHERE text <> ''")
def str3_ascii_share(t: Tables) -> DataFrame:
    share = x.share_of(F.col("text"), r"[\x00-\x7F]")
    return t.documents.where("text <> ''").select("doc_id", F.round(share, 6).alias("ascii_share"), (share >= 0.85).alias("looks_english"))


@query(r"SELECT id AS entity_id, regexp_replace(regexp_replace(lower(canonical_name), '[^\p{L}\p{M}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM entities")
def str5_slugs(t: Tables) -> DataFrame:
    return t.entities.select(F.col("id").alias("entity_id"), x.slug(F.col("canonical_name")).alias("slug"))


@query(r"""SELECT id AS raw_item_id, CASE WHEN length(s) <= 80 THEN s ELSE rtrim(substr(s, 1, 79)) || '…' END AS short FROM (SELECT id, trim(regexp_replace(title, '[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS s FROM raw_items WHERE title IS NOT NULL)""")
def str7_short_titles(t: Tables) -> DataFrame:
    return t.raw_items.where("title is not null").select(F.col("id").alias("raw_item_id"), x.shortened(F.col("title"), 80).alias("short"))


@query()
def url1_normal_urls(t: Tables) -> DataFrame:
    return t.raw_items.select(F.col("id").alias("raw_item_id"), x.normal_url("source_url").alias("url"))


@query()
def flt9_safe_urls(t: Tables) -> DataFrame:
    return t.raw_items.select(F.col("id").alias("raw_item_id"), x.safe_url(F.col("source_url")).alias("safe"))


@query("SELECT id AS raw_item_id, sha256('{\"language\":' || to_json(coalesce(language, '')) || ',\"source_url\":' || to_json(source_url) || '}') AS hash FROM raw_items")
def hsh1_content_hash(t: Tables) -> DataFrame:
    return t.raw_items.select(F.col("id").alias("raw_item_id"), x.content_hash(source_url=F.col("source_url"), language=F.col("language")).alias("hash"))


@query("SELECT id AS raw_item_id, strftime(date_trunc('week', coalesce(published_at, ingested_at)::TIMESTAMP)::DATE, '%Y-%m-%d') AS week FROM raw_items")
def dt3_item_weeks(t: Tables) -> DataFrame:
    return t.raw_items.select(F.col("id").alias("raw_item_id"), F.date_format(F.date_trunc("week", F.coalesce("published_at", "ingested_at")), "yyyy-MM-dd").alias("week"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
 SELECT query_id, vec_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def vec2_cosine_topk(t: Tables) -> DataFrame:
    """Five nearest of each stated query: the vectors whose id is divisible by 20, against all."""
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.top_k(t.embeddings, asked, 5).select("query_id", "vec_id", "rank")


@query("SELECT label, count(*) AS n, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings GROUP BY 1")
def vec11_norms(t: Tables) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(norm), 6).alias("mean_norm"))


@query()
def vec7_chunks(t: Tables) -> DataFrame:
    cut = t.documents.select("doc_id", F.posexplode(word_chunks("text")).alias("chunk_index", "chunk_text"))
    return cut.withColumn("token_estimate", F.greatest(F.lit(1), F.floor(F.length("chunk_text") / 4)))


SPIKE = """WITH l AS (SELECT max(ts::DATE) AS as_of FROM events), d AS (SELECT user_id, datediff('day', ts::DATE, as_of) AS age, count(*) AS n, count(*) FILTER (event_type = 'error') AS neg FROM events CROSS JOIN l GROUP BY 1, 2),
 s AS (SELECT user_id, coalesce(sum(n) FILTER (age < 3), 0) AS recent, coalesce(sum(neg) FILTER (age < 3), 0) AS bad, coalesce(sum(n) FILTER (age BETWEEN 3 AND 12), 0) / 10.0::DOUBLE AS m, coalesce(sum(n * n) FILTER (age BETWEEN 3 AND 12), 0) / 10.0::DOUBLE AS q FROM d GROUP BY 1),
 z AS (SELECT *, (recent / 3.0::DOUBLE - m) / greatest(sqrt(greatest(q - m * m, 0)), 0.75) AS z FROM s WHERE recent >= 4)
 SELECT user_id, recent::BIGINT AS recent, bad::BIGINT AS recent_negative, round(m, 6) AS mean_daily, round(z, 6) AS z, bad / recent::DOUBLE >= 0.3 AS is_threat FROM z WHERE z >= 1"""


def event_marks(events: DataFrame) -> DataFrame:
    """Events as mentions of their users."""
    kind = F.create_map(*[F.lit(v) for pair in (("error", "negative"), ("purchase", "positive"), ("signup", "mixed")) for v in pair])
    return events.select(F.col("user_id").alias("entity_id"), F.col("user_id").cast("string").alias("slug"), F.to_date("ts").alias("day"), F.coalesce(kind[F.col("event_type")], F.lit("neutral")).alias("portrayal"), F.lit(0).alias("severity_rank"))


@query(SPIKE)
def spike_alerts(t: Tables) -> DataFrame:
    from ..operators.graph import as_of, spikes

    marks = event_marks(t.events)
    return spikes(marks, as_of(marks)).select(F.col("entity_id").alias("user_id"), "recent", "recent_negative", "mean_daily", "z", "is_threat")


@query("""SELECT user_id, strftime(date_trunc('week', ts)::DATE, '%Y-%m-%d') AS week_start, count(*) FILTER (event_type = 'purchase') AS pos, count(*) FILTER (event_type = 'error') AS neg FROM events GROUP BY 1, 2""")
def weekly_events(t: Tables) -> DataFrame:
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    return t.events.groupBy("user_id", week.alias("week_start")).agg(F.count_if(F.col("event_type") == "purchase").alias("pos"), F.count_if(F.col("event_type") == "error").alias("neg"))


@query("""SELECT n_name AS nation, count(DISTINCT o_orderkey) AS orders, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def dimension_rollup(t: Tables) -> DataFrame:
    """Every nation with its orders; orders are summed per customer before they are joined."""
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    by = t.customer.select("c_custkey", "c_nationkey").join(per, "c_custkey").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return t.nation.join(by, "n_nationkey", "left").select(F.col("n_name").alias("nation"), F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce(F.round("s", 2), F.lit(0.0)).alias("total"))


@query("SELECT part_a, part_b, n FROM (SELECT a.l_partkey AS part_a, b.l_partkey AS part_b, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2) WHERE n > 1")
def pair_counts(t: Tables) -> DataFrame:
    """Parts ordered together more than once; orders have a bounded number of lines."""
    a = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("part_a"))
    b = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("part_b"))
    return a.join(b, "l_orderkey").where("part_a < part_b").groupBy("part_a", "part_b").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3")
def longest_by_source(t: Tables) -> DataFrame:
    at = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return t.documents.select("source", "doc_id", "n_chars").withColumn("r", F.row_number().over(at)).where("r <= 3").drop("r")
