"""Retrieval over analysed items: terms, candidates, weighted scores, answers from evidence alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut_with_dots, snippet, squeezed
from .current import best_row, policy, relevant

STOP = ("the", "and", "of", "in", "to", "a", "is", "for", "on", "what", "who", "about", "with", "are", "was")
#: What a term is worth where it is found, what an exact match is worth, its least length, and the most that all terms together add.
TITLE, QUOTES, SUMMARY, LABELS, BODY, EXACT, EXACT_LETTERS, ALL_TERMS = 7, 6, 5, 4, 1, 12, 4, 5
CANDIDATES = 1000
LABEL_COLUMNS = ("source_name", "stance_toward_government", "target", "department", "district", "topic", "issue_category")


def terms_of(question: str, stop: tuple[str, ...] = STOP) -> list[str]:
    """Words of two characters and more, in order, each once, without stop words."""
    words = [w.strip("_") for w in re.findall(r"[\w஀-௿]+", question.lower())]
    return list(dict.fromkeys(w for w in words if len(w) >= 2 and w not in stop))


def retrieval_query(turns: DataFrame, question: str) -> DataFrame:
    """(conversation, query): the last turn of the user before the question; with no such turn the question alone. turns: conversation, turn, role, text."""
    last = turns.where("role = 'user' and trim(coalesce(text, '')) <> ''").groupBy("conversation").agg(F.max_by("text", "turn").alias("_last"))
    every = turns.select("conversation").distinct().join(last, "conversation", "left")
    return every.select("conversation", F.concat_ws(" ", F.trim("_last"), F.lit(question)).alias("query"))


def candidates(items: DataFrame, analyses: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The newest `most` joined rows of relevant analyses and items, of which each item keeps its newest: the bound comes first, as it is part of the feature. Only ids are ranked; texts join afterwards."""
    ids = analyses.where(relevant()).select("id", "raw_item_id", "created_at").join(items.select(F.col("id").alias("raw_item_id")), "raw_item_id")
    newest = best_row(ids.orderBy(*policy("chat")).limit(most), ["raw_item_id"], policy("chat")).select(F.col("id").alias("analysis_id"))
    said = F.broadcast(newest).join(analyses.withColumnRenamed("id", "analysis_id").drop("created_at"), "analysis_id")  # `most` rows
    return said.join(items.withColumnRenamed("id", "raw_item_id"), "raw_item_id")


def _list(c: str) -> Column:
    return F.array_join(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda q: F.trim(q) != ""), " ")


def scored(rows: DataFrame, question: str, terms: list[str]) -> DataFrame:
    """Adds `score`: what the exact question and each of its terms are worth in the parts of a row in which they are found."""
    n = lambda c: F.lower(squeezed(c))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    labels = F.concat_ws(" ", *[empty(c) for c in LABEL_COLUMNS], _list("positive_points"), _list("negative_points"))
    parts = {"_title": (n(empty("title")), TITLE), "_quotes": (n(F.concat_ws(" ", _list("evidence_quotes_original"), _list("evidence_quotes_english"))), QUOTES), "_summary": (n(F.concat_ws(" ", empty("summary_english"), empty("summary_original"))), SUMMARY), "_labels": (n(labels), LABELS), "_body": (n(empty("clean_text_original")), BODY)}
    held = rows.withColumns({k: c for k, (c, _) in parts.items()}).withColumn("_all", F.concat_ws(" ", *parts))
    exact = " ".join(question.lower().split())
    score = F.when(F.contains("_all", F.lit(exact)), EXACT).otherwise(0) if len(exact) >= EXACT_LETTERS else F.lit(0)
    for t in terms:
        for k, (_, worth) in parts.items():
            score = score + F.contains(k, F.lit(t)).cast("int") * worth
    for_all = F.lit(True)
    for t in terms:
        for_all = for_all & F.contains("_all", F.lit(t))
    score = score + for_all.cast("int") * min(len(terms), ALL_TERMS)
    return held.withColumn("score", score.cast("long")).drop("_all", *parts)


def retrieve(items: DataFrame, analyses: DataFrame, question: str, limit: int = 8) -> DataFrame:
    """(raw_item_id, analysis_id, score, title, source_name, stance, summary, snippet): the evidence for a question, best first, ties by item; 1 to 8 rows, none where nothing fits or the question has no term."""
    terms = terms_of(question)
    rows = scored(candidates(items, analyses), question, terms) if terms else candidates(items, analyses).withColumn("score", F.lit(0).cast("long"))
    quotes = F.concat(F.coalesce("evidence_quotes_original", F.array().cast("array<string>")), F.coalesce("evidence_quotes_english", F.array().cast("array<string>")))
    summary = F.coalesce(F.nullif(F.trim("summary_english"), F.lit("")), F.nullif(F.trim("summary_original"), F.lit("")), F.lit(""))
    best = rows.where("score > 0").orderBy(F.desc("score"), F.desc("raw_item_id")).limit(max(1, min(limit, 8)))
    return best.select("raw_item_id", "analysis_id", "score", "title", "source_name", F.col("stance_toward_government").alias("stance"), summary.alias("summary"), snippet(quotes, summary, F.col("clean_text_original"), terms).alias("snippet"))


def question_entities(questions: list[str], entities: DataFrame, aliases: DataFrame, limit: int = 3) -> DataFrame:
    """(question, slug, letters, rank): the entities that each question names, those with the longest alias first. An ASCII alias of up to three letters must stand as a word; any other is found anywhere."""
    kept = entities.where("status <> 'candidate'").select(F.col("id").alias("entity_id"), "slug")
    named = aliases.where("trim(coalesce(normalized, '')) <> ''").select("entity_id", "normalized").join(kept, "entity_id")
    out = None
    for q in questions:
        text = " ".join(q.lower().split())
        short = F.col("normalized").rlike(r"^[\x00-\x7F]{1,3}$")
        spaced = F.lit(" " + re.sub(r"[^\w]+", " ", text) + " ")
        hit = F.when(short, F.contains(spaced, F.concat(F.lit(" "), "normalized", F.lit(" ")))).otherwise(F.contains(F.lit(text), F.col("normalized")))
        one = named.where(hit).groupBy("slug").agg(F.max(F.length("normalized")).alias("letters")).orderBy(F.desc("letters"), "slug").limit(limit).select(F.lit(q).alias("question"), "slug", "letters")
        out = one if out is None else out.union(one)
    from pyspark.sql import Window

    at = Window.partitionBy("question").orderBy(F.desc("letters"), "slug")
    return out.withColumn("rank", F.row_number().over(at))


def evidence_answer(evidence: DataFrame, context: str = "") -> str:
    """An answer made of the evidence alone, of at most three rows; what is known of entities goes first."""
    rows = evidence.orderBy(F.desc("score"), F.desc("raw_item_id")).limit(3).collect()
    if not rows:
        return "Nothing that is stored answers this."
    lines = ["From all coverage:", *context.strip().splitlines(), ""] if context.strip() else []
    lines.append("From stored items:")
    for n, r in enumerate(rows, 1):
        said = r["summary"] or r["snippet"]
        lines.append(f"{n}. {said} ({r['source_name']}, {r['stance']})." + (f" Evidence: {r['snippet']}" if r["snippet"] and r["snippet"] != said else ""))
    return "\n".join([*lines, "Open the source before this is used."])


def dossier_line() -> Column:
    """One line on an entity, from the columns of a dossier."""
    told = F.concat(F.lit("- "), "name", F.when(F.coalesce("party", F.lit("")) != "", F.concat(F.lit(" ("), "party", F.lit(")"))).otherwise(""), F.lit(": "), F.col("mentions").cast("string"), F.lit(" mentions ("), F.col("mentions_30d").cast("string"), F.lit(" in 30 days), favourability "), F.coalesce(F.col("favourability").cast("string"), F.lit("n/a")), F.lit(", "), "dominant")
    more = lambda c, label: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"; {label}: "), c)).otherwise("")
    return F.concat(told, more("top_categories", "issues"), more("top_districts", "districts"), more("co_mentions", "with"))


__all__ = ["candidates", "cut_with_dots", "dossier_line", "evidence_answer", "question_entities", "retrieval_query", "retrieve", "scored", "terms_of"]
