import random
from datetime import datetime

import numpy as np

from newsloom.operators import clusters as cl
from newsloom.operators.vectors import DIMENSION, assign_in_order

WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in ("al", "en", "or", "um") for c in ("is", "ot", "ak", "ey", "un")]


def test_one_pass_over_all_items(spark):
    random.seed(4)
    rows = []
    for i in range(120):
        if i % 3 == 0:
            base = random.choices(WORDS, k=60)
        words = list(base)
        for _ in range(random.randint(0, 6)):
            words[random.randrange(60)] = random.choice(WORDS)
        rows.append((i, random.randint(0, 50), " ".join(words)))
    rows += [(200, 5, None), (201, 6, ""), (202, 7, rows[0][2])]
    df = spark.createDataFrame(rows, "id long, ord long, text string")
    m = {r["id"]: (r["buckets"], r["counts"]) for r in cl.lead_vectors(df).collect()}
    order = sorted(rows, key=lambda r: (-r[1], -r[0]))
    dense = np.zeros((len(order), DIMENSION))
    for k, (i, _, _) in enumerate(order):
        dense[k, m[i][0]] = m[i][1]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)
    for threshold, mode in ((0.85, "best"), (0.7, "first")):
        want, first = {}, {}
        for (i, _, _), c in zip(order, assign_in_order(dense, threshold, mode)):
            if c >= 0:
                want[i] = first.setdefault(c, i)
        got = {r["id"]: r["cluster_id"] for r in cl.story_clusters(df, threshold, mode).collect()}
        assert got == want and len(set(want.values())) < len(want)
    assert cl.story_clusters(df.limit(0)).count() == 0


def _by_pass(df, threshold, mode):
    rows = sorted(cl.lead_vectors(df).collect(), key=lambda r: (-r["ord"], -r["id"]))
    dense = np.zeros((len(rows), DIMENSION))
    for k, r in enumerate(rows):
        dense[k, r["buckets"]] = r["counts"]
    want, first = {}, {}
    for r, c in zip(rows, assign_in_order(dense / np.linalg.norm(dense, axis=1, keepdims=True), threshold, mode)):
        want[r["id"]] = first.setdefault(c, r["id"])
    return want


def test_like_items_that_share_few_words_and_blocks(spark):
    """Each story is two words said often, among words of the item alone; and there are more items than a block holds."""
    rows = [(i, i * 7 % 1500, " ".join([f"story{i % 40}"] * 9 + [f"again{i % 40}"] * 8 + [f"own{i}x{k}" for k in range(i % 31)])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, ord long, text string")
    for threshold, mode in ((0.85, "best"), (0.7, "first")):
        want = _by_pass(df, threshold, mode)
        assert {r["id"]: r["cluster_id"] for r in cl.story_clusters(df, threshold, mode).collect()} == want
        assert len(set(want.values())) < 600
    vectors = cl.lead_vectors(df).where("size(buckets) > 0")
    held = {r["id"]: r["component"] for r in cl.components(vectors, 0.49).collect()}
    assert len(set(held.values())) <= 40
    # Links of a forest for each two blocks, not all pairs of a story.
    assert cl._links(vectors, 0.49).count() < 3 * 1500


def test_links_are_connected_alike_by_one_task_and_by_rounds(spark, monkeypatch):
    rows = [(i, i, " ".join([f"story{i % 5}"] * 3 + [f"own{i}"])) for i in range(40)] + [(50, 1, "alone"), (51, 2, "story1 story1 story1 own1")]
    vectors = cl.lead_vectors(spark.createDataFrame(rows, "id long, ord long, text string"))
    groups = lambda: {frozenset(r["ids"]) for r in cl.components(vectors, 0.7).groupBy("component").agg({"id": "collect_list"}).toDF("component", "ids").collect()}
    one = groups()
    monkeypatch.setattr(cl, "FEW_LINKS", 0)
    assert groups() == one and len(one) == 6


def test_cards(spark):
    schema = "cluster_id long, id long, ord long, analysis_id long, title string, source_name string, government_relevance string, portrayal string, severity string, action_priority string, needs_human_review boolean, public_issue string, department string, district string, summary string, published_at timestamp, ingested_at timestamp, people_issue boolean"
    row = lambda c, i, rel, p, title, people=False, rev=False: (c, i, i, i * 10, title, f"s{i}", rel, p, "low", "low", rev, "", "", "", "", None, None, people)
    rows = [row(1, 1, "high", "neutral", "a"), row(1, 2, "high", "neutral", "longer", True), row(1, 3, "low", "negative", "longest title"), row(2, 4, "none", "positive", "x"), row(3, 5, None, "positive", None, rev=True)]
    df = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in cl.representatives(df).collect()} == {(1, 2), (2, 4), (3, 5)}
    none = spark.createDataFrame([], "id long, corrected string")
    got = {r["cluster_id"]: r for r in cl.cards(df, none).collect()}
    assert set(got) == {1, 3} and (got[1]["category"], got[1]["size"], got[1]["sources"], got[1]["dominant"]) == ("people", 3, 3, "neutral")
    said = spark.createDataFrame([(1, "mixed"), (3, "negative")], "id long, corrected string")
    assert {r["cluster_id"]: r["category"] for r in cl.cards(df, said).collect()} == {1: "negative", 3: "positive"}


def test_lead_vectors_are_made_once_for_the_queries_on_clusters(spark, tmp_path, monkeypatch):
    from newsloom.plans import QUERIES

    schema = "id long, source_type string, ingested_at timestamp, clean_text_original string"
    rows = [(1, "news", "rain floods city"), (2, "news", "rain floods city"), (3, "news", None), (4, "news", ""), (5, "post", "rain"), (6, "news", "budget vote")]
    spark.createDataFrame([(i, kind, datetime(2024, 1, i), text) for i, kind, text in rows], schema).write.parquet(f"{tmp_path}/raw_items.parquet")
    made, real = [], cl.lead_vectors
    monkeypatch.setattr(cl, "lead_vectors", lambda *a: made.append(1) or real(*a))
    got = {tuple(r) for r in QUERIES["set2_stories_and_single_items"](spark, str(tmp_path)).collect()}
    assert got == {(2, "cluster"), (6, "cluster"), (3, "without_vector"), (4, "without_vector")}
    assert {tuple(r) for r in QUERIES["clu1_theme_clusters"](spark, str(tmp_path)).collect()} == {(1, 2, 2), (2, 2, 2)}
    assert len(made) == 1
