import random

from newsloom.llm import langid

from .fixtures import entities, items

SAMPLES = "/root/testdata/sf0.001/lang_samples.parquet"


def test_held_out_accuracy(spark):
    rows = langid.training_rows(spark.read.parquet(SAMPLES))
    random.seed(2)
    random.shuffle(rows)
    known = langid.Classifier(rows[:200])
    tried = [(lang, known.language(p)[0]) for lang, t in rows[200:] for p in langid.segments(t)]
    assert sum(a == b for a, b in tried) >= 0.98 * len(tried)


def test_labels(spark):
    rows = langid.training_rows(spark.read.parquet(SAMPLES))
    by = {}
    for lang, text in rows:
        if text.isascii() or lang not in ("en", "ta"):
            by.setdefault(lang, text)
    tamil = next(t for lang, t in rows if lang == "ta" and not t.isascii())
    data = [
        (1, "en", by["en"]), (2, "EN-in", by["en"]), (3, "fr", by["en"]), (4, None, by["fr"]), (5, "ta-en-mixed", tamil + "\n" + by["en"]), (6, "ta", tamil + "\n" + by["en"]),
        (7, "unknown", "🔔 1/2"), (8, "ta", "🔔 1/2"), (9, "mr", by["hi"]), (10, "Hindi", by["hi"]), (11, "en", None), (12, "", "https://a.example/b"),
    ]
    df = items(spark, [dict(id=i, source_name=f"s{i}", language=lang, clean_text_original=t) for i, lang, t in data])
    found = langid.item_languages(df, *entities(spark), spark.read.parquet(SAMPLES))
    got = {(r[0], r[1]) for r in langid.wrong_labels(df, found).collect()}
    assert got == {(3, "en"), (4, "fr"), (6, "ta"), (6, "en"), (8, "unknown"), (9, "hi"), (12, "unknown")}
    assert langid.item_languages(df.limit(0), *entities(spark), spark.read.parquet(SAMPLES)).count() == 0


def test_every_segment_has_its_row(spark):
    rows = langid.training_rows(spark.read.parquet(SAMPLES))
    en = next(s for lang, t in rows if lang == "en" for s in langid.segments(t)).strip()
    ta = next(s for lang, t in rows if lang == "ta" and not t.isascii() for s in langid.segments(t)).strip()
    text = f"{en} {ta}\n\nhttps://a.example/b {ta} {en}\nGood morning."
    found = langid.item_segments(items(spark, [dict(id=1, source_name="s", clean_text_original=text), dict(id=2)]), *entities(spark), spark.read.parquet(SAMPLES)).collect()
    parts = sorted((r for r in found if r["segment"]), key=lambda r: r["segment"])
    assert [r["language"] for r in parts[:4]] == ["en", "ta", "ta", "en"] and [r["segment"] for r in parts] == [1, 2, 3, 4, 5]
    assert [text[r["start"] : r["end"]] for r in parts] == [en, ta, ta, en, "Good morning."] and all(r["confidence"] > 0 for r in parts)
    assert {(r["raw_item_id"], r["language"]) for r in found if not r["segment"]} == {(1, "en"), (1, "ta")}
