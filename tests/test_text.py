from newsloom.functions import text as x
from newsloom.functions.chunks import chunks
from pyspark.sql import functions as F


def test_urls():
    assert x.plain_url("HTTPS://News.Example/a?utm_source=f&b=&B=1#top") == "https://news.example/a?b=&B=1"
    assert x.plain_url(None) is None
    assert x.is_safe_url("https://a.news.example/x", ("news.example",))
    for bad in ("ftp://news.example", "http://localhost/", "http://10.0.0.1/", "https://evilnews.example", "http://[::1]/", None, ""):
        assert not x.is_safe_url(bad, ("news.example",) if bad and "evil" in bad else ())


def test_surface_keys(spark):
    df = spark.createDataFrame([("Dr. Straße​ ",), ("é",), ("é",), (None,)], "s string")
    keys = [r[0] for r in df.select(x.surface_key("s")).collect()]
    assert keys[0] == "dr strasse" and keys[1] == keys[2] == "é" and keys[3] is None


def test_chunks_cover_and_overlap():
    text = "one two three four five six seven eight nine ten eleven twelve"
    out = chunks(text, 36, 8)
    assert all(len(c) <= 36 for c in out) and out[0].split()[-1] == out[1].split()[0]
    assert chunks("", 36, 8) == [] and chunks("x" * 99, 36, 8) == ["x" * 99] and chunks("a b", 3, 0) == ["a b"]
    assert " ".join(chunks(text, 10, 0)) == text


def test_columns(spark):
    df = spark.createDataFrame([("அரசுnews wins. Next one",), (None,), ("",)], "s string")
    r = df.select(x.script_label(F.col("s")), x.first_sentence(F.col("s")), x.has_word(F.col("s"), "news"), x.query_terms(F.col("s"))).collect()
    assert r[0][0] == "ta-en-mixed" and r[0][1].endswith("wins.") and r[0][2] is True and r[1][0] == "unknown"
