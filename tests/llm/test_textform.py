import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm.textform import consistent, is_suspect, to_consistent

CASES = {
    "Kοmo ｋｍ²": "Komo km²", "café": "café", "௧ைவிட்டனர் ௧௨௩": "கைவிட்டனர் ௧௨௩", "ெகாங்கு ொ": None, "Заря α-4": "Заря α-4",
    "з​аря": "заря", "क्‍षेत्र": "क्‍षेत्र", "ﬁne": "fine", "⚠️ 👨‍👩‍👧": "⚠️ 👨‍👩‍👧", "a b　c d": "a b c d", "मंत्⁠री": "मंत्री", "क़लम": "क़लम",
    "½ “q” – …": "½ “q” – …", "​": "", "x ​ y": "x  y",
}


def test_plain_rule():
    for text, want in CASES.items():
        if want is not None:
            assert consistent(text) == want, text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abKéé о ο௧கொை்​‍ﬁＡ क्षक़़1 ", max_size=20))
def test_idempotent(text):
    once = consistent(text)
    assert consistent(once) == once
    assert is_suspect(text) or once == text


def test_spark_gives_the_same(spark):
    texts = [*CASES, "plain", "", None, "tamil ொ ௧கக", "x" * 3000 + " сourt", "a\nb c"]
    rows = [(i if i != 3 else None, t, "clash") for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "id long, text string, _tok string")
    got = {(r["id"], r["text"]): r["text_new"] for r in to_consistent(df, ["id"]).collect()}
    for i, t, _ in rows:
        if t is not None:
            assert got.get((i, t), t) == consistent(t), ascii(t)
    assert to_consistent(df.limit(0), ["id"]).count() == 0


@pytest.mark.parametrize("field", ["title", "clean_text_original"])
def test_whole_table_against_the_plain_rule(spark, field):
    from pyspark.sql import functions as F

    items = spark.read.parquet("/root/testdata/sf0.001/raw_items.parquet").select("id", F.col(field).alias("text"))
    got = {r["id"]: r["text_new"] for r in to_consistent(items, ["id"]).collect()}
    for r in items.collect():
        if r["text"] is not None:
            assert got.get(r["id"], r["text"]) == consistent(r["text"])
