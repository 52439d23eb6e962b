from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import pieces


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n!।", max_size=400), st.integers(20, 60), st.integers(0, 15))
def test_round_trip(text, limit, overlap):
    out = pieces.spans(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b in out)
    assert "".join(text[a if n == 0 else max(a, out[n - 1][1]) : b] for n, (a, b) in enumerate(out)) == text
    for (a, b), (c, d) in zip(out, out[1:]):
        assert a < c <= b <= c + overlap and d > b
        assert c < b or not overlap or b - a == 1


def test_overlap_falls_through_the_hierarchy():
    out = pieces.spans("x" * 5000)
    assert all(b - c == 200 for (_, b), (c, _) in zip(out, out[1:]))
    words = "abcdefghi " * 300
    out = pieces.spans(words)
    assert all(0 < b - c <= 200 and words[c - 1] == " " for (_, b), (c, _) in zip(out, out[1:]))
    long = "One sentence of words " * 53 + "ends. " + "Then " * 236 + "it ends. " + "And more. " * 10
    out = pieces.spans(long)
    assert all(0 < b - c <= 200 for (_, b), (c, _) in zip(out, out[1:]))


def test_boundaries(spark):
    text = "One two three. " * 60 + "\n\n" + "Four five six. " * 60
    first, second = pieces.spans(text)[:2]
    assert text[: first[1]].endswith("\n\n") and second[0] >= first[1] - 200
    assert text[second[0]:].startswith(("One", "Four"))
    df = spark.createDataFrame([(1, text, 0), (2, "", 0), (3, None, 0), (4, "short", 0), (4, "short", 0), (5, "x" * 5000, 0)], "id long, t string, piece_no int")
    rows = pieces.cut(df, "id", "t").collect()
    assert {r["id"] for r in rows} == {1, 4, 5} and sum(r["id"] == 4 for r in rows) == 2
    back = "".join(r["piece"][r["overlap"]:] for r in sorted((r for r in rows if r["id"] == 1), key=lambda r: r["piece_no"]))
    assert back == text and all(len(r["piece"]) <= 1200 for r in rows)
    assert pieces.cut(df.limit(0), "id", "t").count() == 0
