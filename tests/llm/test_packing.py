import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9))
def test_bound_and_fit(sizes):
    n = np.array(sizes, np.int64)
    box = packing.best_fit(n, 30)
    assert not len(n) or np.bincount(box, weights=n).max() <= 30
    bound = packing.lower_bound(n, 30)
    used = len(set(box.tolist()))
    assert bound <= used

    def fewest(left, rooms):
        if not left:
            return len(rooms)
        best = 99
        for i in range(len(rooms)):
            if rooms[i] >= left[0]:
                best = min(best, fewest(left[1:], rooms[:i] + (rooms[i] - left[0],) + rooms[i + 1 :]))
        return min(best, fewest(left[1:], (*rooms, 30 - left[0])))

    if len(sizes) <= 6:
        assert bound <= fewest(tuple(sizes), ()) <= used


def test_whole_and_full(spark):
    random.seed(1)
    rows = [(i, random.randint(1, 3000)) for i in range(800)] + [(900, None), (901, 0), (902, 9000)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, tokens long"), group=100).toPandas()
    assert out.groupby("container").tokens.sum().max() <= 2048
    whole = {i: n for i, n in rows if n}
    assert out.groupby("doc_id").tokens.sum().to_dict() == whole
    assert all(len(g) == -(-whole[i] // 2048) for i, g in out.groupby("doc_id"))
    assert out.container.nunique() <= 1.02 * sum(whole.values()) / 2048 + 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens long")).count() == 0
    assert all((f.certified == (f.bound == f.used)).all() and f.bound.nunique() == 1 for _, f in out.groupby("partition"))
    proof = {r["partition"]: r for r in packing.certificate(spark.createDataFrame(out)).collect()}
    assert proof["all"]["containers"] == out.container.nunique() and 0 <= proof["all"]["gap"] <= 10
    assert proof["all"]["bound"] == packing.lower_bound(out.tokens.to_numpy())


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in packing.token_counts(df, "doc_id", "text").collect()}
    assert set(got) == {1, 4} and got[1] >= 2 and got[4] > 1
