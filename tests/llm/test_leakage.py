import random

import numpy as np

from newsloom.llm import leakage as k

VOCAB = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]


def plain(item, doc):
    """Brute force: whether a passage of the item is within the tolerance of a passage of the doc."""
    a, b = np.array(item), np.array(doc)
    for i in range(len(a)):
        for n in range(k.LEAST_WORDS, min(len(a) - i, 20) + 1):
            limit = n // k.WORDS_PER_EDIT
            for s in range(len(b)):
                for m in range(n - limit, n + limit + 1):
                    if s + m <= len(b) and a[i] == b[s] and a[i + n - 1] == b[s + m - 1] and k._edits(a[i : i + n], b[s : s + m], limit) <= limit:
                        return True
    return False


def test_against_brute_force(spark):
    random.seed(5)
    items, docs = [], []
    for i in range(6):
        items.append((i, random.sample(VOCAB, 24)))
    for d in range(24):
        item = items[d % 6][1]
        start, n = random.randint(0, 6), random.randint(11, 18)
        part = list(item[start : start + n])
        for _ in range(d % 4):
            at = random.randrange(len(part))
            part[at : at + random.randint(0, 1)] = [random.choice(VOCAB)] * random.randint(0, 1)
        docs.append((d, random.sample(VOCAB, 5) + part + random.sample(VOCAB, 5)))
    want = {(d, i) for d, w in docs for i, v in items if plain(v, w)}
    dd = spark.createDataFrame([(d, ", ".join(w).upper()) for d, w in docs] + [(99, None), (98, "")], "doc_id long, text string")
    ii = spark.createDataFrame([(i, "  ".join(w)) for i, w in items] + [(50, None), (51, "too short")], "item_id long, text string")
    samples = spark.createDataFrame([("en", "a few plain words")], "lang string, text string")
    got = {tuple(r) for r in k.leaked(dd, ii, samples).collect()}
    assert got == want and len(want) > 5
    assert k.leaked(dd.limit(0), ii, samples).count() == 0 and k.leaked(dd, ii.limit(0), samples).count() == 0


def test_every_run_of_five_words_shares_a_fingerprint():
    rng = np.random.default_rng(2)
    for _ in range(50):
        run = rng.integers(0, 1 << 60, 5)
        two = [np.concatenate([rng.integers(0, 1 << 60, n), run, rng.integers(0, 1 << 60, 7)]) for n in (3, 9)]
        kept = []
        for t in two:
            o = np.array([0, len(t)])
            g = k._grams(t, o)
            kept.append(set(g[k._kept(g, o)].tolist()))
        assert kept[0] & kept[1]
