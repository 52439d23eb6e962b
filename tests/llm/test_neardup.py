import random

import numpy as np

from newsloom.llm import neardup

from .fixtures import entities, items

WORDS = [a + b for a in "bcdfgklmnprst" for b in ("ado", "eni", "ilu", "osa", "uri", "aven", "orit", "emba", "ulti", "ikan")]


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def test_groups_against_all_pairs(spark):
    random.seed(11)
    rows, e = [], entities(spark)
    for i in range(40):
        base = random.choices(WORDS, k=130)
        for j in range(i % 4 + 1):
            w = list(base)
            for _ in range(j * 3):
                w[random.randrange(len(w))] = random.choice(WORDS)
            rows.append(dict(id=len(rows), source_name=f"s{len(rows)}", clean_text_original=" ".join(w)))
    rows += [dict(rows[0], id=900), dict(rows[0], id=901, clean_text_original=rows[0]["clean_text_original"].upper().replace("A", "Ａ")), dict(id=902, source_name="x", clean_text_original="short"), dict(id=903), dict(rows[0])]
    got = {tuple(r) for r in neardup.pairs_of_groups(neardup.near_groups(items(spark, rows), *e)).collect()}
    texts = {r["id"]: shingles(r["clean_text_original"].lower().replace("ａ", "a")) for r in rows if len((r.get("clean_text_original") or "").split()) >= 100}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and len(texts[a] & texts[b]) * 2 >= len(texts[a] | texts[b]):
                parent[find(b)] = find(a)
    want = {(a, b) for a in texts for b in texts if a < b and find(a) == find(b)}
    assert got == want and len(want) > 40


def test_empty(spark):
    assert neardup.near_groups(items(spark, []), *entities(spark)).count() == 0


def test_samples_meet_as_often_as_sets_are_alike():
    rng = np.random.default_rng(4)
    all_ = neardup._mix(np.arange(300, dtype=np.uint64))
    weights = rng.uniform(0.5, 9, 300).astype(np.float32)
    s = neardup.Sampler(4000)
    a, b = np.arange(0, 200), np.arange(100, 300)
    same = (s.samples(all_[a], weights[a]) == s.samples(all_[b], weights[b])).mean()
    assert abs(same - weights[100:200].sum() / weights.sum()) < 0.04


def frame(spark, sets):
    rows = [(i, sorted(s), bytes(len(s))) for i, s in sets]
    return spark.createDataFrame(rows, "id long, shingles array<long>, again binary")


def test_recall_of_pairs_by_overlap(spark):
    """Pairs of exact overlaps, their shared shingles in 2, in about 20 and in a third of the texts."""
    rng, own = np.random.default_rng(6), iter(range(1_000_000, 9_000_000))
    hashed = lambda x: neardup._mix(np.array(x, np.uint64)).view(np.int64).tolist()
    hot = list(range(500_000, 500_120))
    met = {}
    sets, kind = [], {}
    for i in range(600):
        where, of = i % 3, (0.5, 0.55, 0.6)[i // 3 % 3]
        shared = [next(own) for _ in range(120)] if where == 0 else rng.choice(3600, 120, replace=False).tolist() if where == 1 else hot
        alone = round(120 * (1 - of) / of / 2)
        for j in (0, 1):
            sets.append((2 * i + j, hashed([*shared, *(next(own) for _ in range(alone))])))
        kind[i] = (where, of)
    df = frame(spark, sets)
    weights = neardup.shingle_weights(df)
    assert len(weights.shingles) and 0 < weights.weights.min() and weights.weights.max() <= 1
    placed = {}
    for r in neardup.buckets(df, weights).collect():
        placed.setdefault(r["id"], set()).add(r["bucket"])
    for i, k in kind.items():
        met.setdefault(k, []).append(bool(placed[2 * i] & placed[2 * i + 1]))
    least = {(0, 0.5): 0.97, (0, 0.55): 0.97, (0, 0.6): 0.97, (1, 0.5): 0.8, (1, 0.55): 0.9, (1, 0.6): 0.95, (2, 0.5): 0.6}
    shares = {k: float(np.mean(met[k])) for k in least}
    assert all(shares[k] >= v for k, v in least.items()), shares
    # What a third of the texts share is met through others of the group.
    group = [2 * i + j for i, (where, _) in kind.items() if where == 2 for j in (0, 1)]
    seen = {}
    for i in group:
        for b in placed[i]:
            seen.setdefault(b, set()).add(i)
    assert np.mean([any(len(seen[b]) > 1 for b in placed[i]) for i in group]) >= 0.99


def test_weighted_similarity_goes_with_the_link(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], bytes([0, 0, 1])), (2, [2, 3, 4], bytes([0, 0, 0])), (3, [7, 8], bytes(2))], "id long, shingles array<long>, again binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    got = neardup.verified(pairs, df, neardup.Weights(np.array([3]), np.array([3.0]), 3)).collect()
    all_ = float((np.log(2) / np.log1p(1 / neardup.FLOOR)) ** neardup.STEEP)
    assert [(r["a"], r["b"]) for r in got] == [(1, 2)] and abs(got[0]["weighted"] - (1 + all_) / (3 + 1.1 * all_)) < 1e-5


def test_sketches_leave_no_near_pair_out(spark):
    rng, rows, pairs = np.random.default_rng(3), [], []
    for i, n in enumerate((3, 90, 900, 9000)):
        for j in range(5):
            h = neardup._mix(rng.integers(1, 1 << 40, 2 * n).astype(np.uint64)).view(np.int64).tolist()
            kept = 2 * n // 3  # of n in each: half of all
            a = len(rows)
            rows += [(a, h[:n]), (a + 1, h[n - kept :][:n]), (a + 2, h[n:])]
            pairs += [(a, a + 1), (a, a + 2)]
    sets, wanted = frame(spark, rows), spark.createDataFrame(pairs, "a long, b long")
    near = {(r["a"], r["b"]) for r in neardup.verified(wanted, sets, neardup.shingle_weights(sets)).collect()}
    left = {tuple(r) for r in neardup.possible(wanted, neardup.sketches(sets)).collect()}
    assert len(near) == 20 and near <= left and (18, 20) not in left


def test_buckets_are_compared_where_they_are(spark, monkeypatch):
    """What meets is as with all pairs of a bucket, sketch by sketch; buckets go on over batches, and blocks of pairs end within a bucket."""
    rng, rows, members = np.random.default_rng(8), [], []
    for i in range(60):
        h = neardup._mix(rng.integers(1, 1 << 40, 100).astype(np.uint64)).view(np.int64).tolist() if i % 3 == 0 else [*h[: 100 - 15 * (i % 3)], *neardup._mix(rng.integers(1, 1 << 40, 15 * (i % 3)).astype(np.uint64)).view(np.int64).tolist()]
        rows.append((i, h))
    for i in range(60):
        members += [(-5, i)] + [(b, i) for b in range(9) if (i * 7 + b * b) % 11 < 3]
    drawn = neardup.sketches(frame(spark, rows))
    given = spark.createDataFrame(members, "bucket long, id long").join(drawn, "id")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = [tuple(r) for r in neardup.meetings(given).collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    pairs = [(a, b) for a in range(60) for b in range(a + 1, 60)]
    may = {tuple(r) for r in neardup.possible(spark.createDataFrame(pairs, "a long, b long"), drawn).collect()}
    want = set()
    for bucket in {b for b, _ in members}:
        ids = sorted(i for b, i in members if b == bucket)
        left = {i for i in ids[1:] if (ids[0], i) not in may}
        want |= {(bucket, ids[0], i, True) for i in ids[1:] if i not in left}
        want |= {(bucket, a, b, False) for a in ids[1:] for b in ids[1:] if a < b and (a in left or b in left) and (a, b) in may}
    assert len(got) == len(set(got)) and set(got) == want and {h for *_, h in want} == {True, False}
    monkeypatch.setattr(neardup, "PAIRS", 50)
    again = neardup._compared(given.orderBy("bucket", "id").toPandas(), neardup.SIMILAR)
    assert sorted(again.itertuples(index=False, name=None)) == sorted(got)
