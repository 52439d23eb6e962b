"""Groups of texts that share most of their content.

Method: improved consistent weighted sampling over TF-IDF weighted shingles. Samples
are banded; texts that share a band meet the first of their bucket, and those it isn't
near to meet the whole bucket. What meets is verified on whole sets of shingles: their
weighted Jaccard similarity is computed and given with the link, and the plain overlap,
which the statement of the problem asks for, decides.

The weight of a shingle in a share p of the texts is (log(1 + 1 / p) / log(1 + 1 / FLOOR))
to the power STEEP, p being FLOOR at least, and 1.1 times that if the text has it more than
once. BANDS of ROWS samples are drawn by these weights, and PLAIN_BANDS of PLAIN_ROWS with
all weights 1. Two texts of plain overlap 0.5 meet in a plain band with a probability of
1 - (1 - 0.5^4)^24 = 0.79 whatever they share; if what they share is in a share p of the
texts and the rest rare, they meet in any band with more than 0.999 for p up to 0.001,
0.993 at 0.003, 0.96 at 0.01. What is more frequent is shared by many, and a text is lost to
its group only if it meets none of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small, stored
from .forest import spanning_forest
from .leakage import word_hashes
from .sitelines import common_lines, content, line_names, texts_of_sources

SHINGLE, SIMILAR, LEAST_WORDS = 3, 0.5, 100
#: 1 - (1 - s^ROWS)^BANDS of the pairs of weighted similarity s meet in the weighted bands, and likewise by plain overlap in the plain ones.
BANDS, ROWS = 40, 3
PLAIN_BANDS, PLAIN_ROWS = 24, 4
#: Share of the texts up to which shingles are as rare as any; how steeply weights fall with their share; what a shingle that occurs again weighs more.
FLOOR, STEEP, AGAIN = 0.001, 1.5, 1.1
#: Cells of the sketch that tells which shingles may be in a share FLOOR of the texts; their texts are then counted one by one.
CELLS, BLOCKS = 1 << 20, 64
#: Bits of the sketch of a text that tells which pairs can't overlap enough.
BITS = 2048
#: Pairs whose sketches a task compares at once.
PAIRS = 1 << 16
_MAX = np.iinfo(np.uint64).max


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values and offsets of a list column, from 0."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def shingle_sets(texts: DataFrame, words: Column, n: int = SHINGLE) -> DataFrame:
    """(id, shingles, again): the sorted set of hashes of n words in a row, and a byte for each, 1 if the text has it more than once; texts of fewer words are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _lists(batch.column("words"))
            w = flat.astype(np.int64).view(np.uint64)
            size = max(0, len(w) - n + 1)
            h = np.zeros(size, np.uint64)
            for j in range(n):
                h = _mix(h ^ w[j : j + size])
            sets, again, ids = [], [], []
            for i in range(len(offsets) - 1):
                lo, hi = offsets[i], offsets[i + 1] - n + 1
                if hi > lo:
                    found, times = np.unique(h[lo:hi].view(np.int64), return_counts=True)
                    sets.append(found)
                    again.append((times > 1).astype(np.uint8).tobytes())
                    ids.append(i)
            bounds = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32), pa.int32())
            values = pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]), pa.int64())
            columns = [batch.column("id").take(pa.array(ids, pa.int64())), pa.ListArray.from_arrays(bounds, values), pa.array(again, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "shingles", "again"])

    return texts.select("id", words.alias("words")).mapInArrow(work, "id long, shingles array<long>, again binary")


class Weights:
    """The weights of shingles: those in a share FLOOR of the texts and more by their number of texts, all others the same."""

    def __init__(self, shingles: np.ndarray, texts: np.ndarray, total: int) -> None:
        order = np.argsort(shingles)
        self.shingles = shingles[order]
        share = np.clip(texts[order] / max(1, total), FLOOR, 1)
        self.weights = ((np.log1p(1 / share) / np.log1p(1 / FLOOR)) ** STEEP).astype(np.float32)

    def of(self, shingles: np.ndarray, again: np.ndarray) -> np.ndarray:
        out = np.ones(len(shingles), np.float32)
        if len(self.shingles):
            slot = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
            out = np.where(self.shingles[slot] == shingles, self.weights[slot], out)
        return np.where(again > 0, out * np.float32(AGAIN), out)


def shingle_weights(sets: DataFrame) -> Weights:
    """The document frequencies of all texts, as far as weights depend on them.

    A first pass adds up a sketch of CELLS counts, an array of fixed size for each task;
    a second counts the texts of those shingles one by one whose cell holds a share FLOOR
    of the texts. At most 1 / FLOOR times the mean size of a set are kept, however many
    texts there are, and the rule is the same at every size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            flat, offsets = _lists(batch.column("shingles"))
            cells += np.bincount(flat.view(np.uint64) % np.uint64(CELLS), minlength=CELLS)
            n += len(offsets) - 1
        if n:
            parts = [p.tobytes() for p in np.split(cells, BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary()), pa.array([n] * BLOCKS, pa.int64())], names=["block", "counts", "n"])

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(CELLS // BLOCKS, np.int64), 0
        for f in frames:
            for c, k in zip(f["counts"], f["n"]):
                total += np.frombuffer(c, np.int64)
                n += int(k)
        yield pd.DataFrame({"block": [key[0]], "counts": [np.packbits(total >= FLOOR * n).tobytes()], "n": [n]})

    rows = sets.select("shingles").mapInArrow(count, "block int, counts binary, n long").groupBy("block").applyInPandas(add, "block int, counts binary, n long").collect()
    if not rows:
        return Weights(np.zeros(0, np.int64), np.zeros(0), 0)
    full = np.concatenate([np.unpackbits(np.frombuffer(r["counts"], np.uint8)) for r in sorted(rows, key=lambda r: r["block"])]).astype(bool)
    total, sent = rows[0]["n"], sets.sparkSession.sparkContext.broadcast(full)  # 1 MB, whatever the input

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, _ = _lists(batch.column("shingles"))
            found, times = np.unique(flat[sent.value[flat.view(np.uint64) % np.uint64(CELLS)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(times, pa.int64())], names=["shingle", "n"])

    counted = sets.select("shingles").mapInArrow(often, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FLOOR * total)
    kept = counted.toPandas()
    return Weights(kept["shingle"].to_numpy(np.int64), kept["n"].to_numpy(np.float64), total)


class Sampler:
    """Improved consistent weighted sampling. The random numbers of a shingle and a sample come from tables, picked by the bits of a product of the two."""

    def __init__(self, samples: int, seed: int = 20) -> None:
        draw = np.random.default_rng(seed)
        self.factors = draw.integers(1, 1 << 63, samples, dtype=np.uint64) | np.uint64(1)
        size = 1 << 16
        self.r = draw.gamma(2, 1, size).astype(np.float32)
        self.log_c = np.log(draw.gamma(2, 1, size)).astype(np.float32)
        self.beta = draw.uniform(0, 1, size).astype(np.float32)

    def samples(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A hash for each sample; two weighted sets share one with the probability of their weighted Jaccard similarity. Long texts are taken in parts, to bound the memory."""
        parts = [self._least(shingles[a : a + 2048], weights[a : a + 2048]) for a in range(0, len(shingles), 2048)]
        if len(parts) == 1:
            return parts[0][1]
        least = np.argmin([p[0] for p in parts], axis=0)
        return np.array([p[1] for p in parts])[least, np.arange(len(self.factors))]

    def _least(self, shingles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.uint64(0xFFFF)
        m = shingles[None, :] * self.factors[:, None]
        r = self.r[(m >> np.uint64(48)).astype(np.intp)]
        beta = self.beta[((m >> np.uint64(32)) & low).astype(np.intp)]
        t = np.floor(np.log(weights)[None, :] / r + beta)
        log_a = self.log_c[((m >> np.uint64(16)) & low).astype(np.intp)] - r * (t - beta) - r
        best = np.argmin(log_a, axis=1)
        rows = np.arange(len(best))
        level = t[rows, best].astype(np.int64).view(np.uint64)
        return log_a[rows, best], _mix(shingles[best] ^ _mix(level))


def bucket_lists(sets: DataFrame, weights: Weights) -> DataFrame:
    """(id, buckets): the bucket of each band; texts in one bucket agree in all samples of the band."""
    shared = sets.sparkSession.sparkContext.broadcast(weights)  # of bounded size, see shingle_weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, plain, weights = Sampler(BANDS * ROWS), Sampler(PLAIN_BANDS * PLAIN_ROWS, 21), shared.value
        number = np.arange(1, BANDS + PLAIN_BANDS + 1, dtype=np.uint64)
        for batch in batches:
            flat, offsets = _lists(batch.column("shingles"))
            again = np.frombuffer(b"".join(batch.column("again").to_pylist()), np.uint8)
            weight, flat = weights.of(flat, again), flat.view(np.uint64)
            out = np.zeros((len(offsets) - 1, len(number)), np.uint64)
            for i in range(len(offsets) - 1):
                s, w = flat[offsets[i] : offsets[i + 1]], weight[offsets[i] : offsets[i + 1]]
                b = number.copy()
                for h, part in ((weighted.samples(s, w).reshape(BANDS, ROWS), b[:BANDS]), (plain.samples(s, np.ones(len(s), np.float32)).reshape(PLAIN_BANDS, PLAIN_ROWS), b[BANDS:])):
                    for k in range(h.shape[1]):
                        part[:] = _mix(part ^ h[:, k])
                out[i] = b
            bounds = pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(number), pa.int32())
            lists = pa.ListArray.from_arrays(bounds, pa.array(out.reshape(-1).view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "buckets"])

    return sets.mapInArrow(work, "id long, buckets array<long>")


def buckets(sets: DataFrame, weights: Weights) -> DataFrame:
    """(id, bucket): a row for each text and band."""
    return bucket_lists(sets, weights).select("id", F.explode("buckets").alias("bucket"))


def sketches(sets: DataFrame) -> DataFrame:
    """(id, size, bits): how many shingles a text has, and a bit for each of BITS cells that holds one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _lists(batch.column("shingles"))
            n = len(offsets) - 1
            on = np.zeros((n, BITS), np.bool_)
            on[np.repeat(np.arange(n), np.diff(offsets)), (flat.view(np.uint64) >> np.uint64(20)) % np.uint64(BITS)] = True
            bits = [x.tobytes() for x in np.packbits(on, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets).astype(np.int32)), pa.array(bits, pa.binary())], names=["id", "size", "bits"])

    return sets.select("id", "shingles").mapInArrow(work, "id long, size int, bits binary")


def possible(pairs: DataFrame, drawn: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) that may overlap enough. A cell of one text that is empty in the other holds a shingle not shared, so no pair that overlaps enough is left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (np.asarray(batch.column(c)).astype(np.int64) for c in ("m", "n"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("x", "y"))
            most = np.minimum(m - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), n - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
            yield batch.select(["a", "b"]).filter(pa.array(most * (1 + similar) >= similar * (m + n)))

    one = drawn.select(F.col("id").alias("a"), F.col("size").alias("m"), F.col("bits").alias("x"))
    two = drawn.select(F.col("id").alias("b"), F.col("size").alias("n"), F.col("bits").alias("y"))
    least, most = F.least("m", "n"), F.greatest("m", "n")
    return pairs.select("a", "b").join(one, "a").join(two, "b").where(least >= similar * most).mapInArrow(work, "a long, b long")


def _compared(f: pd.DataFrame, similar: float) -> pd.DataFrame:
    """`meetings` of rows that hold whole buckets, sorted by bucket and id."""
    bucket, ids, m = (f[c].to_numpy(np.int64) for c in ("bucket", "id", "size"))
    bits = np.frombuffer(b"".join(f["bits"]), np.uint64).reshape(-1, BITS // 64)
    on = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(starts, len(ids)))
    begin, n = np.repeat(starts, sizes), np.repeat(sizes, sizes)

    def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for k in range(0, len(i), PAIRS):
            p, q = i[k : k + PAIRS], j[k : k + PAIRS]
            both = np.bitwise_count(bits[p] & bits[q]).sum(axis=1, dtype=np.int64)
            most = both + np.minimum(m[p] - on[p], m[q] - on[q])
            out[k : k + PAIRS] = most * (1 + similar) >= similar * (m[p] + m[q])
        return out & (np.minimum(m[i], m[j]) >= similar * np.maximum(m[i], m[j]))

    rows = np.arange(len(ids))
    others = rows[rows != begin]
    near = may(begin[others], others)
    one, two = [begin[others[near]]], [others[near]]
    unlike = np.zeros(len(ids), bool)
    unlike[others[~near]] = True
    left = np.flatnonzero(unlike)
    ends = np.cumsum(n[left])
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        i = np.repeat(left[at:to], n[left[at:to]])
        j = begin[i] + np.arange(len(i)) - np.repeat(ends[at:to] - n[left[at:to]] - (ends[at - 1] if at else 0), n[left[at:to]])
        kept = (j != begin[i]) & (j != i) & (~unlike[j] | (i < j))
        i, j = i[kept], j[kept]
        kept = may(i, j)
        one.append(np.minimum(i[kept], j[kept]))
        two.append(np.maximum(i[kept], j[kept]))
        at = to
    a, b = np.concatenate(one), np.concatenate(two)
    return pd.DataFrame({"bucket": bucket[a], "a": ids[a], "b": ids[b], "head": begin[a] == a})


def meetings(members: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(bucket, a, b, head), a < b: the pairs of a bucket that may overlap enough by their sketches: the least id (head) with each other one, and those it can't be near to with all others.

    members: (bucket, id, size, bits), each once. Pairs are made and left out in a task that
    holds a bucket's sketches, so what is moved grows with members, not with pairs.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            if not len(f):
                continue
            start = int(np.searchsorted(f["bucket"].to_numpy(), f["bucket"].iloc[-1]))  # of the bucket that may go on
            if start or held and held[-1]["bucket"].iloc[-1] != f["bucket"].iloc[0]:
                yield _compared(pd.concat([*held, f[:start]], ignore_index=True), similar)
                held = []
            held.append(f[start:])
        if held:
            yield _compared(pd.concat(held, ignore_index=True), similar)

    return members.select("bucket", "id", "size", "bits").repartition("bucket").sortWithinPartitions("bucket", "id").mapInPandas(work, "bucket long, a long, b long, head boolean")


def verified(pairs: DataFrame, sets: DataFrame, weights: Weights, similar: float = SIMILAR) -> DataFrame:
    """(a, b, weighted): the pairs whose whole sets overlap enough, with their weighted Jaccard similarity. Only sets that a pair names are moved."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    some = stored(sets.join(small(wanted, 1_000_000), "id").dropDuplicates(["id"]), "meeting")
    one = some.select(F.col("id").alias("a"), F.col("shingles").alias("x"), F.col("again").alias("m"))
    two = some.select(F.col("id").alias("b"), F.col("shingles").alias("y"), F.col("again").alias("n"))
    shared = sets.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            (x, ox), (y, oy) = _lists(batch.column("x")), _lists(batch.column("y"))
            wx = weights.of(x, np.frombuffer(b"".join(batch.column("m").to_pylist()), np.uint8)).astype(np.float64)
            wy = weights.of(y, np.frombuffer(b"".join(batch.column("n").to_pylist()), np.uint8)).astype(np.float64)
            near, alike = np.zeros(len(ox) - 1, bool), np.zeros(len(ox) - 1)
            for i in range(len(ox) - 1):
                a, b = slice(ox[i], ox[i + 1]), slice(oy[i], oy[i + 1])
                slot = np.minimum(np.searchsorted(y[b], x[a]), oy[i + 1] - oy[i] - 1)
                same = y[b][slot] == x[a]
                both = int(same.sum())
                near[i] = both >= similar * (len(same) + oy[i + 1] - oy[i] - both)
                least = np.minimum(wx[a][same], wy[b][slot[same]]).sum()
                alike[i] = least / (wx[a].sum() + wy[b].sum() - least)
            kept = pa.array(near)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept), pa.array(alike[near], pa.float64())], names=["a", "b", "weighted"])

    return pairs.join(one, "a").join(two, "b").mapInArrow(work, "a long, b long, weighted double")


def near_links(sets: DataFrame, firsts: DataFrame) -> DataFrame:
    """(a, b, weighted), a < b: links between different texts that connect all texts which are near to each other and meet in a bucket.

    firsts: (id, first), the text that stands for a text's copies; copies leave before
    anything is compared. Each text of a bucket meets its first; those it isn't near to
    meet all of the bucket. So a bucket of n near texts costs n - 1 comparisons, and no
    link is dropped. A task holds the sketches of a bucket; only the pairs they let
    through are moved.
    """
    weights = shingle_weights(sets)
    placed = bucket_lists(sets, weights).join(firsts, "id").select(F.explode("buckets").alias("bucket"), F.col("first").alias("id"))
    whole = Window.partitionBy("bucket")
    counted = placed.repartition("bucket").distinct().withColumn("n", F.count("*").over(whole))
    members = stored(counted.where("n > 1").select("bucket", "id"), "members")
    wanted = members.select("id").distinct()
    drawn = small(stored(sketches(sets).join(small(wanted, 1_000_000), "id").dropDuplicates(["id"]), "sketches"), 50_000)
    met = stored(meetings(members.join(drawn, "id")), "met")
    tried = stored(met.where("head").select("a", "b").distinct(), "tried")
    first = stored(verified(tried, sets, weights), "first")
    # Those whose sketch let them pass as near to their head, but whose sets don't.
    failed = met.where("head").join(first, ["a", "b"], "left_anti").select("bucket", F.col("b").alias("id"))
    others = failed.join(members.select("bucket", F.col("id").alias("other")), "bucket").where("id <> other")
    rest = possible(others.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), drawn)
    second = met.where("not head").select("a", "b").union(rest).distinct().join(tried, ["a", "b"], "left_anti")
    return first.union(verified(stored(second, "possible"), sets, weights))


def near_groups(items: DataFrame, entities: DataFrame, aliases: DataFrame, text: str = "clean_text_original", least_words: int = LEAST_WORDS) -> DataFrame:
    """(raw_item_id, group_id, links, nearest): one row per text of at least `least_words` words; the group is named by its least id.

    Site lines, case, punctuation and disguises are disregarded. Texts with equal sets
    are one text to the search, and join its group as copies. links counts the near
    texts found for the text's set, and its copies; nearest is the greatest weighted
    similarity among them, null without any. Shorter, null and empty texts and
    those of site lines alone give no row; repeated rows count once.
    """
    texts, needed = texts_of_sources(items, entities, aliases, text)
    lines = texts.select("id", "source_key", line_names(F.col("_text")).alias("_lines"))
    common = stored(common_lines(lines, needed).groupBy("source_key").agg(F.collect_set("name").alias("_common")), "common")  # per source at most 25 times the lines of an item
    wanted = texts.join(small(common, 20_000), "source_key", "left")
    kept = F.filter(F.transform(F.split("_text", "\n"), lambda x: F.struct(x.alias("x"), F.xxhash64(content(x)).alias("h"))), lambda s: ~F.array_contains(F.coalesce("_common", F.array().cast("array<long>")), s["h"]))
    body = F.array_join(F.transform(kept, lambda s: s["x"]), "\n")
    enough = F.size(F.split(F.trim("_text"), r"(?U)\s+")) >= least_words
    sets = shingle_sets(wanted.where(enough).select("id", body.alias("_body")), word_hashes(F.col("_body")))
    sets = stored(sets, "sets")
    members = stored(sets.select("id", F.xxhash64("shingles", F.size("shingles")).alias("_set")), "members")
    firsts = members.groupBy("_set").agg(F.min("id").alias("first"), F.count_distinct("id").alias("copies"))
    stands = members.join(firsts.select("_set", "first"), "_set").select("id", "first").distinct()
    links = stored(near_links(sets, stands), "links")
    _, components = spanning_forest(links.select(F.col("a").alias("u"), F.col("b").alias("v"), F.xxhash64("a", "b").alias("w")))
    degree = links.select(F.explode(F.array("a", "b")).alias("first"), "weighted").groupBy("first").agg(F.count("*").alias("_n"), F.max("weighted").alias("_w"))
    named = firsts.join(components.select(F.col("node").alias("first"), "root"), "first", "left").join(degree, "first", "left")
    named = named.select("_set", "first", F.coalesce("root", "first").alias("root"), (F.coalesce("_n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.when(F.col("copies") > 1, 1.0).otherwise(F.col("_w")).alias("nearest"))
    least = named.groupBy("root").agg(F.min("first").alias("group_id"))
    named = named.join(least, "root").select("_set", "group_id", "links", "nearest")
    return members.dropDuplicates(["id"]).join(named, "_set").select(F.col("id").alias("raw_item_id"), "group_id", "links", "nearest")


def pairs_of_groups(groups: DataFrame) -> DataFrame:
    """(raw_item_id_a, raw_item_id_b): all pairs within the groups, as the statement of the problem asks for them."""
    many = groups.groupBy("group_id").agg(F.count("*").alias("_n")).where("_n > 1").select("group_id")
    kept = groups.join(many, "group_id")
    a, b = kept.select("group_id", F.col("raw_item_id").alias("raw_item_id_a")), kept.select("group_id", F.col("raw_item_id").alias("raw_item_id_b"))
    return a.join(b, "group_id").where("raw_item_id_a < raw_item_id_b").select("raw_item_id_a", "raw_item_id_b")
