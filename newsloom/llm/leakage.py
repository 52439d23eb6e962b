"""Passages of evaluation items in documents.

Method: winnowing. Of the hashes of all k-grams of words the least of each window of w
is kept, so each shared run of at least w + k - 1 words shares a kept hash. The
fingerprints of documents and items are joined, however many items there are; documents
without any are told by a filter of fixed size beforehand. The pairs that meet are
extended, across changed words, to the longest tolerated passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import salted_join, small, stored
from . import garbled

K, WINDOW = 4, 2
#: A passage counts from so many words of the item, with at most one edit to so many words.
LEAST_WORDS, WORDS_PER_EDIT = 15, 8
#: k-grams that a passage shares at least: fewest where it has two edits in one word more than LEAST_WORDS.
FEWEST = LEAST_WORDS + 1 - (K - 1) - K * ((LEAST_WORDS + 1) // WORDS_PER_EDIT)
#: Words at either end of a passage that are tried beyond the outermost shared k-grams.
FLANK = 2 * K
#: Bits of the filter that tells which fingerprints no item has.
FILTER_BITS = 1 << 25


def word_hashes(text: Column) -> Column:
    """Hashes of the words: runs of letters, marks and digits without case; apostrophes within words are left out."""
    plain = F.lower(F.replace(F.replace(text, F.lit("'"), F.lit("")), F.lit("’"), F.lit("")))
    return F.transform(F.array_remove(F.split(plain, r"[^\p{L}\p{M}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def _grams(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hash of the k-gram that starts at each word; the largest number where a text ends before."""
    n = len(words)
    h = np.zeros(max(0, n - K + 1), np.uint64)
    w = words.view(np.uint64)
    for j in range(K):
        h = (h ^ w[j : n - K + 1 + j]) * np.uint64(0x9E3779B97F4A7C15 + 2 * j)
        h ^= h >> np.uint64(29)
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    out[: len(h)] = h
    ends = offsets[1:]
    for j in range(1, K):  # k-grams that would reach into the next text
        at = ends - j
        out[at[at >= offsets[:-1]]] = np.iinfo(np.uint64).max
    return out


def _kept(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions of the k-grams that winnowing keeps: the last least one of each window."""
    n, most = len(grams), np.iinfo(np.uint64).max
    if n < WINDOW:
        return np.flatnonzero(grams != most)
    best, at = grams[: n - WINDOW + 1].copy(), np.arange(n - WINDOW + 1)
    for j in range(1, WINDOW):
        h = grams[j : n - WINDOW + 1 + j]
        less = h <= best
        best, at = np.where(less, h, best), np.where(less, np.arange(j, n - WINDOW + 1 + j), at)
    at = np.unique(at[best != most])
    short = np.flatnonzero(np.diff(offsets) < WINDOW + K - 1)  # texts without a full window keep all
    extra = [np.arange(offsets[i], offsets[i + 1]) for i in short]
    at = np.unique(np.concatenate([at, *extra])) if extra else at
    return at[grams[at] != most]


def _edits(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Words to change, leave out or add between a and b; limit + 1 if more than limit."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    a, b = a.tolist(), b.tolist()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row[-1], limit + 1)


def _flank(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(n, edits): for each number n of first words of a, the last of which is found unchanged, the edits to the nearest first words of b that end in it; (0, 0) too."""
    a, b = a.tolist(), b.tolist()
    row, out = list(range(len(b) + 1)), [(0, 0)]
    for i, x in enumerate(a, 1):
        last, row[0], ends = row[0], i, []
        for j, y in enumerate(b, 1):
            keep = row[j]
            if x == y:
                ends.append(last)
            row[j] = min(keep + 1, row[j - 1] + 1, last + (x != y))
            last = keep
        if ends:
            out.append((i, min(ends)))
    return out


def leaks(item: np.ndarray, doc: np.ndarray, at_item: np.ndarray, at_doc: np.ndarray) -> bool:
    """Whether the doc repeats a passage of the item. at_item, at_doc: the starts of all shared k-grams."""
    places = np.unique(at_item)
    # A passage of L words with L // 8 edits shares at least L - (K - 1) - K * (L // 8) k-grams, fewest for two edits in 16 words.
    least, span = FEWEST, LEAST_WORDS + 1 - (K - 1)
    if len(places) < least or not (places[least - 1 :] - places[: len(places) - least + 1] < span).any():
        return False
    order = np.lexsort((at_item, at_item - at_doc))
    i, d = at_item[order], at_doc[order]
    new = np.flatnonzero(np.diff(i - d, prepend=i[0] - d[0] - 1) | (np.diff(i, prepend=-9) != 1))
    runs = sorted((int(i[s]), int(d[s]), int(e - s) + K - 1) for s, e in zip(new, [*new[1:], len(i)]))
    cost = [{} for _ in runs]  # for each run: from which start of a chain with how few edits it is reached
    for r, (i1, d1, n1) in enumerate(runs):
        cost[r][r] = 0
        for q in range(r):
            i0, d0, n0 = runs[q]
            cut = max(0, i0 + n0 - i1, d0 + n0 - d1)  # runs that overlap are shortened
            if i1 + cut < i1 + n1 and d1 > d0 and i1 > i0:
                gi, gd = i1 + cut - i0 - n0, d1 + cut - d0 - n0
                limit = (len(item)) // WORDS_PER_EDIT
                if max(gi, gd) > 8 * (limit + 1):
                    continue
                e = _edits(item[i0 + n0 : i1 + cut], doc[d0 + n0 : d1 + cut], limit)
                if e <= limit:
                    for start, c in cost[q].items():
                        if c + e <= limit and c + e < cost[r].get(start, limit + 1):
                            cost[r][start] = c + e
        for start, c in cost[r].items():
            words = i1 + n1 - runs[start][0]
            if words >= LEAST_WORDS and c <= words // WORDS_PER_EDIT:
                return True
            # Words before and after, too few or too much changed to share a k-gram, may belong to the passage.
            if words >= LEAST_WORDS - 2 * FLANK and c <= (words + 2 * FLANK) // WORDS_PER_EDIT:
                i0, d0, i9, d9 = *runs[start][:2], i1 + n1, d1 + n1
                left = _flank(item[max(0, i0 - FLANK) : i0][::-1], doc[max(0, d0 - FLANK) : d0][::-1])
                right = _flank(item[i9 : i9 + FLANK], doc[d9 : d9 + FLANK])
                for f, cf in left:
                    for h, ch in right:
                        n = words + f + h
                        if n >= LEAST_WORDS and c + cf + ch <= n // WORDS_PER_EDIT:
                            return True
    return False


def _fingerprints(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The kept hashes of a batch of texts given as words, and the number of the text of each."""
    lists = batch.column("words")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    words = np.asarray(lists.values)[offsets[0] : offsets[-1]].astype(np.int64)
    offsets = offsets - offsets[0]
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = _grams(words, offsets)
    kept = _kept(grams, offsets)
    return grams[kept].view(np.int64), np.searchsorted(offsets, kept, side="right") - 1


def _slots(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = prints.view(np.uint64)
    return (h % np.uint64(FILTER_BITS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(FILTER_BITS)).astype(np.int64)


def item_filter(prints: DataFrame) -> np.ndarray:
    """The filter: two bits set for each fingerprint (print). Each task sets bits of an array of fixed size; pieces are united before they reach the driver."""
    pieces = 64

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for slots in _slots(np.asarray(batch.column("print")).astype(np.int64)):
                on[slots] = True
        if on.any():
            parts = [np.packbits(x).tobytes() for x in np.split(on, pieces)]
            yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array(parts, pa.binary())], names=["piece", "bits"])

    def unite(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        on = None
        for f in frames:
            for b in f["bits"]:
                one = np.frombuffer(b, np.uint8)
                on = one if on is None else on | one
        yield pd.DataFrame({"piece": [key[0]], "bits": [on.tobytes()]})

    rows = prints.select("print").coalesce(64).mapInArrow(mark, "piece int, bits binary").groupBy("piece").applyInPandas(unite, "piece int, bits binary").collect()
    out = np.zeros((pieces, FILTER_BITS // 8 // pieces), np.uint8)
    for r in rows:
        out[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def meeting(docs: DataFrame, items: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, item_id): the documents and items that share a fingerprint; and (key, words) of these documents. docs: key and words; items: item_id and words.

    The words of documents are hashed once; only documents with a fingerprint that the
    filter lets pass are kept. A fingerprint may be hot, so it is joined salted.
    """
    kind = docs.schema[key].dataType.simpleString()

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, at = _fingerprints(batch)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(at)), pa.array(prints)], names=["item_id", "print"])

    prints = stored(items.mapInArrow(of_items, "item_id long, print long").distinct(), "itemprints")
    sent = docs.sparkSession.sparkContext.broadcast(item_filter(prints))  # 4 MB, whatever the input

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            found, at = _fingerprints(batch)
            keep = np.ones(len(found), bool)
            for slots in _slots(found):
                keep &= (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 > 0
            pairs = np.unique(np.stack([at[keep], found[keep]]), axis=1) if keep.any() else np.zeros((2, 0), np.int64)
            rows, counts = np.unique(pairs[0], return_counts=True)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(pairs[1]))
            took = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([took.column(key), took.column("words"), lists], names=[key, "words", "prints"])

    held = stored(docs.select(key, "words").mapInArrow(of_docs, f"{key} {kind}, words array<long>, prints array<long>"), "docprints")
    pairs = salted_join(held.select(key, F.explode("prints").alias("print")), prints, ["print"], F.col(key)).select(key, "item_id").distinct()
    return stored(pairs.repartition(key).sortWithinPartitions(key), "pairs"), held.select(key, "words")


class _Item:
    """An item's words, and its k-grams in order with their places."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        grams = _grams(words, np.array([0, len(words)]))
        places = np.flatnonzero(grams != np.iinfo(np.uint64).max)
        order = np.argsort(grams[places], kind="stable")
        self.grams, self.places = grams[places][order], places[order]

    def within(self, doc: np.ndarray, grams: np.ndarray) -> bool:
        left = np.searchsorted(self.grams, grams)
        some = np.flatnonzero(self.grams[np.minimum(left, len(self.grams) - 1)] == grams) if len(self.grams) else []
        if len(some) < FEWEST:
            return False
        left, right = left[some], np.searchsorted(self.grams, grams[some], side="right")
        counts = right - left
        at_doc = np.repeat(some, counts)
        where = np.repeat(left - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return leaks(self.words, doc, self.places[where], at_doc)


def extended(pairs: DataFrame, docs: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """The pairs (key, item_id) of which the document repeats a passage. Pairs come in the order of their documents, so the k-grams of each are made once. Items are broadcast up to a checked size; beyond it they are joined salted, as one may meet very many documents."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, _Item] = {}
        last, words, grams = None, None, None
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            ids, docs, texts, items = batch.column("item_id").to_pylist(), batch.column(key).to_pylist(), batch.column("words"), batch.column("item")
            for i, (number, doc) in enumerate(zip(ids, docs)):
                if last is None or doc != last[0] or not texts[i].values.equals(last[1]):
                    words = np.asarray(texts[i].values).astype(np.int64)
                    grams, last = _grams(words, np.array([0, len(words)])), (doc, texts[i].values)
                if (item := known.get(number)) is None:
                    if len(known) >= 20_000:
                        known.clear()
                    item = known[number] = _Item(np.asarray(items[i].values).astype(np.int64))
                good[i] = item.within(words, grams)
            yield batch.select([key, "item_id"]).filter(pa.array(good))

    both, named = pairs.join(docs, key), items.withColumnRenamed("words", "item")
    few = small(named)
    both = both.join(few, "item_id") if few is not named else salted_join(both, named, ["item_id"], F.col(key))
    return both.select(key, "item_id", "words", "item").mapInArrow(work, f"{key} {kind}, item_id long")


def leaked(docs: DataFrame, items: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id): each document with each item of which it repeats a passage.

    Garbled texts are restored first. A passage begins and ends with words that are not
    changed. Items shorter than LEAST_WORDS words, null and empty texts give no row.
    Repeated rows give a row once; of several texts of one item the least by hash counts.
    """
    given = docs.select(key, F.col(text).alias("_text"))
    whole = given.where(~F.col("_text").rlike(garbled.suspect())).union(garbled.repair(given, samples, key, "_text").select(key, "text_new"))
    hashed = whole.select(key, word_hashes(F.col("_text")).alias("words"))
    rows = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("item_id", word_hashes(F.col("text")).alias("words"))
    rows = stored(rows, "items")
    pairs, held = meeting(hashed, rows, key)
    return extended(pairs, held, rows, key).distinct()
