"""Bag-of-words vectors, similarity, top-k and the clustering of stories."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSION = 1024


def word_buckets(texts: DataFrame, key: str, text: str, dimension: int = DIMENSION, stop: tuple[str, ...] = ()) -> DataFrame:
    """(key, bucket, n): how often words of a bucket occur in a text. A word's bucket is the first half of its md5, modulo the dimension."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    one = texts.select(key, F.explode(words).alias("w")).where((F.length("w") >= 2) & ~F.col("w").isin(*stop) if stop else F.length("w") >= 2)
    bucket = (F.conv(F.substring(F.md5("w"), 1, 16), 16, 10).cast("decimal(20,0)") % dimension).cast("int")
    return one.groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def unit(v: Column) -> Column:
    """The vector with norm 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 4096, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k nearest vectors of each query, by cosine, ties by key.

    queries: query_id and vector. They are taken in blocks of at most `block`, each sent
    to all tasks once as a matrix; each batch keeps its own k best, which are merged. So
    all rows are searched, and only k rows a query and batch are shuffled. allowed: keys
    that may come out, if given. Vectors of another dimension than a query's are passed
    over; k of 0 or less, null vectors and empty tables give no row.
    """
    kept = vectors if allowed is None else vectors.join(allowed.select(key).distinct(), key, "left_semi")
    rows = queries.select("query_id", vector).where(F.col(vector).isNotNull() & F.col("query_id").isNotNull()).orderBy("query_id")
    parts, last = [], None
    while k > 0:
        got = (rows if last is None else rows.where(F.col("query_id") > last)).limit(block).collect()
        if not got:
            break
        last = got[-1]["query_id"]
        for size in sorted({len(r[vector]) for r in got}):
            some = [r for r in got if len(r[vector]) == size]
            ids = np.array([r["query_id"] for r in some])
            q = _normed(np.array([r[vector] for r in some], np.float64))

            def best(frames: Iterator[pd.DataFrame], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pd.DataFrame]:
                for f in frames:
                    if not len(f):
                        continue
                    keys = f[key].to_numpy()
                    score = q @ _normed(np.stack(f[vector].to_numpy()).astype(np.float64)).T
                    n = min(k, len(keys))
                    # Ties at the edge are kept, so that the least key can win them.
                    edge = np.partition(score, len(keys) - n, axis=1)[:, len(keys) - n]
                    i, j = np.nonzero(score >= edge[:, None] - 1e-9)
                    yield pd.DataFrame({"query_id": ids[i], key: keys[j], "score": score[i, j]})

            same = kept.where(F.size(vector) == size).select(key, vector)
            parts.append(same.mapInPandas(best, f"query_id long, {key} long, score double"))
        if len(got) < block:
            break
    if not parts:
        return vectors.select(F.lit(0).cast("long").alias("query_id"), F.col(key).cast("long").alias(key), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    at = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), key)
    return out.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k)


def _normed(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, code): an index of all rows, each unit vector in one signed byte a dimension."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "code": [np.round(_normed(np.asarray(v, np.float64)[None, :])[0] * 127).astype(np.int8).tobytes() for v in f[vector]]})

    return vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(work, f"{key} long, code binary")


def top_k_quantised(index: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", wider: int = 4) -> DataFrame:
    """`top_k` by an index of bytes: of each query the wider * k best by their codes are ranked again by their vectors."""
    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], vector: [np.frombuffer(c, np.int8).astype(np.float32).tolist() for c in f["code"]]})

    rough = top_k(index.mapInPandas(decode, f"{key} long, {vector} array<float>"), queries, wider * k, key, vector).select("query_id", key)
    exact = rough.join(vectors.select(key, vector), key).join(queries.select("query_id", F.col(vector).alias("_q")), "query_id").withColumn("score", cosine(F.col(vector), F.col("_q")))
    at = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), key)
    return exact.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k).select("query_id", key, "score", "rank")


def hash_embedding(text: Column, dimension: int = 64) -> Column:
    """A unit vector from the bytes of sha256("counter:text"), each as byte / 127.5 - 1; all in the JVM."""

    def part(n: int) -> Column:
        digest = F.sha2(F.concat(F.lit(f"{n}:"), text), 256)
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(digest.substr(2 * i + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)

    parts = [part(n) for n in range(-(-dimension // 32))]
    return F.when(text.isNotNull(), unit(F.slice(F.flatten(F.array(*parts)), 1, dimension)))


def provider_embeddings(texts: DataFrame, key: str, text: str, provider: Callable[[list[str]], list[list[float]]], dimension: int) -> DataFrame:
    """(key, embedding) by a provider that is asked for a batch of texts at once; a vector of another dimension is an error."""
    kind = texts.schema[key].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = provider(f["_text"].tolist())
            if any(len(v) != dimension for v in made):
                raise ValueError(f"vectors of {dimension} dimensions were expected")
            yield pd.DataFrame({key: f[key], "embedding": made})

    return texts.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text")).mapInPandas(work, f"{key} {kind}, embedding array<float>")


def unit_words(counts: DataFrame, key: str) -> DataFrame:
    """Adds to (key, bucket, n) the weight of a bucket in the unit vector of its text."""
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("_norm"))
    return counts.join(norms, key).withColumn("weight", F.col("n") / F.col("_norm")).drop("_norm")


def assign_in_order(vectors: np.ndarray, threshold: float, mode: str = "best") -> np.ndarray:
    """Clusters of rows taken in order: the best (or first) cluster whose running mean is near enough, else a new one. Zero rows: alone (best), -1 (first)."""
    n, d = vectors.shape
    out, sums, counts, made = np.full(n, -1), np.zeros((max(n, 1), d)), np.zeros(max(n, 1)), 0
    means = np.zeros((max(n, 1), d))
    for i, v in enumerate(vectors):
        norm = np.linalg.norm(v)
        if norm == 0:
            if mode == "best":
                out[i], made = made, made + 1
            continue
        near = means[:made] @ (v / norm)
        fits = np.flatnonzero(near >= threshold)
        if len(fits):
            c = int(fits[np.argmax(near[fits])] if mode == "best" else fits[0])
        else:
            c, made = made, made + 1
        out[i] = c
        sums[c] += v
        counts[c] += 1
        mean = sums[c] / counts[c]
        means[c] = mean / max(np.linalg.norm(mean), 1e-300)
    return out
