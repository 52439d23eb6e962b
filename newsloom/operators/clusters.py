"""Stories as clusters of items with like lead chunks, over all items at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import lead_chunk
from ..session import small, stored
from .forest import spanning_forest
from .vectors import DIMENSION

#: Words that tell nothing of a story.
STOP = ("the", "and", "of", "in", "to", "a", "is", "for", "on", "at", "by", "with", "that", "was", "as", "an", "it", "from", "be", "has", "said")
#: Vectors of a block whose pairs are compared in a task, rows of one product, items that are placed at once.
BLOCK, CHUNK, STEP = 8192, 1024, 128
#: Links up to which one task connects them, in 16 bytes each; words whose buckets a task keeps at hand.
FEW_LINKS, KNOWN_WORDS = 5_000_000, 1_000_000
#: More than the products of rounded vectors are off.
SLACK = 1e-4
BRIEFING, THEMES = 0.85, 0.7


def _parts(df: DataFrame) -> int:
    """Parts to spread rows over, which a small table needs as well where Python works on them."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def lead_vectors(items: DataFrame, text: str = "text") -> DataFrame:
    """(id, ord, buckets, counts): the lead chunk of each item as counts of word buckets, sorted by bucket; no words give empty arrays. items: id, ord and the text."""
    words = F.regexp_extract_all(F.lower("_lead"), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    # A small file is read by one task; what follows is spread over all.
    spread = items.select("id", "ord", lead_chunk(F.col(text)).alias("_lead")).repartition(_parts(items), "id").select("id", "ord", words.alias("words"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for f in frames:
            found = []
            for words in f["words"]:
                at = []
                for w in words:
                    if len(w) < 2 or w in STOP:
                        continue
                    if w not in known:
                        known[w] = int(hashlib.md5(w.encode()).hexdigest()[:16], 16) % DIMENSION
                    at.append(known[w])
                found.append(np.unique(np.asarray(at, np.int32), return_counts=True))
            if len(known) > KNOWN_WORDS:
                known.clear()
            yield pd.DataFrame({"id": f["id"], "ord": f["ord"], "buckets": [b for b, _ in found], "counts": [n.astype(np.int32) for _, n in found]})

    kinds = {c: items.schema[c].dataType.simpleString() for c in ("id", "ord")}
    return spread.mapInPandas(work, f"id {kinds['id']}, ord {kinds['ord']}, buckets array<int>, counts array<int>")


def _rows(buckets: Sequence[np.ndarray], counts: Sequence[np.ndarray]) -> np.ndarray:
    """Sparse vectors as the rows of a matrix, with norm 1."""
    at = np.repeat(np.arange(len(buckets)), [len(b) for b in buckets])
    out = np.zeros((len(buckets), DIMENSION), np.float32)
    if len(at):
        out[at, np.concatenate([np.asarray(b, np.int64) for b in buckets])] = np.concatenate([np.asarray(n, np.float32) for n in counts])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)


def _merged(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each node's component after links between i and j; root: that before."""
    while True:
        i, j = root[i], root[j]
        apart = i != j
        if not apart.any():
            return root
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
        while not ((above := root[root]) == root).all():
            root = above


def _joined(a: np.ndarray, b: np.ndarray | None, least: float) -> np.ndarray:
    """For each row of a, then of b, the first row it is connected with by links between a and b (or within a, if b is None) of at least that cosine."""
    n = len(a)
    other, off = (a, 0) if b is None else (b, n)
    root = np.arange(n + (0 if b is None else len(b)))
    for start in range(0, n, CHUNK):
        i, j = np.nonzero(a[start : start + CHUNK] @ other.T >= least)
        root = _merged(root, i + start, j + off)
    return root


def _links(vectors: DataFrame, least: float) -> DataFrame:
    """(u, v): links that connect what all pairs of at least that cosine connect. Every pair is compared, a block of vectors with another in a task, which gives links of a forest only."""
    n = vectors.count()
    blocks = max(-(-n // BLOCK), min(8, -(-n // CHUNK)))
    tasks = max(1, blocks * (blocks + 1) // 2)
    own = F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))).cast("int")
    meets = vectors.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))))
    p, q = F.least("own", "other"), F.greatest("own", "other")
    # Rows and columns of a triangle as numbers of tasks.
    placed = meets.withColumn("task", (q * (q + 1) / 2 + p).cast("int")).repartitionById(tasks, "task")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: tuple[list, list] = ([], [])
        parts: tuple[list, list] = ([], [])
        for f in frames:
            second = (f["own"] > f["other"]).to_numpy()
            for side, f_of in ((0, f[~second]), (1, f[second])):
                if len(f_of):
                    ids[side].append(f_of["id"].to_numpy())
                    parts[side].append(_rows(f_of["buckets"].tolist(), f_of["counts"].tolist()))
        if not parts[0] and not parts[1]:
            return
        one, two = (np.concatenate(x) if x else None for x in parts)
        every = np.concatenate([*ids[0], *ids[1]]).astype(np.int64)
        if one is None:
            return
        root = _joined(one, two, least - SLACK)
        linked = np.flatnonzero(root != np.arange(len(root)))
        yield pd.DataFrame({"u": every[root[linked]], "v": every[linked]})

    return placed.select("id", "own", "other", "buckets", "counts").mapInPandas(work, "u long, v long")


def components(vectors: DataFrame, least: float) -> DataFrame:
    """(id, component): items that links of at least that cosine connect; others are components of their own. Equal vectors are compared once."""
    worded = vectors.where(F.size("buckets") > 0)
    first = stored(worded.groupBy("buckets", "counts").agg(F.min("id").alias("id"), F.collect_list("id").alias("same")), "storyvectors")
    links = stored(_links(first, least), "storylinks")
    if links.count() <= FEW_LINKS:

        def connect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            every = pd.concat([pd.DataFrame({"u": [], "v": []}, dtype="int64"), *frames])
            nodes, at = np.unique(every[["u", "v"]].to_numpy(np.int64), return_inverse=True)
            at = at.reshape(-1, 2)
            yield pd.DataFrame({"node": nodes, "root": nodes[_merged(np.arange(len(nodes)), at[:, 0], at[:, 1])]})

        found = links.coalesce(1).mapInPandas(connect, "node long, root long")
    else:
        found = spanning_forest(links.select("u", "v", F.xxhash64("u", "v").alias("w")))[1]
    rooted = first.select("id", "same").join(found.select(F.col("node").alias("id"), "root"), "id", "left").select(F.explode("same").alias("id"), F.coalesce("root", "id").alias("component"))
    return vectors.select("id").join(rooted, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


class _Pass:
    """The clusters of one component so far: first members, sums (of one member as it is, of more as rows of a matrix) and means, rounded, to search."""

    def __init__(self, threshold: float, mode: str) -> None:
        self.threshold, self.mode, self.firsts = threshold, mode, []
        self.single, self.row, self.norm = [], [], []
        self.sums, self.rows = np.zeros((4, DIMENSION)), 0
        self.means = np.zeros((4, DIMENSION), np.float32)

    def _near(self, c: int, at: np.ndarray, v: np.ndarray, spread: np.ndarray) -> float:
        if self.row[c] is None:
            on, of = self.single[c]
            return float(spread[on] @ of)
        return float(self.sums[self.row[c], at] @ v) / self.norm[c]

    def _add(self, c: int, at: np.ndarray, v: np.ndarray) -> None:
        if c == len(self.firsts) - 1 and len(self.single) == c:
            self.single.append((at, v))
            self.row.append(None)
            self.norm.append(1.0)
            if c == len(self.means):
                self.means = np.concatenate([self.means, np.zeros_like(self.means)])
            self.means[c, at] = v
            return
        if self.row[c] is None:
            if self.rows == len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            on, of = self.single[c]
            self.row[c], self.single[c] = self.rows, None
            self.sums[self.rows, on] = of
            self.rows += 1
        total = self.sums[self.row[c]]
        total[at] += v
        self.norm[c] = float(np.linalg.norm(total))
        self.means[c] = total / self.norm[c]

    def place(self, ids: list[int], items: list[tuple[np.ndarray, np.ndarray]]) -> list[int | None]:
        """The first members of the clusters that items go to, in order; None for one without words where only themes are wanted.

        Clusters that are there before are searched for all items at once; those made or
        changed since are compared one by one. What comes near is weighed exactly."""
        made, out = len(self.firsts), []
        found = _rows([at for at, _ in items], [n for _, n in items]) @ self.means[:made].T >= self.threshold - SLACK if made else None
        changed: dict[int, None] = {}
        spread = np.zeros(DIMENSION)
        for k, (item, (at, n)) in enumerate(zip(ids, items)):
            norm = np.sqrt((n * n).sum())
            if not norm:
                out.append(item if self.mode == "best" else None)
                continue
            v = n / norm
            spread[at] = v
            touched = np.fromiter(changed, np.int64, len(changed))
            near_touched = touched[self.means[touched] @ spread.astype(np.float32) >= self.threshold - SLACK] if len(touched) else touched
            before = np.flatnonzero(found[k]) if made else touched[:0]
            best, c = -1.0, None
            for at_c in np.union1d(before, near_touched).tolist():
                near = self._near(at_c, at, v, spread)
                if near >= self.threshold and near > best:
                    best, c = near, at_c
                    if self.mode == "first":
                        break
            if c is None:
                c = len(self.firsts)
                self.firsts.append(item)
            self._add(c, at, v)
            changed[c] = None
            spread[at] = 0
            out.append(self.firsts[c])
        return out


def story_clusters(items: DataFrame, threshold: float = BRIEFING, mode: str = "best", text: str = "text") -> DataFrame:
    """(id, cluster_id): the single pass over items in the order of ord and id, descending: each goes to the best (or first) cluster whose mean is near enough, else makes one, named by it.

    A cluster never leaves a component of links of cosine threshold squared, for an item
    near its mean is that near to a member; so components are worked off apart from each
    other, in order, some items at a time, and only their clusters are held. All pairs are
    searched for links, so the clusters are those of the pass. Items without words are
    clusters of their own (best) or left out (first).
    """
    return clusters_of(stored(lead_vectors(items, text), "leads"), threshold, mode)


def clusters_of(vectors: DataFrame, threshold: float = BRIEFING, mode: str = "best") -> DataFrame:
    """`story_clusters` of lead vectors, which should be stored, as they are read several times."""
    parts = components(vectors, threshold * threshold)
    together = stored(vectors.join(parts, "id"), "storyparts")
    more = together.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1").select("component")
    alone = together.join(more, "component", "left_anti").where(F.lit(mode == "best") | (F.size("buckets") > 0)).select("id", F.col("id").alias("cluster_id"))
    ordered = together.join(more, "component", "left_semi").repartition(_parts(vectors), "component").sortWithinPartitions("component", F.desc("ord"), F.desc("id"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now = None, None
        for f in frames:
            ids, to = f["id"].tolist(), []
            component = f["component"].to_numpy()
            pairs = [(np.asarray(b, np.int64), np.asarray(n, np.float64)) for b, n in zip(f["buckets"], f["counts"])]
            edges = [0, *(np.flatnonzero(component[1:] != component[:-1]) + 1).tolist(), len(ids)]
            for start, end in zip(edges, edges[1:]):
                if start < end and (now is None or component[start] != at):
                    at, now = component[start], _Pass(threshold, mode)
                for k in range(start, end, STEP):
                    to += now.place(ids[k : min(k + STEP, end)], pairs[k : min(k + STEP, end)])
            kept = [(i, c) for i, c in zip(ids, to) if c is not None]
            yield pd.DataFrame({"id": pd.Series([i for i, _ in kept], dtype="int64"), "cluster_id": pd.Series([c for _, c in kept], dtype="int64")})

    return ordered.select("component", "id", "buckets", "counts").mapInPandas(work, "id long, cluster_id long").unionByName(alone)


def representatives(members: DataFrame) -> DataFrame:
    """(cluster_id, representative): the most relevant member, then one under review, then that with the longest title, then the first in order. members: cluster_id, id, ord, government_relevance, needs_human_review, title."""
    rel = F.lower("government_relevance")
    key = F.struct(F.when(rel == "high", 3).when(rel == "medium", 2).when(rel == "low", 1).otherwise(0).alias("rel"), F.coalesce("needs_human_review", F.lit(False)).alias("rev"), F.coalesce(F.length("title"), F.lit(0)).alias("len"), "ord", "id")
    return members.groupBy("cluster_id").agg(F.max(key).alias("k")).select("cluster_id", F.col("k.id").alias("representative"))


def cluster_stats(members: DataFrame) -> DataFrame:
    """(cluster_id, size, sources, source_names, member_ids, latest_ingested, latest_published, counts of portrayals, people_issue, dominant) of clusters. Ids are listed for clusters as a theme shows them, sorted."""
    kinds = [F.count_if(F.col("portrayal") == k).alias(k) for k in ("positive", "negative", "mixed", "neutral")]
    out = members.groupBy("cluster_id").agg(
        F.count("*").alias("size"), F.count_distinct("source_name").alias("sources"), F.array_sort(F.collect_set("source_name")).alias("source_names"), F.array_sort(F.collect_set("id")).alias("member_ids"),
        F.max("ingested_at").alias("latest_ingested"), F.max("published_at").alias("latest_published"), F.bool_or(F.coalesce("people_issue", F.lit(False))).alias("people_issue"), *kinds,
    )
    most = F.greatest("positive", "negative", "mixed", "neutral")
    return out.withColumn("dominant", F.when(F.col("negative") == most, "negative").when(F.col("positive") == most, "positive").when(F.col("mixed") == most, "mixed").otherwise("neutral"))


def cards(members: DataFrame, overrides: DataFrame) -> DataFrame:
    """A card for each cluster whose representative is relevant: what its statistics and representative say, its sources in order and the category, an operator's override of any member first.

    overrides: id and corrected portrayal; of several the one of the first member in
    order. ord of a card is its place: most sources, most items, latest, representative.
    """
    said = members.join(overrides.select("id", "corrected"), "id").groupBy("cluster_id").agg(F.max_by("corrected", F.struct("ord", "id")).alias("corrected"))
    chosen = representatives(members).join(members.select(F.col("id").alias("representative"), "analysis_id", "title", "source_name", "government_relevance", "portrayal", "severity", "action_priority", "needs_human_review", "public_issue", "department", "district", "summary"), "representative")
    kept = chosen.where(F.lower(F.coalesce("government_relevance", F.lit(""))) != "none").withColumnRenamed("portrayal", "own")
    joined = kept.join(cluster_stats(members), "cluster_id").join(small(said), "cluster_id", "left").withColumn("portrayal", F.coalesce("corrected", "own")).drop("own", "corrected")
    category = F.when(F.col("people_issue") & (F.col("portrayal") == "neutral"), "people").otherwise(F.col("portrayal"))
    return joined.withColumns({"category": category, "raw_item_id": F.col("representative"), "at": F.coalesce("latest_published", "latest_ingested")})


#: The order of a briefing, and that of themes.
BRIEFING_ORDER = (F.desc, "sources"), (F.desc, "size"), (F.desc_nulls_last, "latest_ingested"), (F.asc, "representative")
THEME_ORDER = (F.desc, "size"), (F.desc, "sources"), (F.desc_nulls_last, "latest_published"), (F.asc, "representative")


def in_order(clusters: DataFrame, order: tuple, limit: int | None = None) -> DataFrame:
    out = clusters.orderBy(*[how(c) for how, c in order])
    return out if limit is None else out.limit(limit)
