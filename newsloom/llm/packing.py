"""Documents combined into containers of fixed capacity.

Method: bound-certified repacking. Documents are packed in groups by best fit decreasing.
Dual feasible functions give each group a number of containers below which no packing
goes; a group that meets it is certified and done. Groups with a gap release the
documents of containers that aren't full, exchange them with other such groups, and run
again, in fewer and fewer groups, until no gap is left or the gaps no longer shrink.
What bound, containers and gap each group had is part of the result.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

CAPACITY = 2048
#: Documents that a group has about, so that its sizes fit well into a task.
GROUP = 20_000
#: Share of the capacity from which a container counts as full and isn't opened again.
FULL = 0.995
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the tokenizer cuts a text into words before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenCounter:
    """Counts the tokens of texts with a public vocabulary; strings of special tokens are ordinary text."""

    def __init__(self, path: str = TOKENIZER, pattern: str = PATTERN) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY, times: np.ndarray | None = None) -> int:
    """Containers that any packing needs at least, by dual feasible functions: total size, the threshold functions for each threshold, and the rounding functions. times: how often each size occurs, once if not given."""
    if not len(sizes):
        return 0
    times = np.ones(len(sizes), np.int64) if times is None else times
    count = np.bincount(sizes, weights=times, minlength=capacity + 1).astype(np.int64)
    best = -(-int((sizes * times).sum()) // capacity)
    number, weight = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    for a in range(1, capacity // 2 + 1):  # sizes above capacity - a fill a container, those below a count nothing
        big = number[capacity] - number[capacity - a]
        middle = weight[capacity - a] - weight[a - 1]
        best = max(best, int(big) - (-int(middle) // capacity))
    x = np.arange(capacity + 1)
    for k in range(1, 40):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, (scaled // capacity) * capacity)  # k * u(x)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The container of each document, by best fit decreasing: the fullest container with room. Ties go by position."""
    out = np.zeros(len(sizes), np.int64)
    open_at: dict[int, list[int]] = {}
    rooms: list[int] = []  # distinct rooms left, ascending
    made = 0
    for k in np.argsort(-sizes, kind="stable"):
        n = int(sizes[k])
        at = bisect_left(rooms, n)
        if at == len(rooms):
            room, box, made = capacity, made, made + 1
        else:
            room = rooms[at]
            box = open_at[room].pop()
            if not open_at[room]:
                rooms.pop(at)
        out[k] = box
        left = room - n
        if left > 0:
            if not open_at.get(left):
                open_at[left] = []
                insort(rooms, left)
            open_at[left].append(box)
    return out


@cache
def _counter(path: str, pattern: str) -> TokenCounter:
    return TokenCounter(path, pattern)


def token_counts(docs: DataFrame, key: str, text: str, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(key, tokens) of each text; null and empty texts have none and give no row."""
    kind = docs.schema[key].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(path, pattern)
        for f in frames:
            yield pd.DataFrame({key: f[key], "tokens": [counter.count(t) for t in f["_text"]]})

    return docs.select(key, F.col(text).alias("_text")).where("_text is not null and _text <> ''").mapInPandas(work, f"{key} {kind}, tokens long")


def pack(sizes: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(container, key, piece_no, first_token, tokens, partition, bound, used, certified): the pieces of the documents and where they go.

    sizes: key and tokens. A document of at most `capacity` tokens is one piece; a larger
    one is cut into full containers and a rest. Groups are drawn by hash, so a hot key
    can't fill one, and stay near `group` documents in every round. partition names the
    round and group that filled the container, bound is the number of containers that the
    pieces it then held need at least, used the number it took; certified says that the
    two are equal. Full containers are certified by themselves (partition "full"). Rounds
    end when all groups are certified, or when neither the number of groups nor the sum
    of the gaps has gone down. Rows with null or no tokens are left out.
    """
    kept = sizes.select(key, "tokens").where("tokens > 0")
    cut = kept.select(key, F.col("tokens").alias("_all"), F.posexplode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / capacity))).alias("piece_no", "_at"))
    cut = cut.select(key, (F.col("piece_no") + 1).alias("piece_no"), (F.col("_at") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("_all") - F.col("_at") * capacity).alias("tokens"))
    pieces = stored(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    out = ["container", key, "piece_no", "first_token", "tokens", "partition", "bound", "used", "certified"]
    one = F.lit(1).cast("long")
    done = pieces.where(F.col("tokens") == capacity).select(F.concat(F.lit("f-"), F.col("_row").cast("string")).alias("container"), key, "piece_no", "first_token", "tokens", F.lit("full").alias("partition"), one.alias("bound"), one.alias("used"), F.lit(True).alias("certified"))
    rest = pieces.where(F.col("tokens") < capacity)
    left, turn, gap, number = rest.count(), 0, None, None
    schema = f"container string, {key} {sizes.schema[key].dataType.simpleString()}, piece_no int, first_token long, tokens long, partition string, bound long, used long, certified boolean, _row long, _full boolean"
    while left:
        groups = max(1, math.ceil(left / group))
        grouped = rest.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(groups)))
        filled = stored(grouped.groupBy("_group").applyInPandas(_filler(key, turn, capacity), schema), "filled")
        now = filled.select("partition", "bound", "used").distinct().agg(F.sum(F.col("used") - F.col("bound"))).first()[0]  # a row for each group
        if gap is not None and (number, gap) <= (groups, now) or now == 0 or groups == 1:
            return done.union(filled.select(*out))
        settled = F.col("certified") | F.col("_full")
        done = done.union(filled.where(settled).select(*out))
        rest = filled.where(~settled).select(key, "piece_no", "first_token", "tokens", "_row")
        left, turn, gap, number = rest.count(), turn + 1, now, groups
    return done


def _filler(key: str, turn: int, capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fill(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_row", kind="stable").reset_index(drop=True)
        n = f["tokens"].to_numpy(np.int64)
        box = best_fit(n, capacity)
        used = np.bincount(box, weights=n)
        f["container"] = [f"{turn}-{g}-{b}" for g, b in zip(f["_group"], box)]
        f["partition"] = [f"{turn}-{g}" for g in f["_group"]]
        f["bound"], f["used"] = lower_bound(n, capacity), len(used)
        f["certified"] = f["bound"] == f["used"]
        f["_full"] = used[box] >= FULL * capacity
        return f[["container", key, "piece_no", "first_token", "tokens", "partition", "bound", "used", "certified", "_row", "_full"]]

    return fill


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(partition, containers, bound, gap, certified): for each partition the containers it kept, the bound and gap when it was filled; and for all of them, named "all", the bound over all pieces from the counts of their sizes."""
    each = packed.groupBy("partition").agg(F.count_distinct("container").alias("containers"), F.max("bound").alias("bound"), (F.max("used") - F.max("bound")).alias("gap"), F.first("certified").alias("certified"))
    each = each.withColumn("bound", F.when(F.col("partition") == "full", F.col("containers")).otherwise(F.col("bound")))
    counts = packed.groupBy("tokens").agg(F.count("*").alias("n")).collect()  # at most as many rows as the capacity
    bound = lower_bound(np.array([r["tokens"] for r in counts], np.int64), capacity, np.array([r["n"] for r in counts], np.int64))
    total = packed.agg(F.count_distinct("container").alias("containers")).select(F.lit("all").alias("partition"), "containers", F.lit(bound).cast("long").alias("bound"))
    gap = F.col("containers") - F.col("bound")
    return each.union(total.select("partition", "containers", "bound", gap.alias("gap"), (gap == 0).alias("certified")))


def containers(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    """`pack` of the texts by their tokens."""
    return pack(stored(token_counts(docs, key, text, path), "tokens"), key, capacity)
