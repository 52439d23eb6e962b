"""Items and posts as streams: exactly-once inserts, cursors, late data by day."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash, normal_url
from ..operators.analyzer import analyze
from ..session import stored
from ..sources.tables import POST, SnapshotTable

ITEM = T.StructType(
    [
        T.StructField("source_name", T.StringType()), T.StructField("source_url", T.StringType()), T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()), T.StructField("published_at", T.TimestampType()), T.StructField("ingested_at", T.TimestampType()),
    ]
)


class Counters:
    """What an ingest saw, saved, skipped and failed on; added up over its batches."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}

    def add(self, **counts: int) -> None:
        for k, n in counts.items():
            self.counts[k] = self.counts.get(k, 0) + n


class Job:
    """An ingest that is idle, running, finished or failed, and refuses to be started while it runs."""

    def __init__(self) -> None:
        self.state, self.error, self._lock = "idle", "", threading.Lock()

    def run(self, work: Callable[[], None]) -> bool:
        """Whether the work was started; its error, if any, is kept."""
        with self._lock:
            if self.state == "running":
                return False
            self.state, self.error = "running", ""
        try:
            work()
            self.state = "finished"
        except Exception as e:  # noqa: BLE001
            self.state, self.error = "failed", str(e)
        return True


def daily(spark: SparkSession, folder: str, root: str, then: Callable[[DataFrame], None] | None = None) -> dict[str, int]:
    """A day's run: what is new in the folder goes in, then what depends on the items is made again. Returns the counters; run again without new files it does nothing."""
    counters = Counters()
    ingest(item_stream(spark, folder), f"{root}/items", f"{root}/checkpoint", counters).awaitTermination()
    items = SnapshotTable(spark, f"{root}/items").read()
    if then is not None and items is not None and counters.counts.get("saved"):
        then(items)
    return counters.counts


class Materialized:
    """A result that is kept as a table until what it was made from changes or it is called stale."""

    def __init__(self, table: SnapshotTable, make: Callable[[DataFrame], DataFrame]) -> None:
        self.table, self.make, self._at, self._kept = table, make, None, None

    def read(self) -> DataFrame | None:
        now = self.table.version()
        if now is None:
            return None
        if self._kept is None or now != self._at:
            self._kept, self._at = stored(self.make(self.table.read()), "materialized"), now
        return self._kept

    def invalidate(self) -> None:
        self._kept = None


def item_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New files of JSON lines in a folder."""
    return spark.readStream.schema(ITEM).option("maxFilesPerTrigger", files_per_batch).json(folder)


def prepared(items: DataFrame, late: str = "30 days") -> DataFrame:
    """Items with normal URL and content hash, each content once within the time that late items may take. Items without text are dropped."""
    kept = items.where("text is not null and trim(text) <> ''").withColumn("source_url", normal_url("source_url"))
    hashed = kept.withColumn("content_hash", content_hash(source_url=F.col("source_url"), title=F.col("title"), text=F.col("text")))
    if not items.isStreaming:
        return hashed.dropDuplicates(["content_hash"])
    return hashed.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["content_hash"])


def ingest(items: DataFrame, table: str, checkpoint: str, counters: Counters | None = None) -> StreamingQuery:
    """Classifies new items and inserts those that the table doesn't have. A batch that runs twice adds nothing the second time. counters, if given, hold what came and what of it was new."""

    def insert(batch: DataFrame, number: int) -> None:
        seen = Observation(f"batch-{number}")
        watched = batch.observe(seen, F.count(F.lit(1)).alias("seen"), F.count_if(F.col("text").isNull()).alias("failed"))
        saved = SnapshotTable(batch.sparkSession, table).insert_new(analyze(watched, body="text", url="source_url"), ["content_hash"]).count()
        if counters is not None:
            counters.add(seen=seen.get["seen"], failed=seen.get["failed"], saved=saved, skipped=seen.get["seen"] - saved)

    return prepared(items).writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_day(items: DataFrame, late: str = "10 days") -> DataFrame:
    """Items of each source and day; days close once the watermark has passed them."""
    day = F.window("ingested_at", "1 day")
    return items.withWatermark("ingested_at", late).groupBy(day.alias("day"), "source_name").agg(F.count("*").alias("n")).select(F.col("day.start").alias("day"), "source_name", "n")


def advance_cursor(spark: SparkSession, table: str, posts: DataFrame, failed: DataFrame) -> None:
    """Moves each handle's cursor to its greatest post id, read as a number; handles with a failure stay where they are."""
    done = posts.groupBy("handle").agg(F.max(F.col("id").cast("decimal(38,0)")).alias("cursor")).join(failed.select("handle"), "handle", "left_anti")
    SnapshotTable(spark, table).upsert(done, ["handle"], [F.desc("cursor")])


def since(posts: DataFrame, cursors: DataFrame | None, limit: int = 100) -> DataFrame:
    """The next `limit` posts of each handle after its cursor, by id."""
    from pyspark.sql import Window

    numbered = posts.withColumn("_n", F.col("id").cast("decimal(38,0)"))
    if cursors is not None:
        numbered = numbered.join(cursors, "handle", "left").where("cursor is null or _n > cursor").drop("cursor")
    at = Window.partitionBy("handle").orderBy("_n")
    return numbered.withColumn("_r", F.row_number().over(at)).where(F.col("_r") <= limit).drop("_r", "_n")


def post_url(handle: Column, number: Column) -> Column:
    """The one address of a post."""
    return F.concat(F.lit("https://x.example/"), handle, F.lit("/status/"), number)


def post_items(posts: DataFrame) -> DataFrame:
    """Posts as items; empty texts are dropped."""
    kept = posts.where("trim(coalesce(text, '')) <> ''")
    url = post_url(F.col("handle"), F.col("id"))
    return kept.select(F.concat(F.lit("@"), "handle").alias("source_name"), url.alias("source_url"), F.concat(F.lit("Post by @"), "handle").alias("title"), "text", F.col("created_at").alias("published_at"), F.col("created_at").alias("ingested_at"))


__all__ = ["ITEM", "POST", "advance_cursor", "counts_by_day", "ingest", "item_stream", "post_items", "prepared", "since"]
