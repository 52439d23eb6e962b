"""Tables in folders: insert if absent, upsert, append, exports. Each write makes a new snapshot and then points to it."""

from __future__ import annotations

import re
import uuid
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.current import best_row

POST = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("handle", T.StringType()), T.StructField("text", T.StringType()), T.StructField("created_at", T.TimestampType()),
        T.StructField("lang", T.StringType()), T.StructField("public_metrics", T.MapType(T.StringType(), T.LongType())),
    ]
)


TRANSCRIPT = "video_id string, channel string, title string, description string, transcript string, published_at timestamp"


class SnapshotTable:
    """A table at `path`: folders of Parquet files, and numbered manifests m-..., each a list of the folders that hold at one time.

    The manifest of the greatest number holds. A writer adds folders first and then a
    manifest under the next number, made under another name and renamed, which fails if
    that number is there: so readers see all of a write or nothing, an interrupted write
    leaves the old snapshot, and of two writers at once one is refused and can try again.
    Appends and inserts add a folder; only upserts write rows anew, and only folders that
    hold a key of the batch.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop, self._io = jvm.org.apache.hadoop.fs, jvm.org.apache.commons.io.IOUtils
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        """The number of the snapshot that holds; None if nothing was written yet."""
        at = self._hadoop.Path(self.path)
        if not self._fs.exists(at):
            return None
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return max((int(n[2:]) for n in names if re.fullmatch(r"m-\d+", n)), default=None)

    def folders(self, version: int | None = None) -> list[str]:
        version = self.version() if version is None else version
        if version is None:
            return []
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/m-{version:08d}"))
        try:
            return [x for x in bytes(self._io.toByteArray(stream)).decode().split("\n") if x]
        finally:
            stream.close()

    def _part(self, folders: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a snapshot, the current one if none is named; None if nothing was written yet."""
        folders = self.folders(version)
        return self._part(folders) if folders else None

    def _write(self, rows: DataFrame) -> str:
        name = f"d-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _commit(self, version: int | None, folders: list[str]) -> None:
        to = self._hadoop.Path(f"{self.path}/m-{(version or 0) + 1:08d}")
        made = self._hadoop.Path(f"{self.path}/.m-{uuid.uuid4().hex}")
        out = self._fs.create(made, True)
        out.write(bytearray("\n".join(folders).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(made, to):
            self._fs.delete(made, False)
            raise RuntimeError(f"another writer made snapshot {to.getName()}")

    def replace(self, rows: DataFrame) -> None:
        version = self.version()
        self._commit(version, [self._write(rows)])

    def insert_new(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Adds the rows whose key isn't there, one per key; null keys equal each other. Returns what was added. The rows that are there are neither moved nor written."""
        version = self.version()
        old, new = self.read(version), rows.dropDuplicates(keys)
        if old is not None:
            new = new.alias("n").join(old.select(*keys).alias("o"), _same_keys(keys), "left_anti")
        name = self._write(new)
        self._commit(version, [*self.folders(version), name])
        return self._part([name])

    def upsert(self, rows: DataFrame, keys: list[str], order: list[Column]) -> None:
        """Keeps the first row of each key by `order` among old and new ones; running it again changes nothing. Folders without a key of the batch stay as they are."""
        version = self.version()
        folders, wanted = self.folders(version), rows.select(*keys).distinct()
        touched = [f for f in folders if self._part([f]).select(*keys).alias("n").join(wanted.alias("o"), _same_keys(keys), "left_semi").limit(1).count()]
        both = rows if not touched else self._part(touched).unionByName(rows, allowMissingColumns=True)
        name = self._write(best_row(both, keys, order))
        self._commit(version, [*[f for f in folders if f not in touched], name])

    def append(self, rows: DataFrame) -> None:
        """Adds rows, their strings trimmed."""
        version = self.version()
        trimmed = rows.withColumns({f.name: F.trim(f.name) for f in rows.schema if isinstance(f.dataType, T.StringType)})
        self._commit(version, [*self.folders(version), self._write(trimmed)])

    def clean(self, keep: int = 2) -> int:
        """Removes all but the last `keep` snapshots and the folders that none of them names; returns how many folders. Not while someone reads an older snapshot or writes."""
        last = self.version()
        if last is None:
            return 0
        kept = {f for v in range(max(1, last - keep + 1), last + 1) for f in self.folders(v)}
        gone = 0
        for f in self._fs.listStatus(self._hadoop.Path(self.path)):
            name = f.getPath().getName()
            if name.startswith("d-") and name not in kept:
                gone += bool(self._fs.delete(f.getPath(), True))
            elif name.startswith(".m-") or (re.fullmatch(r"m-\d+", name) and int(name[2:]) <= last - keep):
                self._fs.delete(f.getPath(), False)
        return gone


def _same_keys(keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
    return same


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Videos with their transcripts from JSON lines; what fetches them is no part of this."""
    return spark.read.schema(TRANSCRIPT).json(path)


def transcript_items(videos: DataFrame) -> DataFrame:
    """(raw_item_id, text): description and transcript joined by a blank line; blanks are left out."""
    filled = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return videos.select("raw_item_id", F.concat_ws("\n\n", filled("description"), filled("transcript")).alias("text"))


def cross_reference(hits: DataFrame, least: int = 3) -> DataFrame:
    """(theme, article_count, distinct_domains, has_signal) of given hits (theme, url); `least` articles make a signal."""
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    out = hits.groupBy("theme").agg(F.count("*").alias("article_count"), F.count_distinct(host).alias("distinct_domains"))
    return out.withColumn("has_signal", F.col("article_count") >= least)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts from JSON lines; unknown fields are ignored, malformed lines give nulls."""
    return spark.read.schema(POST).json(path)


def read_config(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A registry of sources or seeds from a JSON document, or a YAML one where a reader for it is installed; empty where the file is absent."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    if path.endswith((".yaml", ".yml")):
        import yaml

        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # a file that a person wrote
        return spark.createDataFrame([tuple(row.get(f.name) for f in schema) for row in yaml.safe_load(text) or []], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def posts_of(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Posts given in memory, for tests and trials."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in POST) for r in rows], POST)


def feeds_of(spark: SparkSession, feeds: dict[str, str]) -> DataFrame:
    """Feeds given in memory: source and XML."""
    return spark.createDataFrame(sorted(feeds.items()), "source_name string, xml string")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, other than ASCII characters as they are."""
    rows.write.mode("overwrite").json(path)


def report_path(root: str, name: str) -> str:
    """Where a report of that name goes; a name that would leave the folder is refused."""
    if not re.fullmatch(r"[\w.-]+", name) or name in (".", "..") or name.startswith("."):
        raise ValueError(f"not the name of a report: {name!r}")
    return str(PurePosixPath(root) / f"{name}.md")


def daily_report(items: DataFrame, analyses: DataFrame, day: str, least: int = 20) -> str:
    """A report on one day in Markdown: counts of all analyses by stance, the busiest sources, what waits for review. At most `least` rows of each list reach the driver."""
    from ..functions.text import markdown_escaped

    kept = items.where(F.date_format(F.coalesce("published_at", "ingested_at"), "yyyy-MM-dd") == day).select(F.col("id").alias("raw_item_id"), "source_name", "title")
    joined = kept.join(analyses.select("raw_item_id", "stance_toward_government", "needs_human_review"), "raw_item_id")
    stances = joined.groupBy("stance_toward_government").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stance_toward_government").limit(least).collect()
    sources = kept.groupBy(markdown_escaped(F.coalesce("source_name", F.lit(""))).alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s").limit(least).collect()
    waiting = joined.where("needs_human_review").select(markdown_escaped(F.coalesce("title", F.lit(""))).alias("t"), "raw_item_id").distinct().orderBy("raw_item_id").limit(least).collect()
    parts = [f"# {day}", "", "## Stances", *(f"- {r[0]}: {r['n']}" for r in stances), "", "## Sources", *(f"- {r['s']}: {r['n']}" for r in sources), "", "## Waiting for review", *(f"- {r['t']}" for r in waiting)]
    return "\n".join(parts) + "\n"
