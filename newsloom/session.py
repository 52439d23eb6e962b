"""Session defaults, shared-folder tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side of a join is broadcast after it has been counted.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Parts into which the rows of one key are salted where a key may be hot.
SALTS = 16


def local_session(app: str = "newsloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="newsloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/newsloom/{spark.sparkContext.applicationId}"


def clear_stored(spark: SparkSession) -> None:
    """Removes the tables that this application stored. Only for when no result that reads them is still to be computed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _row_bytes(schema: T.StructType) -> Column:
    """About how many bytes a row holds."""
    out = F.lit(0).cast("long")
    for f in schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            one = F.octet_length(f.name)
        elif isinstance(f.dataType, T.ArrayType):
            one = F.size(f.name) * 8 if not isinstance(f.dataType.elementType, T.StringType) else F.octet_length(F.array_join(f.name, "")) + 8 * F.size(f.name)
        elif isinstance(f.dataType, (T.MapType, T.StructType)):
            one = F.octet_length(F.to_json(f.name))
        else:
            one = F.lit(8)
        out = out + F.coalesce(one, F.lit(0)) + 8
    return out


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows and about `most` bytes; otherwise df, so that the join shuffles. Reads at most limit + 1 rows; df should be stored or cheap, as it is computed again for the join."""
    rows, held = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(_row_bytes(df.schema)), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and held <= most else df


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """many join few on keys, for keys of which one may hold a large share of `many`: its rows are salted by `spread`, those of `few` repeated for each salt, so no task gets a whole key."""
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, so that they need no installed copy."""
    context = spark.sparkContext
    if getattr(context, "_newsloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="newsloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/newsloom.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(f"{folder}/newsloom.zip")
    context._newsloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
