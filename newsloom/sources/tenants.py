"""Tenants, each with tables in a folder of its own; users and what they may see. Keys and passwords are another's task: they come as hashes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.current import best_row
from .tables import SnapshotTable

TENANT = "slug string, name string, path string, status string"
ROLES = ("owner", "editor", "viewer")


def tenant_slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")


def provision(spark: SparkSession, root: str, name: str) -> str:
    """The folder of a tenant; made known the first time, the same for the same name afterwards."""
    slug = tenant_slug(name)
    if not slug:
        raise ValueError("a tenant needs a name of letters or digits")
    path = f"{root.rstrip('/')}/{slug}"
    SnapshotTable(spark, f"{root}/tenants").insert_new(spark.createDataFrame([(slug, name, path, "active")], TENANT), ["slug"])
    return path


def memberships(users: DataFrame, tenants: DataFrame) -> DataFrame:
    """(email, slug, role) of users in tenants; of several roles the highest; unknown roles and tenants are left out. users: email, slug, role."""
    rank = F.coalesce(*[F.when(F.col("role") == r, i) for i, r in enumerate(ROLES)])
    kept = users.withColumn("_r", rank).where("_r is not null").join(tenants.select("slug"), "slug", "left_semi")
    return best_row(kept, ["email", "slug"], [F.asc("_r")]).select("email", "slug", "role")


def allowed(keys: DataFrame, asked: DataFrame, tenants: DataFrame) -> DataFrame:
    """(key_hash, slug, allowed) of asked keys: known, and of a tenant that isn't suspended. keys: key_hash, slug."""
    live = tenants.where("status = 'active'").select("slug", F.lit(True).alias("_live"))
    known = keys.join(live, "slug", "left")
    return asked.join(known, "key_hash", "left").select("key_hash", "slug", F.coalesce("_live", F.lit(False)).alias("allowed"))


def usage(spark: SparkSession, tenants: DataFrame, tables: tuple[str, ...]) -> DataFrame:
    """(slug, table, rows) of the tables in the tenants' folders; what isn't written yet has none. The tenants are few, and each count reads no column."""
    out = spark.createDataFrame([], "slug string, table string, rows long")
    for r in tenants.select("slug", "path").orderBy("slug").collect():
        for name in tables:
            rows = SnapshotTable(spark, f"{r['path']}/{name}").read()
            if rows is not None:
                out = out.union(rows.agg(F.lit(r["slug"]).alias("slug"), F.lit(name).alias("table"), F.count("*").alias("rows")))
    return out
