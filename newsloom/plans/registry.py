"""The registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one input by name: t.raw_items."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._at, self.place = (spark, sf_dir), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(*self._at, name)


def query(sql: str | None = None) -> Callable:
    """Registers f(tables) under its name; sql is what DuckDB runs on the same tables."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
