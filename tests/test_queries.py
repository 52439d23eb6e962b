"""Each query with SQL gives what DuckDB gives on the smallest tables; those without run."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from newsloom import plans

DATA = os.environ.get("NEWSLOOM_TESTDATA", "/root/testdata/sf0.001")


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    if name in plans.SQL:
        want = duck.sql(plans.SQL[name])
        assert sorted(want.columns) == columns
        assert got == sorted((tuple(plain(v) for v in r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=str)
