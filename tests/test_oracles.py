"""Every query of the library proper gives the rows of its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from recallspark.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    found = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        found.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return found


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.5f}"
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, con, sf, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    said = con.sql(registry.ORACLES[name])
    assert sorted(said.columns) == columns
    places = [said.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in places) for r in said.fetchall())
    assert got == want
