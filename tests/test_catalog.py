"""Each query against its SQL on the driver's tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from gridloom.plans import catalog

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert rows or name in ("cycle_regression", "god_modules", "test_cycle_violations")
    if name in catalog.ORACLES:
        names = ", ".join(f'"{c}"' for c in columns)
        want = sorted((tuple(map(plain, r)) for r in duck.sql(f"SELECT {names} FROM ({catalog.ORACLES[name]}) q").fetchall()), key=str)
        assert rows == want
