"""Queries against their SQL, on whole tables."""

import os
from pathlib import Path

import duckdb
import pytest

from gridloom.llm import queries

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    duck = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        duck.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]}) q").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want, key=str)
