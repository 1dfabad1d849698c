"""Every query with SQL agrees with DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from glosswerk.plans import registry
from glosswerk.plans.synth import TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows(spark, con, name):
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((plain(tuple(r)) for r in got.select(*want.columns).collect()), key=repr) == sorted(map(plain, want.fetchall()), key=repr)


def test_entry_without_the_optional_parts(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
