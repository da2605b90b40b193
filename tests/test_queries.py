"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from townwire.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def keyed(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert keyed(df.columns, got) == keyed(want.columns, want.fetchall())
    else:
        assert got


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
