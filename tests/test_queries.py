import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lexikv.plans.oracles import SQL
from lexikv.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _key(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "null"
    return str(x) if isinstance(x, (bool, str)) else repr(round(float(x), 8))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    rows = [sorted(tuple(map(_key, r)) for r in f[sorted(f.columns)].itertuples(index=False)) for f in (ours, theirs)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_stored_values_shrink(spark):
    rows = QUERIES["cstrlen_le_raw"](spark, SF).collect()
    assert all(r.stored_len <= r.raw_len for r in rows)
    assert any(r.stored_len < r.raw_len for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
