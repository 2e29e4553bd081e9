"""Every registered query of the library against its DuckDB equivalent, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from rowscout import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def test_entry_and_names(spark):
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_duckdb(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = list(got.columns)
    assert [str(t) for t in got.dtypes] == [str(t) for t in want[columns].dtypes]
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) and (len(a) or name == "filter_min_velocity")  # no speed of so few samples passes
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_preflight_reads_the_whole_table(spark):
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey", "o_custkey").toPandas()
    key = [o.o_custkey // 10, o.o_orderkey % 30]
    span = o.o_orderkey % 5 == 0
    unsound = (o.o_custkey[span] % 17 == 0).groupby(o.o_custkey[span] // 10).sum()
    repeated = {}
    asked, granted = (o[m].groupby([k[m] for k in key]).size() for m in (o.o_orderkey % 3 == 0, span))
    for pair in set(asked.index) | set(granted.index):
        repeated[pair[0]] = repeated.get(pair[0], 0) + (max(asked.get(pair, 0), granted.get(pair, 0)) > 1)
    got = {r.file_id: r for r in registry.QUERIES["range_audit_preflight"](spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(repeated)
    assert all((r.repeated, r.unsound) == (repeated[k], unsound.get(k, 0)) for k, r in got.items())
