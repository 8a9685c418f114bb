"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from taxospark.operators import profiling
from taxospark.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, order):
    def cell(v):
        return "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    conn = duckdb.connect()
    for t in TABLES:
        conn.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return conn


def compare(spark, duck, run, sql, sf=SF):
    df = run(spark, sf)
    found = df.collect()
    told = duck.execute(sql)
    names = [c[0] for c in told.description]
    assert sorted(names) == sorted(df.columns)
    want = told.fetchall()
    assert plain(found, [df.columns.index(c) for c in sorted(df.columns)]) == plain(want, [names.index(c) for c in sorted(names)])


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    if name not in plans.SQL:
        assert plans.QUERIES[name](spark, SF).count() > 0
    else:
        compare(spark, duck, plans.QUERIES[name], plans.SQL[name])


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_profile_merge_beyond_the_distinct_cap(spark, tmp_path):
    for t in TABLES:
        if t != "customer":
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    n = profiling.DISTINCT_CAP + 50
    spark.range(n).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "int(id % 25) AS c_nationkey", "1D AS c_acctbal", "'MACHINERY' AS c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    conn = duckdb.connect()
    for t in TABLES:
        conn.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet{'/*.parquet' if t == 'customer' else ''}'")
    compare(spark, conn, plans.QUERIES["profile_merge"], plans.SQL["profile_merge"], str(tmp_path))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
