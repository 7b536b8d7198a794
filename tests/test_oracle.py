"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from gridloom.plans import catalog
from gridloom.plans.registry import _TABLES

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "item"):
        return _plain(v.item())
    return v


def assert_same(spark, run, sql, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in _TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = run(spark, sf)
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    got = sorted(repr(tuple(map(_plain, r))) for r in df.collect())
    assert got == sorted(repr(tuple(_plain(r[i]) for i in at)) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["composite_windows", "block_bootstrap", "gap_fill", "connected_to_seed"])
def test_partitions_do_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(repr, catalog.QUERIES[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
