"""Queries against their SQL on made tables, where the smallest tables leave a case out."""

import os

import duckdb
import pytest

from gridloom.operators.ordering import file_pieces, mean_in_order
from gridloom.plans import catalog
from gridloom.plans.registry import _TABLES
from tests.test_oracle import SF, _plain, assert_same


def made(folder, lineitem, options="FORMAT parquet"):
    """The smallest tables with another lineitem, given as a SELECT over `lineitem`."""
    for t in _TABLES:
        if t != "lineitem":
            os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{SF}/lineitem.parquet')")
    con.execute(f"COPY ({lineitem}) TO '{folder}/lineitem.parquet' ({options})")
    return str(folder)


def check(spark, name, sf):
    assert_same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], sf)
    return catalog.QUERIES[name](spark, sf).collect()


def test_no_distance_without_a_source(spark, tmp_path):
    assert check(spark, "distance_transform", made(tmp_path, "SELECT * REPLACE (l_quantity + 30 AS l_quantity) FROM lineitem")) == []


def test_one_source_leaves_the_far_cells_without_a_distance(spark, tmp_path):
    one = "l_partkey % 40 = 0 AND l_suppkey % 40 = 0"
    rows = check(spark, "distance_transform", made(tmp_path, f"SELECT * REPLACE (CASE WHEN {one} THEN 1 ELSE l_quantity + 30 END AS l_quantity) FROM lineitem"))
    assert len(rows) == 400 and 0 < sum(r.distance is not None for r in rows) < 60


def test_no_discriminant_without_both_classes(spark, tmp_path):
    assert check(spark, "linear_discriminant", made(tmp_path, "SELECT * REPLACE (l_quantity + 30 AS l_quantity) FROM lineitem")) == []


def test_discriminant_of_one_cell_a_class_is_undefined(spark, tmp_path):
    two = "SELECT * REPLACE (l_partkey % 2 AS l_partkey, 0::BIGINT AS l_suppkey, 1.0::DOUBLE + 49 * (l_partkey % 2) AS l_quantity) FROM lineitem"
    assert list(map(tuple, check(spark, "linear_discriminant", made(tmp_path, two)))) == [(None, None)]


@pytest.mark.parametrize("name", ["reference_endpoints", "reference_intervals"])
def test_scores_at_the_threshold_do_not_depend_on_tasks(spark, tmp_path, name):
    """14 of 400 cells have a mean of exactly 0.04, which rounds up or down with the order of addition; one thread of the SQL adds row after row."""
    sf = made(tmp_path, "SELECT lineitem.* FROM range(20), lineitem", "ROW_GROUP_SIZE 2048")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{sf}/lineitem.parquet')")
    want = con.sql(catalog.ORACLE_SQL[name])
    rows = sorted(repr(tuple(map(_plain, r))) for r in want.fetchall())
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("20k", "128m"):
            spark.conf.set(key, size)
            df = catalog.QUERIES[name](spark, sf)
            assert sorted(repr(tuple(map(_plain, r))) for r in df.select(*want.columns).collect()) == rows
    finally:
        spark.conf.set(key, before)


def test_mean_in_order_adds_one_value_after_the_other(spark):
    df = spark.createDataFrame([("a", 3, -1e16), ("a", 1, 1.0), ("a", 4, 1.0), ("a", 2, 1e16), ("a", 5, None), ("b", 1, 2.0)], "k string, at int, v double").repartition(5)
    assert {r.k: r.mean for r in mean_in_order(df, "v", ["k"], ["at"]).collect()} == {"a": 0.25, "b": 2.0}


def test_mean_in_order_adds_up_pieces_before_their_sums(spark):
    df = spark.createDataFrame([("a", 0, 1, 1e16), ("a", 1, 2, 1.0), ("a", 1, 3, 1.0), ("a", 2, 4, -1e16), ("a", 2, 5, None), ("b", 1, 2, 2.0)], "k string, p int, at int, v double").repartition(5)
    assert {r.k: r.mean for r in mean_in_order(df, "v", ["k"], ["at"], piece="p").collect()} == {"a": 0.5, "b": 2.0}


def test_file_pieces_go_on_over_files(spark, tmp_path):
    con = duckdb.connect()
    for k, n in enumerate((5, 0, 7)):
        con.execute(f"COPY (SELECT {100 * k} + range AS v FROM range({n})) TO '{tmp_path}/{k}.parquet'")
    pieces = lambda *how: [r._piece for r in file_pieces(spark.read.parquet(str(tmp_path)), *how).orderBy("v").collect()]
    assert pieces(3, 1) == [0] * 4 + [1] * 4 + [2] * 4
    assert pieces(5, 1) == [0] * 3 + [1] * 3 + [2] * 3 + [3] * 3
    assert pieces(3, 10) == [0] * 10 + [1] * 2


@pytest.mark.parametrize("name", ["reference_endpoints", "reference_intervals"])
def test_scores_at_the_threshold_are_added_up_by_shares(spark, tmp_path, name):
    """A table of more rows than a share: the SQL over sums of each eighth of the rows, added up in order, as eight threads do."""
    copies = ", ".join(f"({k})" for k in range(160))
    sf = made(tmp_path, f"SELECT lineitem.* FROM (VALUES {copies}) v(k), lineitem ORDER BY k", "ROW_GROUP_SIZE 122880")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE TABLE n AS SELECT *, row_number() OVER () - 1 AS pos FROM read_parquet('{sf}/lineitem.parquet')")
    size = max(-(-con.sql("SELECT count(*) FROM n").fetchall()[0][0] // 8), 1 << 19)
    shares = con.execute("SELECT l_partkey % 40, l_suppkey % 40, pos // ?, sum(l_tax), count(l_tax) FROM n GROUP BY ALL ORDER BY 3", [size]).fetchall()
    total, rows = {}, {}
    for r, c, _, s, n in shares:
        total[r, c], rows[r, c] = total.get((r, c), 0.0) + s, rows.get((r, c), 0) + n
    con.execute("CREATE TABLE settled (r BIGINT, c BIGINT, settled DOUBLE)")
    con.executemany("INSERT INTO settled VALUES (?, ?, ?)", [(*k, total[k] / rows[k] * 10) for k in total])
    con.execute("CREATE VIEW lineitem AS SELECT * FROM n JOIN settled ON r = l_partkey % 40 AND c = l_suppkey % 40")
    sql, mean = catalog.ORACLE_SQL[name], "avg(l_tax) * 10 AS score"
    assert sql.count(mean) == 1
    want = con.sql(sql.replace(mean, "any_value(settled) AS score").replace("l_partkey % 40 AS r, l_suppkey % 40 AS c", "r, c").replace("GROUP BY l_partkey % 40, l_suppkey % 40", "GROUP BY r, c"))
    assert sorted(repr(tuple(map(_plain, r))) for r in catalog.QUERIES[name](spark, sf).select(*want.columns).collect()) == sorted(repr(tuple(map(_plain, r))) for r in want.fetchall())
