"""Where queries and their SQL are registered, and the fixture tables that both engines derive from the driver's tables.

A fixture is one SQL text for both engines, so a difference between a query and its oracle is a difference of the operator.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_LATTICE = "l_partkey % 40 AS r, l_suppkey % 40 AS c"

FIXTURES = {
    # One row per cell and acquisition: six bands, scene class, window.
    "stack": f"""SELECT {_LATTICE}, CAST(l_shipdate AS DATE) AS day, l_orderkey AS scene, l_linenumber AS line, l_discount AS b02, l_tax AS b03, l_quantity / 50 AS b04,
        l_extendedprice / 100000 AS b08, (l_quantity + l_linenumber) / 60 AS b11, (l_extendedprice / 100000 + l_tax) / 2 AS b12,
        CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 4 WHEN l_returnflag = 'A' THEN 5 WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 8 WHEN l_returnflag = 'N' THEN 6 WHEN l_linestatus = 'F' THEN 3 ELSE 7 END AS scl,
        CASE WHEN year(l_shipdate) <= 1997 THEN 'pre' WHEN year(l_shipdate) <= 1999 THEN 'event' ELSE 'trace' END AS win FROM {{lineitem}}""",
    # One row per cell: height, ground class, two candidate scores.
    "cells": f"""SELECT {_LATTICE}, median(l_quantity) AS dem, median(l_extendedprice) / 1000 AS hand, CAST(count(*) AS INT) AS n, CAST(min(l_linenumber) AS INT) AS ground, CAST(max(l_orderkey) % 7 AS INT) AS wc,
        avg(l_tax) * 10 AS score FROM {{lineitem}} GROUP BY l_partkey % 40, l_suppkey % 40""",
    # Radar samples: scene, orbit, linear power; a power of 0 is a dropout.
    "sar": f"""SELECT {_LATTICE}, CAST(l_shipdate AS DATE) AS day, l_linenumber % 3 AS orbit, l_orderkey AS scene, CASE WHEN l_tax = 0 THEN 0.0 ELSE l_extendedprice / 100000 END AS vv, l_quantity / 500 AS vh,
        CASE WHEN year(l_shipdate) <= 1997 THEN 'pre' ELSE 'event' END AS win FROM {{lineitem}}""",
    # Raw observations of level nodes, and the daily medians of nodes.
    "obs": """SELECT user_id AS node, CAST(ts AS DATE) AS day, value AS h, event_type AS river FROM {events}""",
    "node_day": """SELECT user_id AS node, CAST(ts AS DATE) AS day, median(value) AS h FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "nodes": """SELECT user_id AS node, CAST((user_id * 37 % 101) * 50 AS DOUBLE) AS x, CAST((user_id * 53 % 97) * 50 AS DOUBLE) AS y, min(event_type) AS river, CAST(count(*) AS INT) AS n FROM {events} GROUP BY user_id""",
    # Cell-day states of a short window.
    "cell_day": f"""SELECT {_LATTICE}, CAST(l_shipdate AS DATE) AS day, max(l_quantity) AS q, max(l_tax) AS t, min(l_discount) AS d FROM {{lineitem}} GROUP BY l_partkey % 40, l_suppkey % 40, CAST(l_shipdate AS DATE)""",
    # Labelled scores with blocks.
    "scored": """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, CAST(floor(o_totalprice / 5000) AS INT) / 100 AS s, o_custkey % 40 AS block, o_orderpriority AS stratum, o_orderkey % 3 AS arm FROM {orders}""",
    # Ensemble draws: draw 0 is nominal.
    "draws": """SELECT l_linenumber * 7 + l_suppkey % 7 AS draw, l_partkey % 5 AS region, year(l_shipdate) AS date, sum(l_quantity) AS area, sum(l_extendedprice) AS volume FROM {lineitem} GROUP BY l_linenumber * 7 + l_suppkey % 7, l_partkey % 5, year(l_shipdate)""",
}

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FIXTURES[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def with_fixtures(sql: str) -> str:
    """The oracle's text with every fixture that it names as a leading WITH."""
    used = [f"{k} AS ({v.format(**{t: t for t in _TABLES})})" for k, v in FIXTURES.items() if re.search(rf"\b(?:FROM|JOIN)\s+{k}\b|,\s*{k}\b", sql)]
    body = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql) if re.match(r"\s*WITH\b", sql) else None
    recursive = "RECURSIVE " if re.match(r"\s*WITH\s+RECURSIVE", sql) else ""
    if not used:
        return sql
    return f"WITH {recursive}{', '.join(used)}{', ' + body if body is not None else ' ' + sql}"


def query(name: str, sql: str | None = None, on: str | None = None):
    """Register fn(frame of the fixture `on`) or, with no fixture, fn(spark, sf_dir)."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(fixture(spark, sf_dir, on)) if on else fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = with_fixtures(sql)
        return fn

    return add
