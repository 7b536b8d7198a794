"""Quality gates: each is an aggregate of one number; a number that could not be had is INCOMPLETE, never a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gate_table(spark: SparkSession, gates: dict[str, tuple[DataFrame | None, float]]) -> DataFrame:
    """One row per gate: gate, measured, expected, status."""
    rows = []
    for name, (measured, expected) in gates.items():
        m = measured.toDF("measured") if measured is not None else spark.range(1).select(F.lit(None).cast("double").alias("measured"))
        status = F.when(F.col("measured").isNull(), "INCOMPLETE").when(F.col("measured") == expected, "PASS").otherwise("FAIL")
        rows.append(m.select(F.lit(name).alias("gate"), "measured", F.lit(float(expected)).alias("expected"), status.alias("status")))
    return reduce(DataFrame.union, rows)


def bounded_gates(measures: DataFrame, most: dict[str, float | None]) -> DataFrame:
    """The one row of measures as a table of gates: gate, measured, most, status. A gate without a bound is REPORTED, not judged."""
    status = lambda m, b: F.when(m.isNull(), "INCOMPLETE").otherwise(F.lit("REPORTED") if b is None else F.when(m <= b, "PASS").otherwise("FAIL"))
    one = lambda g, b: F.struct(F.lit(g).alias("gate"), F.col(g).cast("double").alias("measured"), F.lit(b).cast("double").alias("most"), status(F.col(g), b).alias("status"))
    return measures.select(F.explode(F.array(*(one(g, b) for g, b in most.items()))).alias("_g")).select("_g.*")


def require(table: DataFrame) -> None:
    """Raise if any gate did not pass."""
    bad = table.filter("status <> 'PASS'").select("gate", "status").collect()  # a row per gate
    if bad:
        raise AssertionError(", ".join(f"{r.gate}: {r.status}" for r in bad))


def overlap(df: DataFrame, keys, member: str, value: str, a, b) -> DataFrame:
    """Shared cells of two members, and how many differ."""
    x, y = (df.filter(F.col(member) == m).select(*keys, F.col(value).alias(n)) for m, n in ((a, "_a"), (b, "_b")))
    return x.join(y, list(keys)).agg(F.count("*").alias("n_shared"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_mismatch"))


def refuse_columns(df: DataFrame, forbidden: str) -> DataFrame:
    """df, unless a column name or a source path matches the pattern."""
    import re

    bad = [c for c in df.columns if re.search(forbidden, c)] + [f for f in df.inputFiles() if re.search(forbidden, f)]
    if bad:
        raise ValueError(f"forbidden inputs: {bad[:5]}")
    return df


def checksum(df: DataFrame) -> DataFrame:
    """Rows and an order-free checksum of all columns."""
    return df.agg(F.count("*").alias("n"), F.expr(f"bit_xor(xxhash64({', '.join(f'`{c}`' for c in sorted(df.columns))}))").alias("checksum"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with their side."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).union(b.exceptAll(a).withColumn("side", F.lit("b")))


def kept_features(names: list[str], exclude: str) -> list[str]:
    """Feature names that the pattern does not match."""
    import re

    return [n for n in names if not re.search(exclude, n)]


def within(df: DataFrame, measured: str, stored: str, tolerance: float) -> DataFrame:
    """df with holds: measured and stored differ by at most the tolerance; a missing number never holds."""
    return df.withColumn("holds", F.coalesce(F.abs(F.col(measured) - F.col(stored)) <= tolerance + 1e-9, F.lit(False)))


def digests(df: DataFrame, keys, line, order: str) -> DataFrame:
    """Rows and sha256 of the ordered lines of each part; a part is a small publication table."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(rows, lambda x: x["l"]), "\n"), 256).alias("digest"))


def frozen(now: DataFrame, then: DataFrame, keys) -> DataFrame:
    """Every part of now with frozen: its digest is the recorded one."""
    old = then.select(*keys, F.col("digest").alias("_then"))
    return now.join(old, list(keys), "left").withColumn("frozen", F.col("digest").eqNullSafe(F.col("_then"))).drop("_then")
