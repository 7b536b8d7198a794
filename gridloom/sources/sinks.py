"""Sinks: tiled cell tables, published only after they were read back; CSV tables with checksums; upserts and ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.dedup import best_per_key
from gridloom.operators.gates import checksum
from gridloom.operators.joins import upsert
from gridloom.schema import INDEX_SCALE


def write_cells(df: DataFrame, path: str, tile: int = 512, rows_per_file: int = 5_000_000) -> None:
    """Cells by grid and day, range-partitioned by tile, so that a window reads few row groups."""
    parts = [c for c in ("grid_id", "day") if c in df.columns]
    x = df.withColumns({"_tr": F.floor(F.col("r") / tile), "_tc": F.floor(F.col("c") / tile)}).repartitionByRange(*parts, "_tr", "_tc").sortWithinPartitions(*parts, "_tr", "_tc", "r", "c").drop("_tr", "_tc")
    x.write.option("maxRecordsPerFile", rows_per_file).partitionBy(*parts).mode("overwrite").parquet(path)


def publish(df: DataFrame, path: str) -> DataFrame:
    """Write beside the target, read back, compare counts and checksums, then move the checked copy into the target's place.

    The old table is moved aside first and deleted last, so at every moment one whole copy exists under the target's name or beside it.
    """
    spark = df.sparkSession
    part, old = (f"{path.rstrip('/')}.{uuid.uuid4().hex}.{x}" for x in ("part", "old"))
    df.write.parquet(part)
    back = spark.read.schema(df.schema).parquet(part)
    if checksum(df).first() != checksum(back).first():
        raise IOError(f"what was read back differs from what was written to {path}")
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    store = as_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = store.exists(as_path(path))
    if had and not store.rename(as_path(path), as_path(old)):
        raise IOError(f"{path} could not be moved aside")
    if not store.rename(as_path(part), as_path(path)):
        if had:
            store.rename(as_path(old), as_path(path))
        raise IOError(f"the checked copy could not be moved to {path}")
    if had:
        store.delete(as_path(old), True)
    return spark.read.schema(df.schema).parquet(path)


def ascii_grid(cells: DataFrame, path: str, cell: float, nodata: float = -9999.0) -> None:
    """A whole lattice (r, c, z) as one ESRI ASCII grid: a line per row, in one file, since the format is one."""
    size = cells.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    every = F.sequence(F.lit(0).cast("long"), F.lit(size.c).cast("long"))
    rows = cells.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct(F.col("c").cast("long"), F.coalesce("z", F.lit(nodata))))).alias("z"))
    lines = cells.sparkSession.range(size.r + 1).withColumnRenamed("id", "r").join(rows, "r", "left")
    line = F.array_join(F.transform(every, lambda c: F.coalesce(F.try_element_at("z", c), F.lit(nodata)).cast("string")), " ")
    head = [f"ncols {size.c + 1}", f"nrows {size.r + 1}", "xllcorner 0", "yllcorner 0", f"cellsize {cell}", f"NODATA_value {nodata}"]
    top = cells.sparkSession.createDataFrame([(k - len(head), x) for k, x in enumerate(head)], "r long, value string")
    top.union(lines.select("r", line)).coalesce(1).sortWithinPartitions("r").select("value").write.mode("overwrite").text(path)


def ledger(old: DataFrame, new: DataFrame, keys, version: str) -> DataFrame:
    """Old and new rows, the last version of each key."""
    return best_per_key(old.unionByName(new), keys, [F.col(version).desc()])


def replace_rows(path: str, new: DataFrame, keys) -> DataFrame:
    """The table at path with rows of new keys replaced."""
    spark = new.sparkSession
    return publish(upsert(spark.read.parquet(path), new, keys), path)


def draws_csv(df: DataFrame, path: str, seed: int) -> DataFrame:
    """A gzip CSV and its register: rows, checksum, seed."""
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
    return checksum(df).withColumns({"path": F.lit(path), "seed": F.lit(seed)})


def manifest(df: DataFrame, tags: dict[str, str]) -> DataFrame:
    """One row: a JSON text of the tags with the rows and checksum of what they describe."""
    fields = [F.lit(v).alias(k) for k, v in sorted(tags.items())]
    return checksum(df).select(F.to_json(F.struct("n", "checksum", *fields)).alias("manifest"))


def packed_bits(df: DataFrame, keys, value: Column, width: int) -> DataFrame:
    """Masks as packed bits, first bit highest: the reverse of the reader. One binary per mask."""
    at = F.col("r") * width + F.col("c")
    bit = F.when(value, F.pow(F.lit(2.0), 7 - F.col("_at") % 8)).otherwise(0.0)
    byte = df.withColumn("_at", at).groupBy(*keys, F.floor(F.col("_at") / 8).alias("_b")).agg(F.sum(bit).cast("int").alias("_v"))
    # Bytes without a row are zero bytes; they keep the place of those after them.
    every = byte.groupBy(*keys).agg(F.max("_b").alias("_m")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), "_m")).alias("_b"))
    byte = every.join(byte, [*keys, "_b"], "left").withColumn("_v", F.coalesce("_v", F.lit(0)))
    rows = F.array_sort(F.collect_list(F.struct("_b", "_v")))
    return byte.groupBy(*keys).agg(F.unhex(F.array_join(F.transform(rows, lambda x: F.lpad(F.hex(x["_v"]), 2, "0")), "")).alias("bits"))


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Doubles as scaled 16-bit integers for storage."""
    from gridloom.operators.indices import to_scaled

    return df.withColumns({c: to_scaled(F.col(c), scale=INDEX_SCALE).cast("smallint") for c in columns})
