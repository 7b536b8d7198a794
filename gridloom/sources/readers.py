"""Sources: tables with fixed schemas, catalogues from file names, packed masks, ESRI grids, GeoJSON, XML metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.schema import number_or_null

#: Fixed value: the published name of a level-2A product: mission, level, sensing time, baseline, orbit, tile, product time.
PRODUCT = r"^(S2[ABC])_MSIL2A_(\d{8})T(\d{6})_N(\d{4})_R(\d{3})_(T\w{5})_(\d{8}T\d{6})"

CELL_SCHEMA = "grid_id string, day date, r int, c int, scl int"


def cell_table(spark: SparkSession, path: str, bands: list[str], rows: tuple[int, int] | None = None, sentinel: int = -32768, scale: float = 10000.0) -> DataFrame:
    """A scaled-integer cell table as doubles; the row window and the wanted bands reach the Parquet scan."""
    df = spark.read.parquet(path)
    if rows:
        df = df.filter(F.col("r").between(*rows))
    keep = [c for c in df.columns if c in ("grid_id", "day", "r", "c", "scl", "valid")]
    return df.select(*keep, *(F.when(F.col(b) != sentinel, F.col(b) / scale).alias(b) for b in bands))


def product_names(name: Column) -> dict[str, Column]:
    """Fields of a product's file name; NULL where it is not one."""
    part = lambda k: F.nullif(F.regexp_extract(name, PRODUCT, k), F.lit(""))
    return {"mission": part(1), "day": F.to_date(part(2), "yyyyMMdd"), "time": part(3), "baseline": part(4).cast("int"), "tile": part(6)}


def catalogue(products: DataFrame, stacks: DataFrame, day: str = "day") -> DataFrame:
    """One lineage per date: the archive of products where there is one, else the legacy stack."""
    a = products.groupBy(day).agg(F.count("*").alias("n_products"))
    b = stacks.groupBy(day).agg(F.count("*").alias("n_stacks"))
    return a.join(b, day, "full").select(day, F.coalesce("n_products", F.lit(0)).alias("n_products"), F.coalesce("n_stacks", F.lit(0)).alias("n_stacks"), F.when(F.col("n_products") > 0, "product").otherwise("stack").alias("lineage"))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and a fixed schema; numbers that are not numbers become NULL."""
    df = spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE")
    return df.withColumns({n: number_or_null(F.col(n)) for n, t in df.dtypes if t in ("double", "float")})


def packed_masks(df: DataFrame, bits: str, key: list[str], width: int) -> DataFrame:
    """Cells of masks stored as packed bits, first bit highest: binary column to key, r, c, value."""
    at = F.explode(F.sequence(F.lit(0), F.length(bits) * 8 - 1))
    x = df.withColumn("_i", at)
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(F.col("_i") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    value = F.expr("(_b >> (7 - _i % 8)) & 1") == 1
    x = x.withColumn("_b", byte).withColumn("value", value)
    return x.select(*key, F.floor(F.col("_i") / width).cast("int").alias("r"), (F.col("_i") % width).cast("int").alias("c"), "value")


def esri_grid(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    """An ESRI ASCII grid as cells (r, c, z) and its header. The sentinel becomes NULL; one file is one array of lines."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\r?\n").alias("l"))
    head = {k.lower(): float(v) for k, v in (x.split() for x in lines.select(F.explode(F.slice("l", 1, 6))).toPandas().iloc[:, 0])}  # six lines
    rows = lines.select(F.posexplode(F.slice("l", 7, F.size("l"))).alias("r", "line"))
    z = rows.select("r", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("c", "z")).withColumn("z", F.col("z").cast("double"))
    return z.withColumn("z", number_or_null(F.col("z"), head["nodata_value"])), head


def rings(spark: SparkSession, path: str) -> list[list[tuple[float, float]]]:
    """Outer rings of the polygons of all small GeoJSON documents under a path, for point-in-polygon expressions."""
    import json

    docs = [json.loads(r[0]) for r in spark.read.text(path, wholetext=True).collect() if r[0].strip()]  # shapes that go into an expression
    shapes = [f["geometry"] for doc in docs for f in doc.get("features", [])]
    return [[tuple(p[:2]) for p in ring[:-1]] for s in shapes for ring in ([s["coordinates"][0]] if s["type"] == "Polygon" else [q[0] for q in s["coordinates"]])]


def yearbook(wide: DataFrame, keys: list[str], year: str = "year", day: str = "d") -> DataFrame:
    """Pages of a gauge yearbook (a row per day of the month, columns 1 to 12) as daily rows: keys, day, h. Days that a month lacks have no value."""
    months = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.col(f"`{m}`").cast("double").alias("h")) for m in range(1, 13))))
    x = wide.select(*keys, year, day, months.alias("v")).filter("v.h IS NOT NULL")
    return x.select(*keys, F.expr(f"make_date(`{year}`, v.m, `{day}`)").alias("day"), F.col("v.h").alias("h"))


def scene_metadata(xml: Column) -> dict[str, Column]:
    """Fields of a scene's XML description: quantification, baseline, sensing day and the offsets by band."""
    at = lambda tag: F.regexp_extract(xml, rf"<{tag}[^>]*>([^<]*)</{tag}>", 1)
    ids = F.regexp_extract_all(xml, F.lit(r'<BOA_ADD_OFFSET band_id="(\d+)">'), F.lit(1))
    values = F.transform(F.regexp_extract_all(xml, F.lit(r"<BOA_ADD_OFFSET[^>]*>([^<]*)</BOA_ADD_OFFSET>"), F.lit(1)), lambda v: v.cast("double"))
    return {"quantification": at("BOA_QUANTIFICATION_VALUE").cast("double"), "baseline": at("PROCESSING_BASELINE"), "day": F.to_date(F.substring(at("DATATAKE_SENSING_START"), 1, 10)), "offsets": F.map_from_arrays(ids, values)}


def require_column(df: DataFrame, name: str) -> DataFrame:
    """df, refused if it lacks a column that the meaning of the others depends on."""
    if name not in df.columns:
        raise ValueError(f"the table has no {name} column")
    return df
