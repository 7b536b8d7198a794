"""Queries of folds, splits, samples, random fields, worlds and time stepping."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import joins as J
from gridloom.operators import sampling as S
from gridloom.operators import simulation as X
from gridloom.operators.evidence import level_tables
from gridloom.operators.timeseries import fill
from gridloom.plans.cells import rounded
from gridloom.plans.registry import fixture, query
from gridloom.plans.series import _FILL, spine


def _lcg(k: str) -> str:
    return f"((((({k}) * 1103515245 + 12345) % 2147483648) * 1103515245 + 12345) % 2147483648 // 1024)"


def _key(*cols: str, seed: int = 1) -> str:
    h = str(seed)
    for c in cols:
        h = _lcg(f"({h} * 31 + {c}) % 2147483648")
    return h


def blocks_of(df):
    return df.groupBy("block").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))


@query("greedy_folds", None, on="scored")
def greedy_folds(df):
    """Deterministic balanced folds; sequential, so tests hold it against a plain loop."""
    b = blocks_of(df)
    return S.greedy_folds(b, 5).join(b, "block").groupBy("fold").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.count("*").alias("n_blocks"))


@query("accepted_split", f"WITH b AS (SELECT block, sum(y) AS pos, count(*) AS n FROM scored GROUP BY block), e AS (SELECT draw, b.*, row_number() OVER (PARTITION BY draw ORDER BY {_key('draw', 'block')}, block) <= ceil(count(*) OVER (PARTITION BY draw) * 0.3) AS test FROM b, (SELECT unnest(range(0, 50)) AS draw)), k AS (SELECT draw FROM e GROUP BY draw HAVING abs(sum(n) FILTER (test) / sum(n) - 0.3) <= 0.02 AND abs(sum(pos) FILTER (test) / sum(pos) - 0.3) <= 0.02) SELECT draw, block, test FROM e WHERE draw = (SELECT min(draw) FROM k)", on="scored")
def accepted_split(df):
    return S.accepted_split(blocks_of(df), 50, 0.3, 0.02)


@query("inner_folds", f"SELECT block, (row_number() OVER (ORDER BY {_key('block')}, block) - 1) % 4 AS fold FROM (SELECT DISTINCT block FROM scored)", on="scored")
def inner_folds(df):
    return S.inner_folds(df, "block", 4)


@query("stratified_sample", f"SELECT id, stratum FROM scored QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY {_key('id')}, id) <= 20", on="scored")
def stratified_sample(df):
    return S.stratified(df, ["stratum"], 20, S.key(F.col("id")), "id").select("id", "stratum")


@query("uniform_sample", f"SELECT id FROM (SELECT id FROM scored ORDER BY {_key('id', seed=3)}, id LIMIT 100)", on="scored")
def uniform_sample(df):
    return S.uniform(df, 100, S.key(F.col("id"), seed=3), "id").select("id")


@query("weighted_oversample", f"SELECT id, y FROM (SELECT id, y FROM scored ORDER BY round(ln(CASE WHEN y = 1 THEN 4 ELSE 1 END) - ln(-ln((({_key('id', seed=5)}) % 1048576 + 0.5) / 1048576)), 9) DESC, id LIMIT 200)", on="scored")
def weighted_oversample(df):
    weight = F.when(F.col("y") == 1, 4).otherwise(1)
    return S.oversample(df, 200, weight, S.unit(S.key(F.col("id"), seed=5)), "id").select("id", "y")


@query("pass_hold_out", "WITH p AS (SELECT orbit, row_number() OVER (ORDER BY orbit) - 1 AS k FROM (SELECT DISTINCT orbit FROM sar)) SELECT 'leave_one_out' AS scheme, orbit, k AS fold FROM p UNION ALL SELECT 'k_fold', orbit, k % 2 FROM p", on="sar")
def pass_hold_out(df):
    return S.hold_out(df, "orbit", 2)


@query("latin_hypercube", f"WITH i AS (SELECT unnest(range(0, 200)) AS id) SELECT id, round((row_number() OVER (ORDER BY {_key('id', seed=1)}, id) - 1 + {_key('id', seed=14)} % 1024 / 1024) / 200, 9) AS u0, round(exp(ln(0.03) + (row_number() OVER (ORDER BY {_key('id', seed=102)}, id) - 1 + {_key('id', seed=591)} % 1024 / 1024) / 200 * (ln(0.15) - ln(0.03))), 9) AS roughness FROM i")
def latin_hypercube(spark, sf):
    x = S.latin_hypercube(spark.range(200), 200, 2)
    return rounded(x.select("id", "u0", S.log_uniform(F.col("u1"), 0.03, 0.15).alias("roughness")), "u0", "roughness", digits=9)


@query("normal_emulator", "WITH h AS (SELECT floor(dem)::INT AS b, count(*) AS n FROM cells GROUP BY ALL), l AS (SELECT unnest([18.0, 22.0, 26.0]::DOUBLE[]) AS level), z AS (SELECT level, n, (level - b - 0.5) / 1.5 AS x FROM h, l), t AS (SELECT *, 1 / (1 + 0.2316419 * abs(x)) AS t FROM z), p AS (SELECT level, n, x, exp(-x * x / 2) / 2.5066282746310002 * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))) AS u FROM t) SELECT level, round(sum(n * CASE WHEN x >= 0 THEN 1 - u ELSE u END), 6) AS expected FROM p GROUP BY level", on="cells")
def normal_emulator(df):
    """Expected cells under a level with normal terrain error, from a histogram of heights."""
    h = df.groupBy(F.floor("dem").cast("int").alias("b")).agg(F.count("*").alias("n")).withColumn("level", F.explode(F.array(F.lit(18.0), F.lit(22.0), F.lit(26.0))))
    p = S.normal_cdf((F.col("level") - F.col("b") - 0.5) / 1.5)
    return rounded(h.groupBy("level").agg(F.sum(F.col("n") * p).alias("expected")), "expected")


@query("covariance_models", "SELECT h, round(exp(-h / 500), 9) AS exponential, round(exp(-(h / 500) * (h / 500)), 9) AS gaussian, round(CASE WHEN h < 500 THEN 1 - 1.5 * h / 500 + 0.5 * pow(h / 500, 3) ELSE 0 END, 9) AS spherical FROM (SELECT unnest(range(0, 2000, 100))::DOUBLE AS h)")
def covariance_models(spark, sf):
    h = F.col("h")
    x = spark.range(0, 2000, 100).select(F.col("id").cast("double").alias("h")).select("h", *(X.covariance(h, 500.0, m).alias(m) for m in X.CORRELATION))
    return rounded(x, *X.CORRELATION, digits=9)


def _normal(*cols: str, seed: int) -> str:
    u = [f"(({_key(*cols, seed=s)}) % 1048576 + 0.5) / 1048576" for s in (seed, seed + 1)]
    return f"sqrt(-2 * ln({u[0]})) * cos(2 * pi() * {u[1]})"


_HEIGHTS = f"""WITH {_FILL}, nd AS (SELECT node, (day - DATE '2024-01-01')::BIGINT AS t, kind, gap, (day - DATE '2024-01-01')::BIGINT - gap AS run FROM f),
 dev AS (SELECT draw, CASE WHEN draw = 0 THEN 0 ELSE 0.05 * {_normal("draw", seed=1)} + CASE WHEN kind = 0 THEN 0.1 * {_normal("draw", "node", "t", seed=3)} ELSE 0 END
  + CASE WHEN kind IN (1, 2) THEN CASE WHEN gap <= 1 THEN 0.1 ELSE 0.2 END * {_normal("draw", "node", "run", seed=5)} ELSE 0 END END AS d FROM nd, (SELECT unnest(range(0, 20)) AS draw))
 SELECT draw, count(*) AS n, round(avg(d), 6) AS shift, round(stddev_pop(d), 6) AS spread FROM dev GROUP BY draw"""


def _node_days(spark, sf):
    """Filled node heights with the day's number and the gap run that a filled day belongs to."""
    f = fill(spine(fixture(spark, sf, "node_day")), "node", "day", "h")
    day = F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long")
    return f.select("node", day.alias("day_no"), F.col("filled").alias("h"), "kind", "gap", (day - F.col("gap")).alias("run"))


@query("perturbed_heights", _HEIGHTS)
def perturbed_heights(spark, sf):
    """Heights of 20 draws, by their mean and spread around the undisturbed ones."""
    x = X.perturbed_heights(_node_days(spark, sf), 20).withColumn("d", F.col("h_draw") - F.col("h"))
    return x.groupBy("draw").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("shift"), F.round(F.stddev_pop("d"), 6).alias("spread"))


@query("correlated_fields", None)
def correlated_fields(spark, sf):
    """Statistics of four nested fields: unit variance and the models' correlation at a lag of five cells."""
    f = X.correlated_fields(spark.range(4).withColumnRenamed("id", "draw"), 64, 64, 20.0, [(0.7, 100.0, "exponential"), (0.3, 300.0, "spherical")])
    lag = f.join(f.select("draw", "r", (F.col("c") - 5).alias("c"), F.col("f").alias("g")), ["draw", "r", "c"])
    return lag.groupBy("draw").agg(F.round(F.stddev_pop("f"), 6).alias("sd"), F.round(F.corr("f", "g"), 6).alias("rho"))


def world_inputs(spark, sf):
    """The whole lattice with its nodes: ground, disturbed node days about it, the five nearest nodes of each cell."""
    cells = fixture(spark, sf, "cells").select("r", "c", "dem", F.lit(0.5).alias("sigma"), ((F.col("c") == 0) & (F.col("dem") < 26)).alias("seed"), (F.col("r") >= 20).cast("int").alias("zone"))
    heights = _node_days(spark, sf).withColumn("h", 22 + F.col("h") / 40)
    p = cells.select("r", "c", (F.col("c") * 100.0).alias("x"), (F.col("r") * 100.0).alias("y"))
    return cells, heights, J.nearest(p, fixture(spark, sf, "nodes"), 5, 1500.0, ["r", "c"], "node").select("r", "c", "node")


@query("ensemble_worlds", None)
def ensemble_worlds(spark, sf):
    """Four worlds over the whole lattice and all its days; tests hold them against flood fills cell by cell."""
    w = X.worlds(*world_inputs(spark, sf), 4, 10, cell_m=100.0, structures=[(1.0, 500.0, "exponential")], batch=2)
    return rounded(w, "potential_km2", "baseline_km2", "new_km2", "potential_hm3", "new_hm3")


def _river(spark, sf, base: float):
    """Daily mean level of all nodes, in seconds from the first day."""
    n = _node_days(spark, sf).groupBy("day_no").agg(F.avg("h").alias("h"))
    return n.select((F.col("day_no") * 86400.0).alias("t"), (base + F.col("h") / 20).alias("level"))


def _level_tables(spark, sf):
    """Wet area by level of the four bands of ten rows of the lattice."""
    t = level_tables(fixture(spark, sf, "cells"), 10, [float(x) for x in range(12, 42, 3)], 10_000.0)
    return t.groupBy(F.col("block_r").cast("long").alias("cell"), "level").agg(F.sum("area").cast("double").alias("area"))


@query("storage_cells", None)
def storage_cells(spark, sf):
    """Four bands of the lattice filled from the river over two days, for priors of a Latin hypercube."""
    u = S.latin_hypercube(spark.range(6), 6, 3)
    runs = u.select(F.col("id").alias("run"), S.log_uniform(F.col("u0"), 0.03, 0.15).alias("roughness"), S.log_uniform(F.col("u1"), 0.3, 3.0).alias("width_factor"), (S.log_uniform(F.col("u2"), 0.001, 0.1) / 86400).alias("loss"))
    links = spark.createDataFrame([(-1, 0, 24.0, 50.0, 400.0), (0, 1, 24.5, 40.0, 900.0), (0, 2, 24.5, 40.0, 900.0), (1, 3, 25.0, 30.0, 900.0), (2, 3, 25.0, 30.0, 900.0)], "a long, b long, bed double, width double, length double")
    x = X.storage_cells(runs, _level_tables(spark, sf), links, _river(spark, sf, 24.0), 2 * 86400.0)
    return rounded(x, "level", "area", "volume", "let_in", "lost", digits=4)


@query("weir_reservoir", None)
def weir_reservoir(spark, sf):
    """One basin behind a crest through the whole hydrograph, as a weir and as a channel."""
    table = _level_tables(spark, sf).groupBy("level").agg(F.sum("area").alias("area"))
    u = S.latin_hypercube(spark.range(4), 4, 3)
    runs = u.select(F.col("id").alias("run"), F.when(F.col("id") % 2 == 0, "weir").otherwise("friction").alias("form"), (24.5 + F.col("u0")).alias("crest"), F.lit(30.0).alias("width"), (1.4 + 0.3 * F.col("u1")).alias("coefficient"),
                    S.log_uniform(F.col("u2"), 0.03, 0.15).alias("roughness"), F.lit(500.0).alias("length"), F.lit(-0.5).alias("floor"), F.lit(0.005 / 86400).alias("loss"))
    x = X.reservoir(runs, table, _river(spark, sf, 24.0))
    return rounded(x.groupBy("run").agg(F.max("level").alias("highest"), F.max_by("level", "t").alias("last"), F.max("area").alias("largest"), F.sum(F.greatest(F.col("flow"), F.lit(0.0))).alias("inflow")), "highest", "last", "largest", "inflow", digits=4)


@query("saddle_level", "WITH RECURSIVE lv AS (SELECT DISTINCT dem AS level FROM cells), b AS (SELECT r, c, dem, level FROM cells, lv WHERE dem <= level), reach AS (SELECT level, r, c FROM b WHERE c = 0 UNION SELECT b.level, b.r, b.c FROM reach a JOIN b ON a.level = b.level AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1) SELECT 0::BIGINT AS zone, min(level) AS saddle FROM reach WHERE c = 39", on="cells")
def saddle_level(df):
    """Lowest level that links the first column to the last."""
    x = df.select(F.lit(0).cast("long").alias("zone"), "r", "c", "dem", (F.col("c") == 0).alias("seed"), (F.col("c") == 39).alias("target"))
    return X.saddle(x, ["zone"])


@query("variogram_fit", None)
def variogram_fit(spark, sf):
    """One exponential, and an exponential nested with a spherical one, on the semivariogram of all node pairs."""
    from gridloom.plans.relations import variogram_pairs

    v = variogram_pairs(spark, sf).groupBy("lag").agg(F.count("*").alias("n"), F.avg(0.5 * F.col("dr") ** 2).alias("g")).orderBy("lag").collect()  # a row per lag
    rows = []
    for models in (("exponential",), ("exponential", "spherical")):
        f = X.fit_variogram([250.0 * r.lag + 125 for r in v], [r.g for r in v], [r.n for r in v], models)
        rows += [("+".join(models), m, round(f["nugget"], 4), round(s, 4), round(r, 2)) for m, s, r in zip(models, f["sills"], f["ranges"], strict=True)]
    return spark.createDataFrame(rows, "fit string, model string, nugget double, sill double, range_m double")
