"""Agreement metrics from counts, ranked scores and resamples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def defined(a: Column, b: Column) -> Column:
    """a / b, NULL on an empty denominator: an undefined metric is never 0."""
    return F.when(b != 0, a / b)


def zeroed(a: Column, b: Column) -> Column:
    """a / max(b, 1): the other contract, 0 on an empty denominator."""
    return a / F.greatest(b, F.lit(1))


def confusion(df: DataFrame, predicted: Column, actual: Column, keys=()) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))


def scores(tp="tp", fp="fp", fn="fn", divide=defined) -> dict[str, Column]:
    a, b, c = (F.col(x) if isinstance(x, str) else x for x in (tp, fp, fn))
    p, r = divide(a, a + b), divide(a, a + c)
    f1 = F.when(p.isNull() | r.isNull(), None).when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return {"precision": p, "recall": r, "f1": f1, "iou": divide(a, a + b + c)}


def event_scores(tp="tp", fp="fp", fn="fn", divide=defined) -> dict[str, Column]:
    a, b, c = F.col(tp), F.col(fp), F.col(fn)
    return {"pod": divide(a, a + c), "far": divide(b, a + b), "csi": divide(a, a + b + c), "bias": divide(a + b, a + c)}


def csi_bounds(tp: Column, fp: Column, fn: Column, unknown_wet: Column, unknown_dry: Column) -> dict[str, Column]:
    """CSI on decided cells and over every way to decide the unknown ones."""
    base = tp + fp + fn
    return {
        "csi_decided": defined(tp, base), "csi_unknown_dry": defined(tp, base + unknown_wet), "csi_unknown_wet": defined(tp + unknown_wet, base + unknown_wet + unknown_dry),
        "csi_min": defined(tp, base + unknown_wet + unknown_dry), "csi_max": defined(tp + unknown_wet, base + unknown_wet),
    }


def reference_counts(df: DataFrame, predicted: Column, reference: Column, was_wet: Column, keys=()) -> DataFrame:
    """Cells and predicted cells on each kind of reference: 2 standing water (wet or dry before), 1 event flood, 0 land, anything else unknown."""
    hit = F.coalesce(predicted, F.lit(False))
    wet = F.coalesce(was_wet, F.lit(False))
    kinds = {"water": reference == 2, "water_was_wet": (reference == 2) & wet, "water_was_dry": (reference == 2) & ~wet, "event": reference == 1, "land": reference == 0, "unknown": ~F.coalesce(reference.isin(0, 1, 2), F.lit(False))}
    return df.groupBy(*keys).agg(*(F.count_if(k).alias(f"n_{n}") for n, k in kinds.items()), *(F.count_if(k & hit).alias(f"hit_{n}") for n, k in kinds.items()))


def reference_endpoints(cell_area: float) -> dict[str, Column]:
    """Areas and shares from reference_counts; a share of nothing is NULL."""
    area = lambda n: F.col(n) * cell_area
    return {
        "predicted_on_water": area("hit_water"), "predicted_on_water_was_wet": area("hit_water_was_wet"), "predicted_on_water_was_dry": area("hit_water_was_dry"), "water_share": defined(F.col("hit_water"), F.col("n_water")), "water": area("n_water"),
        "event_recall": defined(F.col("hit_event"), F.col("n_event")), "event_missed": area("n_event") - area("hit_event"), "event": area("n_event"), "land_false": area("hit_land"),
        "land_false_rate": defined(F.col("hit_land"), F.col("n_land")), "land": area("n_land"), "predicted_on_unknown": area("hit_unknown"), "unknown": area("n_unknown"),
    }


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Overall accuracy and Cohen's kappa of two class columns."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("_n"))
    rows, cols = (cells.groupBy(F.col(k).alias("_k")).agg(F.sum("_n").alias(f"_{k}")) for k in (a, b))
    chance = rows.join(cols, "_k").agg(F.sum(F.col(f"_{a}") * F.col(f"_{b}")).alias("_e"))
    total = cells.agg(F.sum("_n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("_n")).otherwise(0)).alias("_same"))
    oa, pe = F.col("_same") / F.col("n"), F.coalesce(F.col("_e"), F.lit(0)) / (F.col("n") * F.col("n"))
    return total.crossJoin(F.broadcast(chance)).select("n", oa.alias("accuracy"), defined(oa - pe, 1 - pe).alias("kappa"))  # one row on either side


def ranked(df: DataFrame, score: str, label: str, by=()) -> DataFrame:
    """Distinct scores, highest first, with cumulative true and false positives: ties enter together.

    The scores are grouped before they are ranked, so the window sees distinct scores, not rows.
    """
    by = list(by)
    g = df.groupBy(*by, score).agg(F.sum(label).alias("_p"), F.count("*").alias("_n"))
    w = Window.partitionBy(*by or [F.lit(0)]).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by or [F.lit(0)])
    return g.withColumns({"tp": F.sum("_p").over(w), "seen": F.sum("_n").over(w), "pos": F.sum("_p").over(whole), "all": F.sum("_n").over(whole)})


def average_precision(df: DataFrame, score: str, label: str, by=()) -> DataFrame:
    r = ranked(df, score, label, by)
    return r.groupBy(*by).agg(F.sum(F.col("_p") / F.col("pos") * F.col("tp") / F.col("seen")).alias("ap"))


def roc_auc(df: DataFrame, score: str, label: str, by=()) -> DataFrame:
    """Mann-Whitney with ties at half."""
    r = ranked(df, score, label, by).withColumns({"_neg": F.col("_n") - F.col("_p"), "_fp": F.col("seen") - F.col("tp")})
    return r.groupBy(*by).agg((F.sum(F.col("_neg") * (F.col("tp") - F.col("_p") / 2)) / (F.max("pos") * (F.max("all") - F.max("pos")))).alias("auc"))


def threshold_at_recall(df: DataFrame, score: str, label: str, target: float, by=()) -> DataFrame:
    """The highest score at which the cumulative positives reach the target share."""
    r = ranked(df, score, label, by).filter(F.col("tp") >= F.lit(target) * F.col("pos"))
    return r.groupBy(*by).agg(F.max(score).alias("threshold"))


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: list[float], by=()) -> DataFrame:
    """Confusion counts at each of a fixed list of thresholds."""
    each = df.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in thresholds))))
    return confusion(each, F.col(score) >= F.col("threshold"), F.col(label) == 1, [*by, "threshold"])


def best_f1_threshold(df: DataFrame, score: str, label: str, thresholds: list[float], by=()) -> DataFrame:
    """Threshold of the largest F1, the lowest of equal ones."""
    s = threshold_sweep(df, score, label, thresholds, by).withColumn("f1", F.round(F.coalesce(scores()["f1"], F.lit(0.0)), 12))
    return s.groupBy(*by).agg(F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold"))).alias("_b")).select(*by, "_b.*")


def resample(spark, blocks: DataFrame, reps: int, block: str, seed: int = 1) -> DataFrame:
    """rep, block: draws with replacement, as many as there are blocks, from one linear congruence per (rep, draw) that any engine can repeat.

    Blocks are numbered in order; the number of blocks is one row, and the draws are a distributed range.
    """
    w = Window.orderBy(block)
    numbered = blocks.select(block).distinct().withColumn("_at", F.row_number().over(w) - 1)
    n = numbered.count()
    draws = spark.range(reps * n).select((F.col("id") / F.lit(max(n, 1))).cast("long").alias("rep"), (lcg(F.col("id") + seed) % F.lit(max(n, 1))).alias("_at"))
    return draws.join(numbered, "_at").select("rep", block)


def lcg(k: Column) -> Column:
    """Two rounds of a 31-bit linear congruential step, high bits first: the same integers in every engine."""
    a = F.pmod(k * 1103515245 + 12345, F.lit(2147483648))
    b = F.pmod(a * 1103515245 + 12345, F.lit(2147483648))
    return F.floor(b / 1024)


def bootstrap(counts: DataFrame, draws: DataFrame, block: str, statistics: dict[str, Column], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of each statistic of summed block counts over resamples, and in how many it is defined."""
    values = [c for c in counts.columns if c != block]
    sums = draws.join(counts, block).groupBy("rep").agg(*(F.sum(v).alias(v) for v in values))
    s = sums.select("rep", *(x.alias(k) for k, x in statistics.items()))
    long = s.unpivot(["rep"], list(statistics), "statistic", "value")
    return long.groupBy("statistic").agg(F.percentile("value", F.lit(low)).alias("low"), F.percentile("value", F.lit(high)).alias("high"), F.count("value").alias("n_defined"))


def summary(df: DataFrame, error: str, keys=()) -> DataFrame:
    e = F.col(error)
    return df.groupBy(*keys).agg(F.count(e).alias("n"), F.avg(e).alias("bias"), F.median(e).alias("median"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
