"""Evidence model: random forests under spatial cross-validation, out-of-fold thresholds, blockwise scores, blended tiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.metrics import average_precision, threshold_at_recall
from gridloom.schema import SCORE_SCALE


def _forest(train: DataFrame, features: list[str], label: str, trees: int, depth: int, seed: int):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    weigh = train.groupBy(label).count().collect()  # a row per class
    total = sum(r["count"] for r in weigh)
    weight = reduce(lambda acc, r: acc.when(F.col(label) == r[label], total / (len(weigh) * r["count"])), weigh, F.when(F.lit(False), 1.0))
    rows = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(train.withColumn("_w", weight))
    return RandomForestClassifier(labelCol=label, featuresCol="_x", weightCol="_w", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def score_with(model, df: DataFrame, features: list[str], out: str = "score") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(df)
    return model.transform(x).withColumn(out, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, folds: int, buffer=None, trees: int = 20, depth: int = 5, seed: int = 1) -> DataFrame:
    """Every row scored by a forest that saw neither its fold nor, with `buffer(train, test)`, rows too near to it."""
    parts = []
    for k in range(folds):
        train, test = df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)
        train = buffer(train, test) if buffer else train
        parts.append(score_with(_forest(train, features, label, trees, depth, seed), test, features))
    return reduce(DataFrame.unionByName, parts)


def nested(df: DataFrame, features: list[str], label: str, outer: str, inner: str, folds: int, grid: list[tuple[int, int]], recall: float = 0.9) -> DataFrame:
    """Per outer fold: parameters of best mean inner average precision, refit, and the threshold of inner out-of-fold scores."""
    rows = []
    for k in range(folds):
        train = df.filter(F.col(outer) != k)
        scored = {g: out_of_fold(train, features, label, inner, folds, trees=g[0], depth=g[1]).cache() for g in grid}
        ap = {g: average_precision(s, "score", label, [inner]).agg(F.avg("ap")).first()[0] for g, s in scored.items()}
        best = max(grid, key=lambda g: (ap[g], -g[0], -g[1]))
        cut = threshold_at_recall(scored[best], "score", label, recall).first()[0]
        test = score_with(_forest(train, features, label, *best, 1), df.filter(F.col(outer) == k), features)
        rows.append(test.withColumns({"trees": F.lit(best[0]), "depth": F.lit(best[1]), "threshold": F.lit(cut)}))
        for s in scored.values():
            s.unpersist()
    return reduce(DataFrame.unionByName, rows)


def choose(df: DataFrame, features: list[str], label: str, fold: str, folds: int, grid: list[tuple[int, int]]) -> DataFrame:
    """trees, depth, median_ap, chosen: every parameter set by the median of its out-of-fold average precision over the folds; of equal ones the smaller."""
    rows = []
    for trees, depth in grid:
        scored = out_of_fold(df, features, label, fold, folds, trees=trees, depth=depth)
        rows.append((trees, depth, average_precision(scored, "score", label, [fold]).agg(F.median("ap")).first()[0]))
    best = max(rows, key=lambda r: (r[2] if r[2] is not None else -1.0, -r[0], -r[1]))
    return df.sparkSession.createDataFrame([(*r, r == best) for r in rows], "trees int, depth int, median_ap double, chosen boolean")


def importances(df: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 5, seed: int = 1) -> DataFrame:
    """feature, importance (they add up to 1) and rank of the forest over all rows."""
    found = _forest(df, features, label, trees, depth, seed).featureImportances.toArray().tolist()
    ranked = sorted(zip(features, found, strict=True), key=lambda x: (-x[1], x[0]))
    return df.sparkSession.createDataFrame([(f, v, k + 1) for k, (f, v) in enumerate(ranked)], "feature string, importance double, rank int")


def transfer(df: DataFrame, features: list[str], label: str, frame: str, trees: int = 20, depth: int = 5, seed: int = 1) -> DataFrame:
    """source, target, ap: a forest of each frame judged in each other frame, where it saw nothing."""
    names, rows = sorted(r[0] for r in df.select(frame).distinct().collect()), []  # a row per frame
    for a in names:
        model = _forest(df.filter(F.col(frame) == a), features, label, trees, depth, seed)
        scored = score_with(model, df.filter(F.col(frame) != a), features)
        rows.append(average_precision(scored, "score", label, [frame]).select(F.lit(a).alias("source"), F.col(frame).alias("target"), "ap"))
    return reduce(DataFrame.unionByName, rows)


def surface_classes(df: DataFrame, features: list[str], label: str, least: float = 0.5, uncertain: int = 0, trees: int = 20, depth: int = 5, seed: int = 1) -> DataFrame:
    """df with surface and probability: the most probable class of a forest of all classes, `uncertain` below the least probability."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    model = _forest(df, features, label, trees, depth, seed)
    p = vector_to_array("probability")
    x = model.transform(VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(df)).withColumn("probability", F.array_max(p))
    return x.withColumn("surface", F.when(F.col("probability") >= least, F.col("prediction").cast("int")).otherwise(uncertain)).drop("_x", "rawPrediction", "prediction")


def quantised(df: DataFrame, score: str, threshold: int) -> DataFrame:
    """Scores as integers below the scale, and the state: at or above the threshold."""
    q = F.least(F.rint(F.col(score) * SCORE_SCALE), F.lit(float(SCORE_SCALE - 1))).cast("int")
    return df.withColumn("q", q).withColumn("state", F.col("q") >= threshold)


def blended(tiles: DataFrame, size: int, value: str = "score") -> DataFrame:
    """Overlapping tile scores (tr, tc: origin; i, j: place in the tile) joined under a Hann window."""
    hann = lambda k: F.pow(F.sin(F.pi() * (F.col(k) + 0.5) / size), F.lit(2))
    x = tiles.withColumns({"_w": hann("i") * hann("j"), "r": F.col("tr") + F.col("i"), "c": F.col("tc") + F.col("j")})
    return x.groupBy("r", "c").agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias(value))


def patches(cells: DataFrame, size: int, stride: int, role: str = "role") -> DataFrame:
    """Origins of full patches whose cells have one role only, with the role: each cell names the patches that hold it."""
    def first(k):
        return F.greatest(F.ceil((F.col(k) - size + 1) / stride), F.lit(0))

    at = lambda k: F.explode(F.transform(F.sequence(first(k), F.floor(F.col(k) / stride)), lambda n: n * stride))
    x = cells.withColumn("pr", at("r")).withColumn("pc", at("c"))
    return x.groupBy("pr", "pc").agg(F.count("*").alias("n"), F.min(role).alias("role"), F.max(role).alias("_m")).filter((F.col("n") == size * size) & (F.col("role") == F.col("_m"))).select("pr", "pc", "role")
