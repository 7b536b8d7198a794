"""Connected components of masks on a lattice.

Tiles are labelled on their own, by array operations inside one group per tile, so a group is never larger than a tile. Labels that touch
across a tile's edge make a small graph, whose components come from alternating star operations over edge tables (Kiveris
et al., 2014), written to the shared folder between rounds. Tiles follow the lattice, never an accounting zone: cutting the graph
at ownership lines would make them barriers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.joins import neighbours, salted_join
from gridloom.operators.morphology import FOUR, erode, structure
from gridloom.staging import release, stage


#: Edges between tiles up to which one process merges them; more go through star_components. Either way is exact.
MOST_LOCAL_EDGES = 200_000


def tile_components(edges: DataFrame) -> DataFrame:
    """node, root for the edges between tiles: by union-find if a count shows that they are few, else by star operations."""
    edges = stage(edges, "tile_edges")
    if edges.limit(MOST_LOCAL_EDGES + 1).count() > MOST_LOCAL_EDGES:
        return star_components(edges)
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges.collect():
        a, b = sorted((find(tuple(u)), find(tuple(v))))
        parent[b] = a
    kind = edges.schema["u"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(x, find(x)) for x in list(parent)], f"node {kind}, root {kind}")


def star_components(edges: DataFrame) -> DataFrame:
    """edges: u, v of any orderable type. Result: node, root (the smallest node of its component), for nodes with an edge.

    Every round joins each node with its least neighbour; a node with very many edges is dealt over many tasks. Rounds go on until the
    edges stay as they are, which they do once each component is a star.
    """
    e = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = stage(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = stage(salted_join(both, near, ["u"], "n", 2 * now[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        rest = salted_join(large, low, ["u"], "n", 2 * now[0]).filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        made = stage(rest.union(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        release(e, near, large, low)
        e = made
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _label_tile(connectivity: int):
    offsets = structure(connectivity)

    def run(pdf):
        import numpy as np

        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        r0, c0 = r.min(), c.min()
        ny, nx = r.max() - r0 + 3, c.max() - c0 + 3
        flat = (r - r0 + 1) * nx + (c - c0 + 1)
        order = np.argsort(flat, kind="stable")
        number = np.full(ny * nx, len(flat), np.int64)  # the last number stands for every cell outside the mask
        number[flat[order]] = np.arange(len(flat))
        near = np.stack([number[flat[order] + i * nx + j] for i, j in offsets])
        label = np.append(np.arange(len(flat)), len(flat))
        while True:
            low = np.minimum(label[:-1], label[near].min(axis=0))
            new = np.append(np.minimum(low, label[low]), len(flat))
            np.minimum.at(new, label[:-1], low)
            new[:-1] = new[new[:-1]]
            if np.array_equal(new, label):
                break
            label = new
        root = order[label[:-1]]
        out = pdf.iloc[order].copy()
        out["lr"], out["lc"] = r[root], c[root]
        return out

    return run


def label(mask: DataFrame, connectivity: int = 8, by=(), tile: int = 256) -> DataFrame:
    """Cells with comp_r, comp_c: the first cell, in scan order, of their component (within the same `by` values)."""
    by = list(by)
    offsets = structure(connectivity)
    m = mask.select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct()
    m = m.withColumns({"tr": F.floor(F.col("r") / tile), "tc": F.floor(F.col("c") / tile)})
    schema = ", ".join(f"`{n}` {t}" for n, t in m.dtypes) + ", lr long, lc long"
    tiles = stage(m.groupBy(*by, "tr", "tc").applyInPandas(_label_tile(connectivity), schema), "tiles")
    node = lambda p="": F.struct(*(F.col(f"{p}{b}").alias(b) for b in by), F.col(f"{p}lr").alias("r"), F.col(f"{p}lc").alias("c"))
    # Only cells on a tile's rim have neighbours in another tile.
    rim = tiles.filter((F.col("r") % tile).isin(0, tile - 1) | (F.col("c") % tile).isin(0, tile - 1))
    a = neighbours(rim.select(*by, "r", "c", "tr", "tc", node().alias("u")), offsets)
    b = rim.select(*by, F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("tr").alias("br"), F.col("tc").alias("bc"), node().alias("v"))
    edges = a.join(b, [*by, "nr", "nc"]).filter("tr <> br OR tc <> bc").select("u", "v").distinct()
    roots = tile_components(edges)
    x = tiles.withColumn("node", node()).join(roots, "node", "left").withColumn("_k", F.coalesce("root", "node"))
    first = x.groupBy("_k").agg(F.min(F.struct("r", "c")).alias("_f"))
    return x.join(first, "_k").select(*by, "r", "c", F.col("_f.r").alias("comp_r"), F.col("_f.c").alias("comp_c"))


def connected_to(mask: DataFrame, seed: DataFrame, connectivity: int = 8, by=(), tile: int = 256) -> DataFrame:
    """Cells of components that hold a seed cell."""
    by = list(by)
    lab = stage(label(mask, connectivity, by, tile), "labels")
    hit = lab.join(seed.select(*by, "r", "c").distinct(), [*by, "r", "c"], "left_semi").select(*by, "comp_r", "comp_c").distinct()
    return lab.join(hit, [*by, "comp_r", "comp_c"], "left_semi").select(*by, "r", "c")


def largest(mask: DataFrame, connectivity: int = 8, by=(), tile: int = 256) -> DataFrame:
    """Cells of the largest component; of equal ones the first in scan order."""
    by = list(by)
    lab = stage(label(mask, connectivity, by, tile), "labels")
    sizes = lab.groupBy(*by, "comp_r", "comp_c").agg(F.count("*").alias("_n"))
    best = sizes.groupBy(*by).agg(F.max(F.struct(F.col("_n"), -F.col("comp_r"), -F.col("comp_c"), F.col("comp_r").alias("cr"), F.col("comp_c").alias("cc"))).alias("b")).select(*by, F.col("b.cr").alias("comp_r"), F.col("b.cc").alias("comp_c"))
    return lab.join(best, [*by, "comp_r", "comp_c"], "left_semi").select(*by, "r", "c")


def seed_classes(mask: DataFrame, seed_all: DataFrame, seed_river: DataFrame, connectivity: int = 8, by=(), tile: int = 256) -> DataFrame:
    """Labelled cells with cls: 1 the component touches the river's seed, 2 only other seeds, 0 none."""
    by = list(by)
    keys = [*by, "r", "c"]
    lab = stage(label(mask, connectivity, by, tile), "labels")
    one = lambda s, n: s.select(*keys).distinct().withColumn(n, F.lit(1))
    x = lab.join(one(seed_all, "_a"), keys, "left").join(one(seed_river, "_r"), keys, "left")
    cls = x.groupBy(*by, "comp_r", "comp_c").agg(F.when(F.max("_r") == 1, 1).when(F.max("_a") == 1, 2).otherwise(0).alias("cls"))
    return lab.join(cls, [*by, "comp_r", "comp_c"])


def erosion_disconnect(mask: DataFrame, target: DataFrame, river: DataFrame, most: int = 3, connectivity: int = 8, tile: int = 256) -> int:
    """Fewest 4-neighbour erosions, sources kept, after which no target cell is linked to the river: 0 if none was, most + 1 if all were survived."""
    source = mask.select("r", "c").join(river.select("r", "c"), ["r", "c"], "left_semi")

    def linked(m) -> bool:
        return bool(connected_to(m, river, connectivity, tile=tile).join(target.select("r", "c"), ["r", "c"], "left_semi").limit(1).count())

    m = mask.select("r", "c")
    if not linked(m):
        return 0
    for k in range(1, most + 1):
        m = stage(erode(m, 4, keep=source), "eroded")
        if not linked(m):
            return k
    return most + 1


def links(labels: DataFrame, day: str, keys=("comp_r", "comp_c"), least: int = 1) -> DataFrame:
    """Cells shared by each component of a day and each of the next day."""
    a = labels.select(F.col(day).alias("_d"), "r", "c", *(F.col(k).alias(f"prev_{k}") for k in keys))
    b = labels.select((F.col(day) - 1).alias("_d"), "r", "c", *(F.col(k).alias(f"next_{k}") for k in keys))
    names = [f"prev_{k}" for k in keys] + [f"next_{k}" for k in keys]
    return a.join(b, ["_d", "r", "c"]).groupBy(F.col("_d").alias(day), *names).agg(F.count("*").alias("cells")).filter(F.col("cells") >= least)


def shape_statistics(labelled: DataFrame, label_cols=("comp_r", "comp_c")) -> DataFrame:
    """Cells, extent and elongation (ratio of the principal standard deviations) of each component."""
    k = list(label_cols)
    m = labelled.groupBy(*k).agg(F.count("*").alias("n"), F.var_pop("r").alias("vr"), F.var_pop("c").alias("vc"), F.covar_pop("r", "c").alias("rc"), (F.max("r") - F.min("r") + 1).alias("height"), (F.max("c") - F.min("c") + 1).alias("width"))
    mean, gap = (F.col("vr") + F.col("vc")) / 2, F.sqrt(F.pow((F.col("vr") - F.col("vc")) / 2, F.lit(2)) + F.col("rc") * F.col("rc"))
    low = mean - gap
    return m.select(*k, "n", "height", "width", (F.col("n") / (F.col("height") * F.col("width"))).alias("fill"), F.when(low > 1e-9, F.sqrt((mean + gap) / low)).alias("elongation"))


__all__ = ["FOUR", "connected_to", "erosion_disconnect", "label", "largest", "links", "seed_classes", "shape_statistics", "star_components"]
