"""Random fields, worlds and water balances.

A field is a sum of random plane waves, so any cell of any draw can be evaluated on its own: no task ever holds a lattice. A world is a set of
rows keyed by its draw; worlds go through the distributed inundation a batch of draws at a time and leave only their accounting. Water
balances integrate one run per group: a run has a few cells and many steps, and runs are independent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.sampling import key, normal
from gridloom.staging import release, stage

GRAVITY = 9.81

#: Correlation by distance in units of the range.
CORRELATION = {
    "exponential": lambda x: F.exp(-x),
    "gaussian": lambda x: F.exp(-(x * x)),
    "spherical": lambda x: F.when(x < 1, (1 - x) * (1 - x) * (1 + x / 2)).otherwise(0.0),
}


def covariance(h: Column, range_m: float, model: str = "exponential") -> Column:
    """Correlation at distance h."""
    if model not in CORRELATION:
        raise ValueError(f"unknown model {model}; known are {', '.join(sorted(CORRELATION))}")
    return CORRELATION[model](h / range_m)


def _wave_numbers(model: str, n: int, rng):
    """n radial wave numbers, in units of 1 / range, whose random directions in the plane give the model's correlation (Bochner).

    Exponential and gaussian by the inverse of their radial distribution. The spherical model is the overlap of two balls, so its waves in
    space follow the squared transform of a ball, tabulated here, and the plane sees their projection.
    """
    import numpy as np

    u = rng.random(n)
    if model == "exponential":
        return np.sqrt((1 - u) ** -2.0 - 1)
    if model == "gaussian":
        return 2 * np.sqrt(-np.log1p(-u))
    if model == "spherical":
        x = np.linspace(1e-3, 2000, 2_000_001)
        mass = np.cumsum(((np.sin(x) - x * np.cos(x)) / x**2) ** 2)
        upwards = rng.uniform(-1, 1, n)
        return 2 * np.interp(u, mass / mass[-1], x) * np.sqrt(1 - upwards**2)
    raise ValueError(f"unknown model {model}; known are {', '.join(sorted(CORRELATION))}")


def _waves(draw: int, structures, n: int, seed: int):
    """Wave vectors and phases of a draw: each wave belongs to one structure, by the structures' weights."""
    import numpy as np

    rng = np.random.default_rng([seed, draw])
    weight = np.array([w for w, _, _ in structures], float)
    share = np.floor(np.cumsum(weight) / weight.sum() * n + 0.5).astype(int)
    k = np.concatenate([_wave_numbers(m, b - a, rng) / r for (_, r, m), a, b in zip(structures, [0, *share[:-1]], share, strict=True)])
    turn, phase = rng.uniform(0, 2 * np.pi, (2, len(k)))
    return k * np.cos(turn), k * np.sin(turn), phase


def field_at(cells: DataFrame, cell: float, structures, nugget: float = 0.0, seed: int = 1, waves: int = 1024) -> DataFrame:
    """cells (draw, r, c and others) with f: Gaussian fields of unit variance, one per draw, evaluated where cells are. No shuffle.

    structures: (weight, range, model) each; nugget: the share of white noise.
    """
    import pyarrow as pa

    structures = [tuple(s) for s in structures]
    at = [cells.columns.index(k) for k in ("draw", "r", "c")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: dict[int, tuple] = {}
        for batch in batches:
            draw, r, c = (batch.column(i).to_numpy().astype(float) for i in at)
            f = np.empty(batch.num_rows)
            for d in np.unique(draw).astype(int).tolist():
                if d not in held:
                    if len(held) >= 64:
                        held.clear()
                    held[d] = _waves(d, structures, waves, seed)
                kx, ky, phase = held[d]
                rows = np.flatnonzero(draw == d)
                for part in np.array_split(rows, -(-len(rows) // 512)):
                    f[part] = np.cos(np.outer(c[part] * cell, kx) + np.outer(r[part] * cell, ky) + phase).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f * math.sqrt(2 / waves))], names=[*batch.schema.names, "f"])

    made = cells.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in cells.dtypes) + ", f double")
    if not nugget:
        return made
    where = [F.col(k) for k in ("draw", "r", "c")]
    noise = normal(key(*where, seed=seed + 7), key(*where, seed=seed + 8))
    return made.withColumn("f", math.sqrt(1 - nugget) * F.col("f") + math.sqrt(nugget) * noise)


def correlated_fields(draws: DataFrame, ny: int, nx: int, cell: float, structures, nugget: float = 0.0, seed: int = 1, waves: int = 1024) -> DataFrame:
    """draw, r, c, f on a whole lattice."""
    lattice = draws.select(F.col("draw").cast("long")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(ny - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    return field_at(lattice.select("draw", F.col("r").cast("long"), F.col("c").cast("long")), cell, structures, nugget, seed, waves)


def perturbed_heights(node_day: DataFrame, draws: int, datum: float = 0.05, observed: float = 0.1, by_gap: dict[int, float] | None = None, seed: int = 1, first: int = 0) -> DataFrame:
    """Node heights of the draws from `first` on: one datum shift per draw, one error per observation, one normal per gap run, scaled by its gap.

    node_day: node, day_no, h, kind, gap, run. Draw 0 is not perturbed.
    """
    by_gap = by_gap or {1: 0.1, 2: 0.2}
    x = node_day.withColumn("draw", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + draws - 1).cast("long"))))
    d, n, t = F.col("draw"), F.col("node"), F.col("day_no")
    shift = datum * normal(key(d, seed=seed), key(d, seed=seed + 1))
    noise = F.when(F.col("kind") == 0, observed * normal(key(d, n, t, seed=seed + 2), key(d, n, t, seed=seed + 3))).otherwise(0.0)
    sigma = F.when(F.col("gap") <= 1, by_gap[1]).otherwise(by_gap[2])
    run = F.when(F.col("kind").isin(1, 2), sigma * normal(key(d, n, F.col("run"), seed=seed + 4), key(d, n, F.col("run"), seed=seed + 5))).otherwise(0.0)
    return x.withColumn("h_draw", F.when(d == 0, F.col("h")).otherwise(F.col("h") + shift + noise + run))


def synthetic_domain(spark, ny: int = 90, nx: int = 180, days: int = 12) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A valley with a channel and a side pocket, and a short flood seen by four nodes along it: cells (r, c, dem, sigma, seed, zone),
    node_day (node, day_no, h, kind, gap, run), nearest (r, c, node)."""
    r, c = F.floor(F.col("id") / nx), F.col("id") % nx
    valley = 2 + F.abs(r - ny / 2) * 0.15 + c * 0.01
    pocket = F.when((r > ny * 0.75) & (c > nx * 0.6), -2.0).otherwise(0.0)
    channel = F.abs(r - ny / 2) <= 1
    cells = spark.range(ny * nx).select(r.alias("r"), c.alias("c"), (valley + pocket).alias("dem"), F.when(channel, 0.0).otherwise(0.2).alias("sigma"), channel.alias("seed"), (c >= nx / 2).cast("int").alias("zone"))
    days_ = spark.range(days).select(F.col("id").alias("day_no"), (4.0 + F.when(F.col("id") >= 4, 4 * F.exp(-(F.col("id") - 5) * (F.col("id") - 5) / 6.0)).otherwise(0.0)).alias("h"))
    nodes = days_.withColumn("node", F.explode(F.array(*(F.lit(i).cast("long") for i in range(4))))).select("node", "day_no", "h", F.lit(0).alias("kind"), F.lit(0).alias("gap"), F.col("day_no").alias("run"))
    nearest = cells.select("r", "c", F.explode(F.array(*((F.floor(F.col("c") * 4 / nx) + i) % 4 for i in range(3)))).alias("node"))
    return cells, nodes, nearest


def worlds(
    cells: DataFrame, node_day: DataFrame, nearest: DataFrame, draws: int, first_day_of_event: int, cell_m: float = 20.0, structures=((1.0, 200.0, "exponential"),), batch: int = 8,
    datum: float = 0.05, observed: float = 0.1, seed: int = 1, tile: int = 256, connectivity: int = 8,
) -> DataFrame:
    """Monte-Carlo worlds: draw, day_no, zone and its potential, baseline and new areas (km2) and volumes (hm3).

    cells: r, c, dem, sigma (standard error of dem, 0 where it is not disturbed), seed, zone; node_day: see perturbed_heights; nearest: the nodes whose
    median height is a cell's surface. A world has its own node heights and its own terrain error field, is labelled on its own, and its
    baseline is the union of its own days before the event. Draw 0 is the nominal one. Cells with the same nodes share one median, and
    `batch` draws are on disk at a time, of which only the accounting stays.
    """
    from gridloom.operators.inundation import potential

    sets = nearest.groupBy("r", "c").agg(F.array_sort(F.collect_set("node")).alias("nodes"))  # a few nodes per cell
    sets = stage(sets, "sets")
    members = sets.select("nodes").distinct().withColumn("node", F.explode("nodes"))
    ground = stage(cells.join(sets, ["r", "c"]), "ground")
    parts = []
    for first in range(0, draws, batch):
        n = min(batch, draws - first)
        heights = perturbed_heights(node_day, n, datum, observed, seed=seed, first=first)
        surface = members.join(heights, "node").groupBy("nodes", "draw", "day_no").agg(F.median("h_draw").alias("wse"))
        each = ground.withColumn("draw", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + n - 1).cast("long"))))
        f = field_at(each.select("draw", "r", "c", "dem", "sigma", "zone", "nodes"), cell_m, structures, seed=seed)
        dem = F.when(F.col("draw") == 0, F.col("dem")).otherwise(F.col("dem") + F.col("sigma") * F.col("f"))
        wet = f.withColumn("dem", dem).join(surface, ["nodes", "draw"]).filter("dem < wse").select("draw", "day_no", "r", "c", "dem", "wse", "zone")
        wet = stage(wet, "wet")
        pot = stage(potential(wet, cells.filter("seed"), by=("draw", "day_no"), connectivity=connectivity, tile=tile), "potential")
        base = pot.filter(F.col("day_no") < first_day_of_event).select("draw", "r", "c").distinct().withColumn("old", F.lit(True))
        x = wet.join(pot, ["draw", "day_no", "r", "c"]).join(base, ["draw", "r", "c"], "left")
        km2, depth, fresh = cell_m * cell_m / 1e6, F.col("wse") - F.col("dem"), F.col("old").isNull()
        daily = x.groupBy("draw", "day_no", "zone").agg(
            (F.count("*") * km2).alias("potential_km2"), (F.count_if(fresh) * km2).alias("new_km2"), (F.sum(depth) * km2).alias("potential_hm3"), (F.sum(F.when(fresh, depth).otherwise(0.0)) * km2).alias("new_hm3"),
        )
        total = base.join(cells.select("r", "c", "zone"), ["r", "c"]).groupBy("draw", "zone").agg((F.count("*") * km2).alias("baseline_km2"))
        parts.append(stage(daily.join(total, ["draw", "zone"], "left").withColumn("baseline_km2", F.coalesce("baseline_km2", F.lit(0.0))), "accounting"))
        release(wet, pot)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("draw", "day_no", "zone", "potential_km2", "baseline_km2", "new_km2", "potential_hm3", "new_hm3")


class _Basin:
    """Level, area and volume of one storage by its table of levels, which ascend; both are 0 below it and go on linearly above it."""

    def __init__(self, level, area):
        import numpy as np

        self.level, self.area = np.asarray(level, float), np.asarray(area, float)
        step = np.diff(self.level)
        if (step <= 0).any():
            raise ValueError("levels of a table must ascend")
        self.volume = np.concatenate([[0.0], np.cumsum(step * (self.area[1:] + self.area[:-1]) / 2)])
        self.volume = self.volume + np.arange(len(self.volume)) * 1e-9  # ascends even where the area is 0

    def level_of(self, volume: float) -> float:
        import numpy as np

        if volume >= self.volume[-1]:
            return float(self.level[-1] + (volume - self.volume[-1]) / max(self.area[-1], 1e-9))
        return float(np.interp(volume, self.volume, self.level))

    def area_at(self, level: float) -> float:
        import numpy as np

        return float(np.interp(level, self.level, self.area)) if level > self.level[0] else 0.0


def _tables(rows, name: str) -> dict[int, _Basin]:
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(int(r[name]), []).append((float(r["level"]), float(r["area"])))
    return {k: _Basin(*zip(*sorted(v), strict=True)) for k, v in by.items()}


def storage_cells(runs: DataFrame, tables: DataFrame, links: DataFrame, boundary: DataFrame, t_end: float, most_step: float = 60.0) -> DataFrame:
    """A network of storage cells filled from a river: run, cell, level, area, volume at t_end, and per run the water let in and lost.

    runs: run, roughness, width_factor, loss (m/s over the wet area). tables: cell, level, area. links: a, b (cells; -1 is the river), bed,
    width, length. boundary: t, level of the river. All but runs describe one network, a few rows per cell, and are read once.

    Discharge of a link obeys the momentum equation without its advective term, friction taken implicitly: with the flow's section A = width
    * depth, dQ/dt = -g A d(level)/dx - g n^2 Q |Q| / (A depth^(4/3)). Steps follow the fastest wave. What would leave a cell in a step is
    scaled to what it holds, so water is neither made nor lost.
    """
    import pandas as pd

    basins = _tables(tables.select("cell", "level", "area").collect(), "cell")  # the description of one network
    edges = [tuple(r) for r in links.select("a", "b", "bed", "width", "length").collect()]
    if unknown := {k for a, b, *_ in edges for k in (a, b)} - {-1, *basins}:
        raise ValueError(f"links name cells without a table: {sorted(unknown)}")
    river_t, river_h = zip(*sorted(tuple(r) for r in boundary.select("t", "level").collect()), strict=True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        n, factor, loss = (float(pdf[k].iloc[0]) for k in ("roughness", "width_factor", "loss"))
        volume, flow = dict.fromkeys(basins, 0.0), [0.0] * len(edges)
        t = taken = lost = 0.0
        while t < t_end:
            level = {k: basins[k].level_of(v) for k, v in volume.items()}
            level[-1] = float(np.interp(t, river_t, river_h))
            depth = [max(level[a], level[b]) - bed for a, b, bed, _, _ in edges]
            fastest = max((math.sqrt(GRAVITY * d) / e[4] for d, e in zip(depth, edges, strict=True) if d > 0), default=0.0)
            dt = min(most_step, t_end - t, 0.7 / fastest if fastest else most_step)
            for i, ((a, b, _, width, length), d) in enumerate(zip(edges, depth, strict=True)):
                if d <= 1e-4:
                    flow[i] = 0.0
                    continue
                section = width * factor * d
                push = flow[i] + dt * GRAVITY * section * (level[a] - level[b]) / length
                flow[i] = push / (1 + dt * GRAVITY * n * n * abs(flow[i]) / (section * d ** (4 / 3)))
            leaving = dict.fromkeys(basins, 0.0)
            for (a, b, *_), q in zip(edges, flow, strict=True):
                source = a if q > 0 else b
                if source in leaving:
                    leaving[source] += abs(q) * dt
            part = {k: min(1.0, volume[k] / out) if out > 0 else 1.0 for k, out in leaving.items()}
            for i, (a, b, *_) in enumerate(edges):
                flow[i] *= part.get(a if flow[i] > 0 else b, 1.0)
                for k, sign in ((a, -1), (b, 1)):
                    if k in volume:
                        volume[k] += sign * flow[i] * dt
                    else:
                        taken -= sign * flow[i] * dt
            for k in volume:
                gone = min(max(volume[k], 0.0), loss * basins[k].area_at(level[k]) * dt)
                volume[k] = max(volume[k], 0.0) - gone
                lost += gone
            t += dt
        order = sorted(basins)
        level = [basins[k].level_of(volume[k]) for k in order]
        return pd.DataFrame({"run": int(pdf["run"].iloc[0]), "cell": order, "level": level, "area": [basins[k].area_at(x) for k, x in zip(order, level, strict=True)], "volume": [volume[k] for k in order], "let_in": taken, "lost": lost})

    return runs.groupBy("run").applyInPandas(run, "run long, cell long, level double, area double, volume double, let_in double, lost double")


def reservoir(runs: DataFrame, table: DataFrame, river: DataFrame, step: float = 3600.0, inner: int = 20) -> DataFrame:
    """One basin behind a crest: run, t, level, area, flow (m3/s, inwards) at every `step` of the river's hydrograph.

    runs: run, form ('weir' or 'friction'), crest, width, coefficient (of the weir), roughness and length (of the channel), floor (offset of the
    table's levels), loss (m/s). table: level, area. river: t, level. Over a weir Q = C width h1^1.5 (1 - (h2 / h1)^1.5)^0.385 with the heads
    above the crest on both sides (Villemonte); through a channel Q = width d^(5/3) sqrt(fall / length) / roughness with the mean depth d.
    Each step is integrated in `inner` parts, in none of which more than levels both sides may pass.
    """
    import pandas as pd

    rows = sorted(tuple(r) for r in table.select("level", "area").collect())  # one table and one hydrograph
    when, stage_ = zip(*sorted(tuple(r) for r in river.select("t", "level").collect()), strict=True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        p = pdf.iloc[0]
        basin = _Basin([h + p["floor"] for h, _ in rows], [a for _, a in rows])
        volume, out = 0.0, []
        for k in range(int((when[-1] - when[0]) // step) + 1):
            t = when[0] + k * step
            for j in range(inner):
                outside, inside = float(np.interp(t + j * step / inner, when, stage_)), basin.level_of(volume)
                high, low = max(outside, inside), min(outside, inside)
                head, back = max(high - p["crest"], 0.0), max(low - p["crest"], 0.0)
                if p["form"] == "weir":
                    q = p["coefficient"] * p["width"] * head**1.5 * (1 - (back / head) ** 1.5) ** 0.385 if head > back else 0.0
                else:
                    q = p["width"] * ((head + back) / 2) ** (5 / 3) * math.sqrt((head - back) / p["length"]) / p["roughness"]
                q = q if outside > inside else -q
                if j == 0:
                    out.append((t, inside, basin.area_at(inside), q))
                move = q * step / inner
                if move > 0:  # not above the river
                    top = np.interp(outside, basin.level, basin.volume) + max(outside - basin.level[-1], 0.0) * basin.area[-1]
                    move = min(move, max(float(top) - volume, 0.0))
                else:  # not below the river or the crest
                    floor = float(np.interp(max(outside, p["crest"]), basin.level, basin.volume))
                    move = max(move, min(floor - volume, 0.0))
                volume = max(volume + move - p["loss"] * basin.area_at(inside) * step / inner, 0.0)
        made = pd.DataFrame(out, columns=["t", "level", "area", "flow"])
        made.insert(0, "run", int(p["run"]))
        return made

    return runs.groupBy("run").applyInPandas(run, "run long, t double, level double, area double, flow double")


def saddle(cells: DataFrame, by, sources: str = "seed", target: str = "target", value: str = "dem") -> DataFrame:
    """The lowest possible highest cell on a path from a source to the target, per group: a priority flood of one window."""
    by = list(by)

    def flood(pdf):
        import heapq

        import pandas as pd

        z = {(r, c): v for r, c, v in zip(pdf["r"], pdf["c"], pdf[value], strict=True) if v == v}
        goal = {(r, c) for r, c, t in zip(pdf["r"], pdf["c"], pdf[target], strict=True) if t}
        heap = [(z[k], k) for k in {(r, c) for r, c, s in zip(pdf["r"], pdf["c"], pdf[sources], strict=True) if s} if k in z]
        heapq.heapify(heap)
        done, level = set(), None
        while heap:
            v, k = heapq.heappop(heap)
            if k in done:
                continue
            done.add(k)
            if k in goal:
                level = v
                break
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    m = (k[0] + i, k[1] + j)
                    if m in z and m not in done:
                        heapq.heappush(heap, (max(v, z[m]), m))
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] for b in by}, "saddle": [level]})

    types = dict(cells.dtypes)
    return cells.groupBy(*by).applyInPandas(flood, ", ".join(f"`{b}` {types[b]}" for b in by) + ", saddle double")


def fit_variogram(lags: list[float], gammas: list[float], counts: list[int], models: tuple[str, ...] = ("exponential",), shortest: float = 10.0, longest: float = 20_000.0, grid: int = 48, rounds: int = 40) -> dict:
    """Nugget, and a sill and range per model of a nested variogram, by least squares weighted with the counts; ranges ascend, no term is below 0.

    For given ranges the terms are linear: of all subsets of terms the best one without a negative term is taken. Ranges are searched on a
    geometric grid that closes in round by round.
    """
    from itertools import combinations, product

    import numpy as np

    h, g, w = (np.array(x, float) for x in (lags, gammas, counts))
    shapes = {"exponential": lambda x: np.exp(-x), "gaussian": lambda x: np.exp(-x * x), "spherical": lambda x: np.where(x < 1, (1 - x) ** 2 * (1 + x / 2), 0.0)}
    root = np.sqrt(w)

    def linear(ranges):
        a = np.stack([np.ones_like(h), *(1 - shapes[m](h / r) for m, r in zip(models, ranges, strict=True))], 1)
        best = (float((w * g * g).sum()), np.zeros(a.shape[1]))
        for size in range(1, a.shape[1] + 1):
            for some in map(list, combinations(range(a.shape[1]), size)):
                x = np.zeros(a.shape[1])
                x[some] = np.linalg.lstsq(a[:, some] * root[:, None], g * root, rcond=None)[0]
                if (x >= 0).all():
                    best = min(best, (float((w * (a @ x - g) ** 2).sum()), x), key=lambda y: y[0])
        return best

    each = grid if len(models) == 1 else 20
    axes = [np.geomspace(shortest, longest, each) for _ in models]
    ratio, best = (longest / shortest) ** (1 / (each - 1)), None
    for _ in range(rounds):
        for ranges in product(*axes):
            if any(a > b for a, b in zip(ranges, ranges[1:], strict=False)):
                continue
            loss, x = linear(ranges)
            if best is None or loss < best[0] - 1e-15:
                best = (loss, x, ranges)
        axes = [np.clip(r * ratio ** np.linspace(-1, 1, 9), shortest, longest) for r in best[2]]
        ratio **= 0.85
    return {"nugget": float(best[1][0]), "sills": [float(v) for v in best[1][1:]], "ranges": [float(r) for r in best[2]], "loss": best[0]}
