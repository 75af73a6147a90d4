"""Demand: trajectories, distribution over space and time, adoption, weights, clustering, validation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattspan.operators.metrics import ratio


def equal_weights(df: DataFrame, out: str = "weight") -> DataFrame:
    n = df.agg(F.count("*").alias("_n"))
    return df.join(F.broadcast(n)).withColumn(out, 1.0 / F.col("_n")).drop("_n")


def entropy_weights(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``criterion, weight``: criteria that differ more between rows weigh more. Values must not be negative."""
    totals = df.agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_t{i}") for i, c in enumerate(columns)))
    share = lambda i, c: ratio(F.col(c), F.col(f"_t{i}"))
    term = lambda i, c: F.when(share(i, c) > 0, share(i, c) * F.log(share(i, c))).otherwise(0.0)
    d = df.join(F.broadcast(totals)).agg(*((1 + F.sum(term(i, c)) / F.log(F.first("_n"))).alias(c) for i, c in enumerate(columns)))
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    cells = F.array(*(F.struct(F.lit(c).alias("criterion"), ratio(F.col(c), total).alias("weight")) for c in columns))
    return d.select(F.explode(cells).alias("e")).select("e.*")


def trajectory(spark: SparkSession, base: float, first_year: int, years: int, gdp_growth: float, elasticity: float, efficiency: float, electrification: float, saturation: float) -> DataFrame:
    """Annual demand: growth by elasticity, less efficiency, plus electrification that saturates."""
    rows, level, share = [], base, 0.0
    for k in range(years):
        rows.append((first_year + k, level * (1 + share)))
        level *= (1 + gdp_growth * elasticity) * (1 - efficiency)
        share += electrification * (1 - share / saturation) if saturation else 0.0
    return spark.createDataFrame(rows, "year int, demand double")


def sector_split(demand: DataFrame, shares: DataFrame, node: str, sector: str, share: str, mw: str) -> DataFrame:
    """Demand by sector with shares normalised by node; equal parts where they sum to nothing."""
    w = Window.partitionBy(node)
    total = F.sum(share).over(w)
    s = shares.withColumn("_s", F.when(total > 0, F.col(share) / total).otherwise(1.0 / F.count("*").over(w)))
    return demand.join(s.select(node, sector, "_s"), node).withColumn("sector_mw", F.col(mw) * F.col("_s")).drop("_s")


def hourly_from_annual(annual: DataFrame, shape: DataFrame, energy: str, keys: Sequence[str], weight: str) -> DataFrame:
    """Annual energy over hours by a shape's weights."""
    s = shape.withColumn("_s", F.col(weight) / F.sum(weight).over(Window.partitionBy(*keys)))
    return annual.join(s, list(keys)).withColumn("mw", F.col(energy) * F.col("_s")).drop("_s")


def techno_economic_adoption(payback_years: Column, ceiling: float = 1.0, sensitivity: float = 0.3) -> Column:
    return ceiling * F.exp(-sensitivity * payback_years)


def classify_building(area: Column, floors: Column) -> Column:
    return F.when((area < 250) & (floors <= 2), "residential").when(area < 1000, "commercial").when(area < 5000, "institutional").otherwise("industrial")


def wind_rose(df: DataFrame, direction: str, speed: str, sectors: int = 16) -> DataFrame:
    width = 360.0 / sectors
    sector = F.floor(F.pmod(F.col(direction) + width / 2, F.lit(360.0)) / width).cast("int")
    w = Window.partitionBy()
    out = df.groupBy(sector.alias("sector")).agg(F.count("*").alias("n"), F.avg(speed).alias("mean_speed"))
    return out.withColumn("frequency", F.col("n") / F.sum("n").over(w))


def expanding_folds(first: int, last: int, least: int, horizon: int = 1) -> list[tuple[int, int, int, int, int]]:
    """(fold, train from, train to, test from, test to) of an expanding time split."""
    return [(k, first, y - 1, y, min(last, y + horizon - 1)) for k, y in enumerate(range(first + least, last + 1, horizon))]


def resolution_metrics(df: DataFrame, keys: Sequence[str], t: str, observed: str, forecast: str, sizes: Sequence[int]) -> DataFrame:
    """R2, RMSE, MAE and MAPE of block means at several resolutions."""
    blocks = df.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).groupBy(*keys, "size", F.floor(F.col(t) / F.col("size")).alias("_b")).agg(F.avg(observed).alias("_o"), F.avg(forecast).alias("_f"))
    e = F.col("_f") - F.col("_o")
    spread = F.sum(F.col("_o") ** 2) - F.count("*") * F.avg("_o") ** 2
    return blocks.groupBy(*keys, "size").agg((1 - F.try_divide(F.sum(e * e), spread)).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (100 * F.avg(F.try_divide(F.abs(e), F.abs("_o")))).alias("mape"))


def weibull_moments(df: DataFrame, keys: Sequence[str], speed: str, steps: int = 60) -> DataFrame:
    """Shape and scale of a Weibull distribution by fixed-point likelihood, one group a task of sums.

    Groups are reduced to a histogram of 0.01 steps first, so that no task holds a group's rows.
    """
    x = F.round(F.col(speed), 2)
    counts = df.where(F.col(speed) > 0).groupBy(*keys, x.alias("_x")).agg(F.count("*").alias("_n")).where("_x > 0")

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        v, n = p["_x"].to_numpy(float), p["_n"].to_numpy(float)
        k, log = 2.0, np.log(v)
        for _ in range(steps):
            vk = v**k
            k = 1 / ((n * vk * log).sum() / (n * vk).sum() - (n * log).sum() / n.sum())
        scale = ((n * v**k).sum() / n.sum()) ** (1 / k)
        return p.iloc[:1][list(keys)].assign(shape=k, scale=scale)

    kinds = dict(df.dtypes)
    return counts.groupBy(*keys).applyInPandas(fit, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "shape double, scale double"]))


def kmeans_medoids(df: DataFrame, id_col: str, vector: str, k: int, seed: int = 1) -> DataFrame:
    """Cluster and medoid (the member nearest its centre, ties by id) of each row."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = df.select(id_col, F.col(vector).cast("array<double>").alias("_v")).withColumn("features", array_to_vector("_v"))
    model = KMeans(k=k, seed=seed, maxIter=30).fit(v)
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    c = F.array(*(F.array(*map(F.lit, row)) for row in centres))
    near = model.transform(v).withColumn("_c", F.element_at(c, F.col("prediction") + 1))
    d = F.aggregate(F.zip_with("_v", "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    rows = near.select(id_col, F.col("prediction").alias("cluster"), d.alias("_d"))
    medoid = rows.groupBy("cluster").agg(F.min(F.struct("_d", id_col)).alias("_m"), F.count("*").alias("size"))
    return rows.join(F.broadcast(medoid), "cluster").select(id_col, "cluster", F.col(f"_m.{id_col}").alias("medoid"), "size")


def pam(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Medoids and labels by build and swap over at most a few hundred points, until no swap helps."""
    square = (points**2).sum(1)
    d = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * points @ points.T, 0))
    np.fill_diagonal(d, 0)
    chosen = [int(d.sum(1).argmin())]
    while len(chosen) < k:
        now = d[:, chosen].min(1)
        gain = np.maximum(now[:, None] - d, 0).sum(0)
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
    best = d[:, chosen].min(1).sum()
    while True:
        moves = []
        for i in range(k):
            rest = [c for j, c in enumerate(chosen) if j != i]
            cost = np.minimum(d[:, rest].min(1)[:, None], d).sum(0) if rest else d.sum(0)
            cost[chosen] = np.inf
            moves.append((float(cost.min()), i, int(cost.argmin())))
        cost, i, h = min(moves, default=(math.inf, 0, 0))
        if not cost < best - 1e-12:
            return np.array(chosen), d[:, chosen].argmin(1)
        best, chosen[i] = cost, h


def typical_days(df: DataFrame, keys: Sequence[str], day: str, hour: str, value: str, k: int) -> DataFrame:
    """Representative days of each series by medoids of its daily profiles, with the days each stands for.

    A series has at most a few hundred days, so its profile matrix is one task's.
    """
    profiles = df.groupBy(*keys, day).agg(F.sort_array(F.collect_list(F.struct(F.col(hour).cast("int").alias("h"), F.col(value).cast("double").alias("v")))).alias("_p"))

    def choose(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(day, ignore_index=True)
        m = np.zeros((len(p), 24))
        for i, prof in enumerate(p["_p"]):
            for x in prof:
                m[i, x["h"]] += x["v"]
        z = (m - m.mean(0)) / np.where(m.std(0) > 0, m.std(0), 1)
        chosen, label = pam(z, min(k, len(p)))
        out = p.iloc[chosen][[*keys, day]].copy()
        out["weight"] = np.bincount(label, minlength=len(chosen)).astype(np.int64)
        return out

    kinds = dict(profiles.dtypes)
    return profiles.groupBy(*keys).applyInPandas(choose, ", ".join([*(f"{c} {kinds[c]}" for c in [*keys, day]), "weight bigint"]))


def density_clusters(points: DataFrame, id_col: str, lat: str, lon: str, km: float) -> DataFrame:
    """Clusters of points linked within ``km`` (every point is a core point): components of places, each place standing for its
    least point. Points without a place are clusters of their own; an id at several places links them."""
    from wattspan.operators.network import connected_components
    from wattspan.operators.places import is_place, near_places
    from wattspan.operators.stored import stored

    known = points.select(F.col(id_col).alias("node"), F.col(lat).alias("la"), F.col(lon).alias("lo"))
    placed = known.where(is_place(F.col("la"), F.col("lo")))
    places = stored(placed.groupBy("la", "lo").agg(F.min("node").alias("rep")), "cluster-places")
    other = places.select(F.col("la").alias("lb"), F.col("lo").alias("ln"), F.col("rep").alias("b"))
    near = near_places(places.withColumnRenamed("rep", "a"), other, km).where("a < b").select("a", "b")
    member = stored(known.join(places, ["la", "lo"], "left").groupBy("node").agg(F.collect_set("rep").alias("reps")), "cluster-points")
    same = member.where("size(reps) > 1").select(F.array_min("reps").alias("a"), F.explode("reps").alias("b"))
    found = connected_components(near.unionByName(same), places.select(F.col("rep").alias("node")))
    roots = found.select(F.col("node").alias("rep"), "component")
    return member.select("node", F.array_min("reps").alias("rep")).join(roots, "rep", "left").select("node", F.coalesce("component", "node").alias("component"))


def _squared(columns: Sequence[str], centre: Sequence[float]) -> Column:
    out = F.lit(0.0)
    for c, v in zip(columns, centre, strict=True):
        out = out + (F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v)))
    return out


def farthest_first(points: DataFrame, id_col: str, columns: Sequence[str], k: int) -> list[tuple[float, ...]]:
    """``k`` seeds: the point of least id, then always the point farthest from all seeds (ties by id); fewer if points repeat.
    A seed is one pass without a shuffle of points, and the driver holds ``k`` points."""
    at = F.struct(*[F.col(c).cast("double").alias(c) for c in columns])
    first = points.agg(F.min_by(at, id_col)).first()[0]
    seeds = [] if first is None else [tuple(first)]
    while seeds and len(seeds) < k:
        apart = [_squared(columns, s) for s in seeds]
        far = F.least(*apart) if len(apart) > 1 else apart[0]
        best = points.agg(F.max(F.struct(far.alias("d"), (-F.col(id_col)).alias("i"), at.alias("p")))).first()[0]
        if best["d"] <= 0:
            break
        seeds.append(tuple(best["p"]))
    return seeds


def inertias(points: DataFrame, id_col: str, columns: Sequence[str], min_k: int, max_k: int, rounds: int = 10) -> list[tuple[int, float]]:
    """``(k, sum of squared distances to the nearest of k centres)`` for all k at once.

    The first k seeds serve k, so one set of seeds serves all. Every round of moving centres to their members' means, and the
    last sum, is one pass over the points for all k together; what is grouped is k and the centre, not points.
    """
    points = points.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    seeds = farthest_first(points, id_col, columns, max_k)
    centres = {k: list(seeds[:k]) for k in range(min_k, min(max_k, len(seeds)) + 1)}
    nearest_of = lambda cs: F.least(*[F.struct(_squared(columns, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(cs)]) if len(cs) > 1 else F.struct(_squared(columns, cs[0]).alias("d"), F.lit(0).alias("i"))
    for _ in range(rounds if centres else 0):
        every = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), nearest_of(cs)["i"].alias("i")) for k, cs in centres.items()])).alias("s")
        moved = points.select(*columns, every).groupBy("s.k", "s.i").agg(*[F.avg(c).alias(c) for c in columns]).collect()  # a row a k and a centre
        new = {k: list(cs) for k, cs in centres.items()}
        for r in moved:
            new[r["k"]][r["i"]] = tuple(r[c] for c in columns)
        if new == centres:
            break
        centres = new
    if not centres:
        return []
    total = points.agg(*[F.sum(nearest_of(cs)["d"]).alias(f"k{k}") for k, cs in centres.items()]).first()
    return [(k, total[f"k{k}"]) for k in centres]


def elbow(curve: Sequence[tuple[int, float]]) -> int | None:
    """The k whose inertia lies farthest from the chord between the first and the last, both axes scaled to [0, 1]."""
    if len(curve) < 3:
        return curve[0][0] if curve else None
    (k0, y0), (k1, y1) = curve[0], curve[-1]
    scaled = [((k - k0) / max(k1 - k0, 1e-12), (y - y1) / max(y0 - y1, 1e-12)) for k, y in curve]
    dx, dy = scaled[-1][0] - scaled[0][0], scaled[-1][1] - scaled[0][1]
    apart = [abs(dy * (x - scaled[0][0]) - dx * (y - scaled[0][1])) / math.hypot(dx, dy) for x, y in scaled]
    return curve[apart.index(max(apart))][0]
