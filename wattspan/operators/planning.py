"""Capacity planning: vintages, adequacy, investment cost, alternatives, global sensitivity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cumulative_capacity(vintages: DataFrame, keys: Sequence[str], vintage: str, mw: str, years: tuple[int, int], life: int, degradation: float = 0.0) -> DataFrame:
    """Capacity in service each year: what was built in the last ``life`` years, less wear by age.

    A vintage is spread over the years it serves, so it is one pass and one aggregate, not a self-join.
    """
    first, last = F.greatest(F.col("_v"), F.lit(years[0])), F.least(F.col("_v") + life - 1, F.lit(years[1]))
    built = vintages.select(*keys, F.col(vintage).alias("_v"), F.col(mw).alias("_mw")).where(first <= last)
    serving = built.withColumn("year", F.explode(F.sequence(first, last)))
    return serving.groupBy(*keys, "year").agg(F.sum(F.col("_mw") * F.pow(F.lit(1.0 - degradation), F.col("year") - F.col("_v"))).alias("capacity"))


def adequacy(capacity: DataFrame, demand_peak: Column, growth: float, margin: float, first_year: int, credit: Column) -> DataFrame:
    """Firm capacity against grown peak with a margin."""
    firm = F.sum(F.col("capacity") * credit)
    need = F.first(demand_peak) * F.pow(F.lit(growth), F.col("year") - first_year) * margin
    return capacity.groupBy("year").agg(firm.alias("firm"), need.alias("required")).withColumn("adequate", F.col("firm") >= F.col("required"))


def investment_cost(df: DataFrame, keys: Sequence[str], mw: str, cost: str, year: str, first_year: int, rate: float) -> DataFrame:
    """Overnight cost, discounted from the first year."""
    return df.groupBy(*keys).agg(F.sum(F.col(mw) * F.col(cost) / F.pow(F.lit(1 + rate), F.col(year) - first_year)).alias("npv"))


def incremental_peak(df: DataFrame, keys: Sequence[str], year: str, value: str) -> DataFrame:
    """How far each year's value is above all earlier ones."""
    before = F.max(value).over(Window.partitionBy(*keys).orderBy(year).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("increment", F.greatest(F.lit(0.0), F.col(value) - F.coalesce(before, F.lit(0.0))))


def re_targets(first: float, final: float, years: int, least_step: float, most_step: float) -> list[float]:
    """Yearly targets from ``first`` towards ``final``, each step within bounds and never past the end."""
    out = [first]
    for k in range(1, years):
        step = (final - out[-1]) / (years - k)
        out.append(min(final, out[-1] + min(most_step, max(least_step, step))))
    return out


def vintage_schedule(df: DataFrame, keys: Sequence[str], year: str, amount: Column, shares: Sequence[float]) -> DataFrame:
    """Each tranche's yearly parts, summed over tranches: depreciation, or debt service of equal shares."""
    table = F.array(*(F.lit(float(s)) for s in shares))
    rows = df.select(*keys, F.col(year).alias("_v"), amount.alias("_a"), F.posexplode(table).alias("_k", "_s"))
    return rows.groupBy(*keys, (F.col("_v") + F.col("_k")).alias("year")).agg(F.sum(F.col("_a") * F.col("_s")).alias("amount"))


def mga_scores(df: DataFrame, key: Sequence[str], invested: str, threshold: float = 0.1) -> DataFrame:
    """``1 - 2 f``: how rarely alternatives invest."""
    return df.groupBy(*key).agg((1 - 2 * F.avg((F.col(invested) > threshold).cast("double"))).alias("score"))


def mga_statistics(df: DataFrame, key: Sequence[str], value: str, robust: float = 0.1) -> DataFrame:
    """Spread of a decision across alternatives; robust where it hardly varies, flexible where it may be left out."""
    x = F.col(value)
    out = df.groupBy(*key).agg(F.min(x).alias("low"), F.max(x).alias("high"), F.percentile(x, F.lit(0.5)).alias("median"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    cv = F.when(F.col("mean") != 0, F.col("std") / F.abs("mean")).otherwise(0.0)
    return out.withColumn("cv", cv).withColumn("robust", F.col("cv") <= robust).withColumn("flexible", F.col("low") <= 1e-6)


def l1_distance(df: DataFrame, alternative: str, key: Sequence[str], value: str, reference: str) -> DataFrame:
    """Mean distance of each alternative from the reference, each decision scaled to its range."""
    w = Window.partitionBy(*key)
    base = F.max(F.when(F.col(alternative) == reference, F.col(value))).over(w)
    span = F.max(value).over(w) - F.min(value).over(w)
    d = F.when(span > 0, F.abs(F.col(value) - base) / span).otherwise(0.0)
    return df.withColumn("_d", d).groupBy(alternative).agg(F.avg("_d").alias("distance"))


def sample_matrix(n: int, dims: int, seed: int = 0) -> np.ndarray:
    """Rows of A, B and each A with a column of B: ``n (dims + 2)`` points of a scrambled radical-inverse sequence."""
    primes = [p for p in range(2, 1000) if all(p % q for q in range(2, int(p**0.5) + 1))][: 2 * dims]
    rng = np.random.default_rng(seed)
    base = np.empty((n, 2 * dims))
    for j, p in enumerate(primes):
        k, f, x = np.arange(1, n + 1), 1.0 / p, np.zeros(n)
        while k.any():
            x += f * (k % p)
            k //= p
            f /= p
        base[:, j] = (x + rng.random()) % 1
    a, b = base[:, :dims], base[:, dims:]
    mixed = [np.where(np.arange(dims) == j, b, a) for j in range(dims)]
    return np.concatenate([a, b, *mixed])


def sobol_indices(df: DataFrame, base: str, block: str, y: str, dims: int) -> DataFrame:
    """First-order and total effects of each dimension from outputs of the sample blocks.

    ``block`` is -2 for A, -1 for B, ``j`` for A with B's column ``j``; ``base`` numbers the points. One
    pivot by point, then one aggregate. Without variance effects are 0.
    """
    wide = df.groupBy(base).pivot(block, [-2, -1, *range(dims)]).agg(F.first(y)).withColumnsRenamed({"-2": "a", "-1": "b"})
    n = F.count("*")
    mean = (F.sum("a") + F.sum("b")) / (2 * n)
    variance = (F.sum(F.col("a") ** 2) + F.sum(F.col("b") ** 2)) / (2 * n) - mean * mean
    parts = [F.struct(F.lit(j).alias("dim"), F.when(variance > 0, F.avg(F.col("b") * (F.col(str(j)) - F.col("a"))) / variance).otherwise(0.0).alias("s1"), F.when(variance > 0, F.avg((F.col("a") - F.col(str(j))) ** 2) / (2 * variance)).otherwise(0.0).alias("st")) for j in range(dims)]
    return wide.agg(F.array(*parts).alias("_p")).select(F.explode("_p").alias("_e")).select("_e.*")


def matrix_frame(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """A sample matrix as rows ``row, dim, value``."""
    rows = [(i, j, float(v)) for i, r in enumerate(matrix) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "row int, dim int, value double")


def grown_limit(limit: Column, kind: Column, year: Column, base_year: int, growth: float = 0.5, grows: Sequence[str] = ("Renewable", "Storage")) -> Column:
    """A limit on investment that grows by year for some kinds of units."""
    return F.when(kind.isin(*grows), limit * F.pow(F.lit(1 + growth), year - base_year)).otherwise(limit)


def transmission_trend(cost: Column, most: Column, year: Column, base_year: int, reduction: float = 0.03, growth: float = 0.5) -> tuple[Column, Column]:
    """Cost and limit of transmission by year."""
    return cost * F.pow(F.lit(1 - reduction), year - base_year), most * F.pow(F.lit(1 + growth), year - base_year)


def after_retirements(units: DataFrame, retired: DataFrame, on: Sequence[str], capacity: str, mw: str) -> DataFrame:
    """Capacity less what is retired, never below 0."""
    gone = retired.groupBy(*on).agg(F.sum(mw).alias("_gone"))
    return units.join(gone, list(on), "left").withColumn(capacity, F.greatest(F.lit(0.0), F.col(capacity) - F.coalesce("_gone", F.lit(0.0)))).drop("_gone")


def budget_slack(spent: DataFrame, keys: Sequence[str], cost: str, budget: Column) -> DataFrame:
    """What each key spends above its budget."""
    return spent.groupBy(*keys).agg(F.sum(cost).alias("spent")).withColumn("slack", F.greatest(F.lit(0.0), F.col("spent") - budget))


def investment_bounds(power: Column, energy: Column, most: Column, least_hours: float, most_hours: float) -> Column:
    """``ok``, or the first bound that an investment breaks: the limit on power, or hours of storage out of range."""
    return F.when(power > most, "above limit").when(energy < least_hours * power, "too few hours").when(energy > most_hours * power, "too many hours").otherwise("ok")


def scenario_multiplier(base: Column, growth: Column, year_index: Column) -> Column:
    """A parameter that grows by year from the first on."""
    return base * F.pow(growth, year_index - 1)


def kpi_by_prefix(solution: DataFrame, prefixes: Sequence[str], variable: str, value: str) -> DataFrame:
    """Sum of a solution's values by the prefix of the variable's name; the longest prefix that fits counts."""
    kpi = F.lit(None).cast("string")
    for p in sorted(prefixes, key=len):
        kpi = F.when(F.col(variable).startswith(p), F.lit(p)).otherwise(kpi)
    return solution.withColumn("kpi", kpi).where("kpi IS NOT NULL").groupBy("kpi").agg(F.sum(value).alias("total"))


def projection(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """The first two principal components of z-scored columns; of each the greatest loading is positive.

    Sums of products are one aggregate; the covariance matrix is as large as the number of columns.
    """
    sums = df.agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)), *(F.sum(F.col(a).cast("double") * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j)).first()
    n, k = max(1, sums["n"]), len(columns)
    mean = np.array([(sums[f"s{i}"] or 0.0) / n for i in range(k)])
    cov = np.array([[(sums[f"p{min(i, j)}_{max(i, j)}"] or 0.0) / n - mean[i] * mean[j] for j in range(k)] for i in range(k)])
    std = np.sqrt(np.maximum(np.diag(cov), 0))
    std[std == 0] = 1
    values, vectors = np.linalg.eigh(cov / np.outer(std, std))
    top = vectors[:, np.argsort(-values)[:2]]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), range(top.shape[1])])
    axis = lambda m: sum(((F.col(c) - float(mean[i])) / float(std[i]) * float(top[i, m]) for i, c in enumerate(columns)), F.lit(0.0))
    return df.select(id_col, axis(0).alias("pc1"), axis(1).alias("pc2") if k > 1 else F.lit(0.0).alias("pc2"))


def pca_weights(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``criterion, weight``: shares of the first principal component's absolute loadings."""
    row = df.agg(*(F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j)).first()
    k = len(columns)
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    first = np.abs(np.linalg.eigh(cov)[1][:, -1])
    rows = [(c, float(w)) for c, w in zip(columns, first / first.sum(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "criterion string, weight double")


def pairwise_distance(df: DataFrame, alternative: str, key: Sequence[str], value: str) -> DataFrame:
    """Euclidean distance of each two alternatives over the decisions that either has: a join by decision, for a few hundred alternatives."""
    left = df.select(F.col(alternative).alias("a"), *key, F.col(value).alias("_x"))
    right = df.select(F.col(alternative).alias("b"), *key, F.col(value).alias("_y"))
    square = df.groupBy(alternative).agg(F.sum(F.col(value) * F.col(value)).alias("_q"))
    dot = left.join(right, list(key)).where("a < b").groupBy("a", "b").agg(F.sum(F.col("_x") * F.col("_y")).alias("_p"))
    both = dot.join(square.select(F.col(alternative).alias("a"), F.col("_q").alias("_qa")), "a").join(square.select(F.col(alternative).alias("b"), F.col("_q").alias("_qb")), "b")
    return both.select("a", "b", F.sqrt(F.greatest(F.lit(0.0), F.col("_qa") + F.col("_qb") - 2 * F.col("_p"))).alias("distance"))


def average_linkage(distance: np.ndarray, clusters: int) -> np.ndarray:
    """Labels of points by joining the two clusters of least mean distance until so many are left."""
    label = np.arange(len(distance))
    while len(names := np.unique(label)) > max(1, clusters):
        mean, a, b = min((distance[np.ix_(label == p, label == q)].mean(), p, q) for i, p in enumerate(names) for q in names[i + 1 :])
        label[label == b] = a
    return np.unique(label, return_inverse=True)[1]
