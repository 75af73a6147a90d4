"""Hazards, adequacy and resilience."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspan.operators.metrics import ratio
from wattspan.operators.quantiles import exact_quantiles
from wattspan.operators.stored import stored


def combine_independent(df: DataFrame, keys: Sequence[str], probability: str) -> DataFrame:
    """``1 - prod(1 - p)``, the mean and the greatest."""
    p = F.col(probability)
    return df.groupBy(*keys).agg((1 - F.product(1 - p)).alias("combined"), F.avg(p).alias("mean"), F.max(p).alias("worst"))


def expected_annual_loss(df: DataFrame, keys: Sequence[str], return_period: str, loss: str) -> DataFrame:
    """Sum of losses times widths of annual probability, in ascending return period.

    The width of a point is its probability less the next one's; the second takes the first's width, and
    nothing is added beyond the last.
    """
    w = Window.partitionBy(*keys).orderBy(return_period)
    p = 1.0 / F.col(return_period)
    rows = df.withColumn("_p", p).withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead("_p").over(w)).withColumn("_prev", F.lag("_p").over(w))
    width = F.when(F.col("_k") == 1, F.col("_p") - F.col("_next")).otherwise(F.col("_prev") - F.col("_p"))
    return rows.groupBy(*keys).agg(F.sum(F.col(loss) * F.coalesce(width, F.lit(0.0))).alias("eal"))


def alarp(probability: Column, unacceptable: float = 1e-3, acceptable: float = 1e-5) -> Column:
    return F.when(probability >= unacceptable, "unacceptable").when(probability >= acceptable, "tolerable").otherwise("acceptable")


def minimax_regret(df: DataFrame, option: str, scenario: str, cost: str) -> DataFrame:
    """Greatest regret of each option over scenarios, the least first."""
    best = F.min(cost).over(Window.partitionBy(scenario))
    return df.withColumn("_r", F.col(cost) - best).groupBy(option).agg(F.max("_r").alias("regret"))


def loss_of_load(states: DataFrame, keys: Sequence[str], probability: str, capacity: str, demand: str, hours: float = 8760.0) -> DataFrame:
    """Loss-of-load probability and hours, expected unserved energy, by capacity states."""
    short = F.greatest(F.lit(0.0), F.col(demand) - F.col(capacity))
    return states.groupBy(*keys).agg(F.sum(F.when(short > 0, F.col(probability)).otherwise(0.0)).alias("lolp"), (F.sum(F.when(short > 0, F.col(probability)).otherwise(0.0)) * hours).alias("lole"), (F.sum(F.col(probability) * short) * hours).alias("eens"))


def resilience_index(df: DataFrame, keys: Sequence[str], t: str, performance: str) -> DataFrame:
    """Area under performance over the area at full performance, by trapezoids."""
    w = Window.partitionBy(*keys).orderBy(t)
    step = F.col(t) - F.lag(t).over(w)
    area = (F.col(performance) + F.lag(performance).over(w)) / 2 * step
    return df.withColumn("_a", area).withColumn("_d", step).groupBy(*keys).agg(ratio(F.sum("_a"), F.sum("_d")).alias("resilience"))


def scenario_tree(stages: list[DataFrame], most: int) -> DataFrame:
    """Products of independent stages (``name``, ``probability``), the likeliest ``most``, renormalised.

    Stages are small tables of outcomes; what is kept after each is bounded by ``most``.
    """
    tree = None
    for s in stages:
        part = s.select(F.col("name").alias("_n"), F.col("probability").alias("_p"))
        if tree is None:
            tree = part.select(F.col("_n").alias("path"), F.col("_p").alias("probability"))
        else:
            tree = tree.join(F.broadcast(part)).select(F.concat_ws("/", "path", "_n").alias("path"), (F.col("probability") * F.col("_p")).alias("probability"))
        tree = tree.orderBy(F.desc("probability"), "path").limit(most)
    return tree.withColumn("probability", F.col("probability") / F.sum("probability").over(Window.partitionBy()))


def gumbel_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Location and scale of annual maxima by moments."""
    scale = F.stddev_samp(value) * (6**0.5) / 3.141592653589793
    return df.groupBy(*keys).agg(scale.alias("scale"), (F.avg(value) - 0.5772156649015329 * scale).alias("location"))


def return_level(location: Column, scale: Column, period: float) -> Column:
    return location - scale * F.log(-F.log(F.lit(1 - 1 / period)))


def robust_normalised(df: DataFrame, value: str, out: str = "normalised", low: float = 0.05, high: float = 0.95) -> DataFrame:
    """To [0, 1] between two percentiles of the positive values; 0 where a value is not positive, or all are alike."""
    found = exact_quantiles(df.where(F.col(value) > 0), [], value, [low, high]).first()  # two numbers
    lo, hi = found["quantiles"] if found and found["quantiles"] else (None, None)
    if lo is None or not hi > lo:
        return df.withColumn(out, F.lit(0.0))
    return df.withColumn(out, F.when(F.col(value) > 0, (F.least(F.greatest(F.col(value), F.lit(lo)), F.lit(hi)) - lo) / (hi - lo)).otherwise(0.0))


def unit_risk(units: DataFrame, profiles: DataFrame, node: str, risk: str, share: float) -> DataFrame:
    """Coefficient of each unit: 1 less a share of its node's composite risk; 1 where none is known."""
    return units.join(profiles.select(node, F.col(risk).alias("_r")), node, "left").withColumn("coefficient", 1 - share * F.coalesce("_r", F.lit(0.0))).drop("_r")


def hazard_strata(df: DataFrame, keys: Sequence[str], intensity: str, tie: str, strata: int) -> DataFrame:
    """Scenarios of equal probability: of each key's ordered intensities, the mean of each of ``strata`` parts."""
    part = F.ntile(strata).over(Window.partitionBy(*keys).orderBy(intensity, tie))
    return df.withColumn("stratum", part).groupBy(*keys, "stratum").agg(F.avg(intensity).alias("intensity"), F.count("*").alias("n")).withColumn("probability", F.lit(1.0 / strata))


def resilience_metrics(scenarios: DataFrame, keys: Sequence[str], probability: str, recovery: str, damage: str) -> DataFrame:
    """Mean recovery time, the share of scenarios with damage below a half, and the longest recovery."""
    return scenarios.groupBy(*keys).agg(F.sum(F.col(probability) * F.col(recovery)).alias("sart"), F.avg((F.col(damage) < 0.5).cast("double")).alias("redundancy"), F.max(recovery).alias("rto"))


def weighted_index(df: DataFrame, layers: dict[str, float]) -> Column:
    """Composite of normalised layers by weights that are normalised first."""
    total = sum(layers.values())
    return sum((F.col(c) * (w / total) for c, w in layers.items()), F.lit(0.0))


#: Drawn rows in a task.
DRAWN = 200_000


def sampled_annual_loss(df: DataFrame, keys: Sequence[str], value: str, median: str, intensity: str, beta: float, draws: int, seed: int = 42) -> DataFrame:
    """Mean and 95th percentile of annual loss over draws of fragility medians, lognormal around each; the draw is a hash of the
    row's keys and the draw's number, so it does not depend on partitions."""
    from wattspan.functions.scalar import normal_cdf
    from wattspan.operators.stored import spread

    rows = spread(df, DRAWN // draws + 1).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = lambda k: (F.pmod(F.xxhash64(*keys, "draw", F.lit(seed), F.lit(k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    z = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * 3.141592653589793 * u(2))
    p = normal_cdf((F.log(F.col(intensity)) - F.log(F.col(median)) - 0.3 * z) / beta)
    loss = rows.groupBy(*keys, "draw").agg(F.sum(F.col(value) * p).alias("_l"))
    return loss.groupBy(*keys).agg(F.avg("_l").alias("mean"), F.percentile("_l", F.lit(0.95)).alias("p95"))


def normal_cdf_exact(z: Column) -> Column:
    """Standard normal distribution to double precision."""
    # Hart's rational approximation of 1968 (the published algorithm 5666).
    top = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
    low = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
    x = F.abs(z)

    def poly(coefficients: Sequence[float]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    tail = x
    for k in (0.65, 4, 3, 2, 1):
        tail = x + k / tail if k != 0.65 else x + 0.65
    upper = F.exp(-x * x / 2) * F.when(x < 7.07106781186547, poly(top) / poly(low)).otherwise(1 / (tail * 2.506628274631))
    return F.when(x > 37, F.when(z > 0, 1.0).otherwise(0.0)).when(z > 0, 1 - upper).otherwise(upper)


def normal_quantile(p: Column) -> Column:
    """The normal quantile of 0 < p < 1: a rational start and two Halley steps on ``normal_cdf_exact``."""
    # Acklam's published coefficients for the middle and the tails.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def poly(coefficients: Sequence[float], x: Column) -> Column:
        out = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * x + k
        return out

    q = p - 0.5
    edge = lambda s: poly(c, F.sqrt(-2 * F.log(s))) / poly(d, F.sqrt(-2 * F.log(s)))
    x = F.when(p < 0.02425, edge(p)).when(p > 1 - 0.02425, -edge(1 - p)).otherwise(q * poly(a, q * q) / poly(b, q * q))

    def refined(v: Column) -> Column:
        u = lambda w: w - _once((normal_cdf_exact(w) - p) * 2.5066282746310002 * F.exp(w * w / 2), lambda e: e / (1 + w * e / 2))
        return _once(v, u)

    return refined(refined(x))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def combine_gaussian(df: DataFrame, keys: Sequence[str], probability: str, rho: float = 0.3, step: float = 0.2) -> DataFrame:
    """``1 - P(nothing fails)`` of hazards whose normal scores have one correlation ``rho`` with each other.

    Given the common factor, hazards are independent, so what is left is one integral over it: the trapezoid rule
    from -9 to 9, as literals, which is exact to 1e-12 for a normal weight (91 nodes also for hundreds of hazards). Per group only a sum of logarithms for each node is kept, whatever the
    number of hazards. Probabilities beyond [0, 1] count as its ends; nulls are no hazards.
    """
    at = [step * i for i in range(-round(9 / step), round(9 / step) + 1)]
    factors = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(step * math.exp(-m * m / 2) / math.sqrt(2 * math.pi)).alias("w")) for m in at])
    p = F.col("_p")
    # Equal probabilities are one row with a count: the quantile is taken once each.
    distinct = df.where(F.col(probability).isNotNull()).groupBy(*keys, F.col(probability).cast("double").alias("_p")).agg(F.count("*").alias("_k"))
    scored = distinct.withColumn("_z", F.when((p > 0) & (p < 1), normal_quantile(p)))
    spread = scored.withColumn("_f", F.explode(factors))
    stays = normal_cdf_exact((F.lit(rho**0.5) * F.col("_f.m") - F.col("_z")) / (1 - rho) ** 0.5)
    log_stays = F.when(p >= 1, F.lit(float("-inf"))).when(p <= 0, F.lit(0.0)).otherwise(F.log(stays))
    at_node = spread.groupBy(*keys, "_f").agg(F.sum(F.col("_k") * log_stays).alias("_s"))
    return at_node.groupBy(*keys).agg((1 - F.sum(F.col("_f.w") * F.exp("_s"))).alias("combined"))


def gumbel_likelihood(df: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-11, most: int = 100) -> DataFrame:
    """``keys, n, location, scale, gradient`` of annual maxima by greatest likelihood.

    Newton's rounds for the scale: each is one sum over the values of all groups at once, and the driver sees one number,
    the greatest residual. Rounds start from the moments. Groups of fewer than three values have their greatest
    as location and no scale; groups without spread have their value.
    """
    rows = stored(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x")), "maxima")
    base = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_x").alias("_mean"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.stddev_samp("_x").alias("_sd"))
    fits = (F.col("n") >= 3) & (F.col("_max") > F.col("_min"))
    state = stored(base.where(fits).withColumn("_b", F.col("_sd") * 6**0.5 / 3.141592653589793), "gumbel")
    same = [F.col(f"_s.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys]
    for _ in range(most):
        joined = rows.alias("_r").join(state.alias("_s"), same)
        far = F.col("_r._x") - F.col("_s._min")
        e = F.exp(-far / F.col("_s._b"))
        sums = joined.groupBy(*[F.col(f"_s.{k}").alias(k) for k in keys]).agg(*[F.first(F.col(f"_s.{c}")).alias(c) for c in ("n", "_mean", "_min", "_max", "_sd", "_b")], F.sum(e).alias("_s0"), F.sum(far * e).alias("_s1"), F.sum(far * far * e).alias("_s2"))
        ratio_ = F.col("_s1") / F.col("_s0")
        residual = F.col("_b") - (F.col("_mean") - F.col("_min")) + ratio_
        slope = 1 + (F.col("_s2") / F.col("_s0") - ratio_ * ratio_) / (F.col("_b") * F.col("_b"))
        step = stored(sums.withColumn("_f", residual / F.col("_b")).withColumn("_next", F.greatest(F.col("_b") - residual / slope, F.col("_b") / 4)), "gumbel")
        worst = step.agg(F.max(F.abs("_f"))).first()[0]
        if worst is None or worst < tolerance:
            break
        state = step.drop("_s0", "_s1", "_s2", "_f", "_b").withColumnRenamed("_next", "_b")
    else:
        raise RuntimeError("the likelihood has not converged")
    fitted = step.select(*keys, "n", (F.col("_min") - F.col("_b") * F.log(F.col("_s0") / F.col("n"))).alias("location"), F.col("_b").alias("scale"), F.col("_f").alias("gradient"))
    rest = base.where(~fits).select(*keys, "n", F.col("_max").alias("location"), F.lit(0.0).alias("scale"), F.lit(0.0).alias("gradient"))
    return fitted.unionByName(rest)
