"""Adoption of electric vehicles and rooftop systems, climate adjustments, bias correction."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspan.functions import scalar as sc
from wattspan.operators.quantiles import exact_quantiles

#: Points at which distributions are matched.
QUANTILES = 101


def fleet(years: DataFrame, year: str, ceiling: float, rate: float, midpoint: float) -> DataFrame:
    """Vehicles by year on a logistic curve."""
    return years.withColumn("vehicles", sc.logistic(F.col(year), ceiling, rate, midpoint))


def charging_profile(fleet_size: Column, kwh_a_day: float, hour: Column, peak: float, width: float) -> Column:
    """MW by hour: a day's energy under a bell around the peak hour, which wraps at midnight."""
    apart = F.abs(F.pmod(hour - peak + 12, F.lit(24.0)) - 12)
    weight = F.exp(-(apart**2) / (2 * width**2))
    norm = sum(math.exp(-((abs((h - peak + 12) % 24 - 12)) ** 2) / (2 * width**2)) for h in range(24))
    return fleet_size * kwh_a_day / 1000 * weight / norm


def v2g_available(vehicles: Column, plugged: Column, participation: float, kw: float, reserve: float) -> Column:
    """MW that parked vehicles can give above the charge they keep."""
    return vehicles * plugged * participation * kw * (1 - reserve) / 1000


def v2g_payment(price: Column, share: float = 0.85) -> Column:
    return price * share


def price_shape(hour: Column, base: float, peaks: Sequence[tuple[float, float, float]]) -> Column:
    """A base price with bells: (hour, height, width)."""
    out = F.lit(base)
    for at, height, width in peaks:
        out = out + height * F.exp(-((hour - at) ** 2) / (2 * width**2))
    return out


def rooftop_cf(irradiance: Column, air: Column, noct: float = 45.0, coefficient: float = -0.004, performance: float = 0.85) -> Column:
    cell = sc.cell_temperature(air, irradiance, noct)
    return F.greatest(F.lit(0.0), irradiance / 1000 * sc.temperature_derate(cell, coefficient) * performance)


def clearness(global_horizontal: Column, extraterrestrial: Column) -> Column:
    return F.when(extraterrestrial > 0, F.least(F.lit(1.0), global_horizontal / extraterrestrial)).otherwise(0.0)


def climate_demand(mw: Column, temperature: Column, heat: float, cool: float, heat_base: float = 18.0, cool_base: float = 24.0) -> Column:
    """Demand with so many shares more for each degree below or above the bases."""
    hdd, cdd = sc.degree_days(temperature, heat_base, cool_base)
    return mw * (1 + heat * hdd + cool * cdd)


def quantile_map(model: DataFrame, observed: DataFrame, keys: Sequence[str], value: str, out: str = "corrected") -> DataFrame:
    """Each model value moved to the observed value of the same rank, linear between ``QUANTILES`` points.

    Quantiles are exact, of each side by keys; a value beyond the model's range takes the change
    at its end. The table of quantiles has a row for each key.
    """
    probs = [i / (QUANTILES - 1) for i in range(QUANTILES)]
    q = lambda df, name: exact_quantiles(df, keys, value, probs, name)
    table = q(model, "_m").join(q(observed, "_o"), list(keys))
    joined = model.join(table, list(keys))
    v = F.col(value)
    # The last point that is not above the value; points are in order.
    k = F.greatest(F.lit(1), F.least(F.lit(QUANTILES - 1), F.size(F.filter("_m", lambda x: x <= v))))
    m0, m1, o0, o1 = (F.element_at(c, k + i) for c in ("_m", "_o") for i in (0, 1))
    inside = F.when(m1 > m0, o0 + (o1 - o0) * (v - m0) / (m1 - m0)).otherwise(o0)
    low, high = F.element_at("_m", 1), F.element_at("_m", QUANTILES)
    mapped = F.when(v <= low, v + F.element_at("_o", 1) - low).when(v >= high, v + F.element_at("_o", QUANTILES) - high).otherwise(inside)
    return joined.withColumn(out, mapped).drop("_m", "_o")


def five_day_heat(df: DataFrame, keys: Sequence[str], day: str, temperature: str) -> DataFrame:
    """Mean temperature of the day and the four before."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(-4, 0)
    return df.withColumn("heat", F.avg(temperature).over(w))


#: Weights of the three parts of a household's utility, and its threshold.
ECONOMIC, SOCIAL, AWARE, THRESHOLD = 0.5, 0.3, 0.2, 0.5


def draw(key: Column, year: Column, run: Column, salt: int) -> Column:
    """A number in (0, 1) from integers alone: the same wherever and whenever it is computed."""
    a = F.pmod(key * 7919 + year * 104729 + run * 1299709 + salt * 15485863, F.lit(2147483647))
    b = F.pmod(a * 48271, F.lit(2147483647))
    return (F.pmod(b * 16807, F.lit(2147483647)) + 0.5) / 2147483648.0


def normal_draw(key: Column, year: Column, run: Column, salt: int, spread: float) -> Column:
    """A normal number by two draws."""
    return spread * F.sqrt(-2 * F.log(draw(key, year, run, salt))) * F.cos(2 * math.pi * draw(key, year, run, salt + 1))


def economic_utility(rate: Column, cost: Column, tariff: Column, kwh: float, life: int) -> Column:
    """How far a tariff lies above the cost of own energy at a household's discount rate, on a logistic scale."""
    annuity = rate * F.pow(1 + rate, life) / (F.pow(1 + rate, life) - 1)
    return 1 / (1 + F.exp(-10 * (tariff - cost * annuity / kwh)))


def adoption_rounds(agents: DataFrame, agent: str, rate: str, lat: str, lon: str, years: Sequence[int], runs: int, cost: float, tariff: float, km: float, cost_fall: float = 0.04, tariff_rise: float = 0.0, kwh: float = 1280.0, life: int = 25) -> DataFrame:
    """``run, agent, year``: the year in which each household adopts in each run, null if it never does.

    A household adopts when the weighted sum of its economic utility, the share of its neighbours (within ``km``, itself included)
    that had adopted the year before, and awareness with noise exceeds a noisy threshold. A year is one round: adopters so far are
    counted by place and summed over the places near each, of all runs at once. Draws are functions of household, year and run,
    so neither partitions nor lost executors change the result. ``agent`` is an integer.
    """
    from wattspan.operators.places import is_place, near_places
    from wattspan.operators.stored import stored

    people = agents.select(F.col(agent).cast("long").alias("agent"), F.col(rate).alias("_rate"), F.col(lat).alias("la"), F.col(lon).alias("lo"))
    at = stored(people.where(is_place(F.col("la"), F.col("lo"))).groupBy("la", "lo").agg(F.min("agent").alias("_place"), F.count("*").alias("_n")), "adoption-places")
    there = at.select(F.col("la").alias("lb"), F.col("lo").alias("ln"), F.col("_place").alias("_other"), "_n")
    near = stored(near_places(at.select("la", "lo", "_place"), there, km).select("_place", "_other", "_n"), "neighbours")
    many = near.groupBy("_place").agg(F.sum("_n").alias("_near"))
    people = people.join(at.select("la", "lo", "_place"), ["la", "lo"], "left").select("agent", "_rate", "_place").join(many, "_place", "left")
    state = stored(people.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long")))).withColumn("year", F.lit(None).cast("long")), "adoption")
    for year in years:
        t = year - years[0]
        adopted = state.where("year IS NOT NULL").groupBy("run", F.col("_place").alias("_other")).agg(F.count("*").alias("_k"))
        # Who has not adopted is not among the adopters of their own place.
        beside = near.join(adopted, "_other").groupBy("run", "_place").agg(F.sum("_k").alias("_peers"))
        y = F.lit(year).cast("long")
        social = F.coalesce(F.col("_peers") / F.col("_near"), F.lit(0.0))
        aware = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1 / (1 + math.exp(-0.3 * (t - 10)))) + normal_draw(F.col("agent"), y, F.col("run"), 1, 0.1)))
        economic = economic_utility(F.col("_rate"), F.lit(cost * (1 - cost_fall) ** t), F.lit(tariff * (1 + tariff_rise) ** t), kwh, life)
        utility = ECONOMIC * economic + SOCIAL * social + AWARE * aware
        takes = utility > THRESHOLD + normal_draw(F.col("agent"), y, F.col("run"), 3, 0.05)
        joined = state.join(beside, ["run", "_place"], "left")
        state = stored(joined.select("agent", "_rate", "_place", "_near", "run", F.coalesce("year", F.when(takes, y)).alias("year")), "adoption")
    return state.select("run", "agent", "year")


def penetration(adopted: DataFrame, years: Sequence[int]) -> DataFrame:
    """``year, mean, low, high``: the share of households that have adopted by each year, over runs (with the 10th and 90th percentile
    of the runs, of which there are few)."""
    totals = adopted.groupBy("run").agg(F.count("*").alias("n"), *[F.sum(F.when(F.col("year") <= y, 1).otherwise(0)).alias(f"_{y}") for y in years])
    each = totals.select("run", F.explode(F.array(*[F.struct(F.lit(y).alias("year"), (F.col(f"_{y}") / F.col("n")).alias("share")) for y in years])).alias("s")).select("run", "s.*")
    return each.groupBy("year").agg(F.avg("share").alias("mean"), F.percentile("share", F.lit(0.1)).alias("low"), F.percentile("share", F.lit(0.9)).alias("high"))
