"""Unit, technology, price and reliability metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE_MW = 1e-6
DISCHARGE_MW = 0.01


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is not positive."""
    return F.when(b > 0, a / b).otherwise(0.0)


def capacity_factor(df: DataFrame, keys: Sequence[str], mw: str, rated: Column) -> DataFrame:
    """Mean output over rated power by keys; 0 without rated power."""
    return df.groupBy(*keys).agg(ratio(F.avg(mw), rated).alias("capacity_factor"))


def unit_cost(fuel: Column, fuel_price: Column, energy_content: Column, efficiency: Column) -> Column:
    """Fuel cost per MWh; from the fuel's price where the unit has none."""
    return F.when(fuel > 0, fuel).otherwise(F.try_divide(F.try_divide(fuel_price, energy_content), efficiency))


def levelised_cost(fuel: Column, fixed: Column, maintenance: Column, out: Column, startup_cost: Column, startups: Column) -> Column:
    """Per row, only where the unit runs."""
    return F.when(out > ACTIVE_MW, ((fuel + fixed + maintenance) * out + startup_cost * startups) / out)


def re_share_generation(keys: Sequence[str], df: DataFrame, mw: str, renewable: str) -> DataFrame:
    """Definition A: renewable output over all output."""
    return df.groupBy(*keys).agg(ratio(F.sum(F.when(F.col(renewable), F.col(mw)).otherwise(0.0)), F.sum(mw)).alias("re_share"))


def re_share_usable(available: DataFrame, demand: DataFrame, on: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Definition B: what demand can take of the available renewable output, over demand, within 0..1."""
    joined = demand.join(available, list(on), "left")
    usable = F.sum(F.least(F.coalesce("available", F.lit(0.0)), F.col("demand")))
    return joined.groupBy(*keys).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio(usable, F.sum("demand")))).alias("re_usable"))


def re_share_clipped(keys: Sequence[str], df: DataFrame, mw: str, renewable: str) -> DataFrame:
    """Definition D: as A, on outputs clipped at 0."""
    x = F.greatest(F.col(mw), F.lit(0.0))
    return df.groupBy(*keys).agg(ratio(F.sum(F.when(F.col(renewable), x).otherwise(0.0)), F.sum(x)).alias("re_share"))


def emissions(df: DataFrame, factors: dict[str, float], fuel: str, mw: str, keys: Sequence[str], default: float = 0.0) -> DataFrame:
    table = F.create_map(*(F.lit(x) for pair in factors.items() for x in pair))
    return df.groupBy(*keys).agg(F.sum(F.col(mw) * F.coalesce(F.try_element_at(table, F.col(fuel)), F.lit(default))).alias("t_co2"))


def price_split(df: DataFrame, t: str, price: str) -> DataFrame:
    """``energy``: mean over nodes at each step; ``congestion``: what the node's price adds."""
    mean = F.avg(price).over(Window.partitionBy(t))
    return df.withColumn("energy", mean).withColumn("congestion", F.col(price) - mean)


def system_price(df: DataFrame, keys: Sequence[str], price: str, demand: str) -> DataFrame:
    """Demand-weighted price, the plain mean without demand."""
    total = F.sum(demand)
    return df.groupBy(*keys).agg(F.when(total > 0, F.sum(F.col(price) * F.col(demand)) / total).otherwise(F.avg(price)).alias("price"))


def selling_price(df: DataFrame, keys: Sequence[str], price: str, out: str) -> DataFrame:
    active = df.where(F.col(out) > ACTIVE_MW)
    return active.groupBy(*keys).agg((F.sum(F.col(price) * F.col(out)) / F.sum(out)).alias("selling_price"))


def vallcoe(lcoe: Column, capture: Column, capacity_credit: Column, ramp: Column, rated: Column, renewable: Column) -> Column:
    """Value-adjusted levelised cost."""
    flexibility = F.when(renewable, 0.0).otherwise(ratio(ramp, rated))
    return lcoe * (1 + (1 - capture) + 0.15 * (0.85 - capacity_credit) - 0.1 * flexibility)


def battery_lcoe(charge: Column, discharge: Column, price: Column, eta_in: Column, eta_out: Column, maintenance: Column) -> Column:
    cost = charge * price / F.greatest(eta_in * eta_out, F.lit(0.01)) + (charge + discharge) * maintenance
    return F.when(discharge > DISCHARGE_MW, F.least(F.lit(10000.0), F.greatest(F.lit(0.0), cost / discharge)))


def reliability(df: DataFrame, keys: Sequence[str], t: str, demand: str, supply: str, hours: float = 1.0) -> DataFrame:
    """Loss-of-load probability, unserved energy, hours, events (rising edges) and the peak of unserved load."""
    unserved = F.greatest(F.col(demand) - F.col(supply), F.lit(0.0))
    short = (unserved > ACTIVE_MW).cast("int")
    rows = df.withColumn("_u", unserved).withColumn("_s", short)
    before = F.lag("_s", 1, 0).over(Window.partitionBy(*keys).orderBy(t))
    edges = rows.withColumn("_e", F.when((F.col("_s") == 1) & (before == 0), 1).otherwise(0))
    return edges.groupBy(*keys).agg(F.avg("_s").alias("lolp"), (F.sum("_u") * hours).alias("ens"), (F.sum("_s") * hours).alias("lolh"), F.sum("_e").alias("lolf"), F.max("_u").alias("peak_unserved"))


def rising_edges(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """Number of times a condition becomes true."""
    flag = F.coalesce(condition, F.lit(False)).cast("int")
    rows = df.withColumn("_f", flag)
    before = F.lag("_f", 1, 0).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_e", F.when((F.col("_f") == 1) & (before == 0), 1).otherwise(0)).groupBy(*keys).agg(F.sum("_e").cast("long").alias("events"), F.sum("_f").cast("long").alias("steps"))


def imports_exports(flows: DataFrame, source: str, target: str, flow: str, hours: float = 1.0) -> DataFrame:
    """GWh into and out of each node; a negative flow runs against its line."""
    both = flows.select(F.explode(F.array(
        F.struct(F.col(target).alias("node"), F.greatest(F.col(flow), F.lit(0.0)).alias("into"), F.greatest(-F.col(flow), F.lit(0.0)).alias("out")),
        F.struct(F.col(source).alias("node"), F.greatest(-F.col(flow), F.lit(0.0)).alias("into"), F.greatest(F.col(flow), F.lit(0.0)).alias("out")),
    )).alias("e")).select("e.*")
    return both.groupBy("node").agg((F.sum("into") * hours / 1e3).alias("imports"), (F.sum("out") * hours / 1e3).alias("exports"))


def deep_stats(df: DataFrame, keys: Sequence[str], value: str, ts: str) -> DataFrame:
    """Level, spread, load factor and peak hour of a series."""
    from wattspan.operators.quantiles import exact_quantiles

    x = F.col(value)
    weekend = F.dayofweek(ts).isin(1, 7)
    ranks = exact_quantiles(df, keys, value, [0.05, 0.5, 0.95], "_q").select(*keys, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("p05", "p50", "p95"))])
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.stddev_pop(x).alias("std"),
        ratio(F.stddev_pop(x), F.avg(x)).alias("cv"), ratio(F.avg(x), F.max(x)).alias("load_factor"),
        F.hour(F.max_by(ts, F.struct(x, -F.unix_micros(F.col(ts).cast("timestamp"))))).alias("peak_hour"),
        F.avg(F.when(~weekend, x)).alias("weekday_mean"), F.avg(F.when(weekend, x)).alias("weekend_mean"),
    ).join(ranks, list(keys), "left")


def forecast_metrics(df: DataFrame, keys: Sequence[str], observed: str, forecast: str) -> DataFrame:
    o, f = F.col(observed), F.col(forecast)
    return df.groupBy(*keys).agg(
        F.avg(F.abs(f - o)).alias("mae"), F.sqrt(F.avg((f - o) * (f - o))).alias("rmse"), (F.avg(F.try_divide(F.abs(f - o), F.abs(o))) * 100).alias("mape"),
        ((F.max(f) - F.max(o)) / F.max(o) * 100).alias("peak_error"), ((F.sum(f) - F.sum(o)) / F.sum(o) * 100).alias("energy_error"), F.corr(o, f).alias("correlation"),
    )


def tail_mean(df: DataFrame, keys: Sequence[str], value: str, share: float, tie: Sequence[str]) -> DataFrame:
    """Value at risk and mean of the worst: rank ``int(share * n)`` of ascending values, and the mean up to it."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(value, *tie)) - 1).withColumn("_k", F.floor(F.count("*").over(w) * share))
    return ranked.groupBy(*keys).agg(F.max(F.when(F.col("_r") == F.col("_k"), F.col(value))).alias("var"), F.avg(F.when(F.col("_r") <= F.col("_k"), F.col(value))).alias("cvar"))
