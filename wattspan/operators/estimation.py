"""Normalising and joining measured series for training, and fits of published curve families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hourly_left(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Hourly means, each hour named by its start."""
    return df.groupBy(*keys, F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour_ts")).agg(F.avg(value).alias(value))


def full_year(df: DataFrame, keys: Sequence[str], ts: str, value: str, year: int) -> DataFrame:
    """8760 hours of one year: the leap day is dropped, hours without a value are null."""
    grid = df.select(*keys).distinct().withColumn(ts, F.explode(F.expr(f"sequence(timestamp_ntz'{year}-01-01 00:00:00', timestamp_ntz'{year}-12-31 23:00:00', interval 1 hour)")))
    grid = grid.where(~((F.month(ts) == 2) & (F.dayofmonth(ts) == 29)))
    w = Window.partitionBy(*keys).orderBy(ts)
    return grid.join(df.select(*keys, ts, value), [*keys, ts], "left").withColumn("hour", F.row_number().over(w) - 1)


def training_rows(load: DataFrame, weather: DataFrame, keys: Sequence[str], ts: str, value: str, temperature: str) -> DataFrame:
    """Load with weather, its daily lags, calendar and the series' own normaliser.

    Zones of one key weigh less the more of them there are, within 0.05 and 1.
    """
    day = weather.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.avg(temperature).alias("t_day"), (F.max(temperature) - F.min(temperature)).alias("t_range"))
    w = Window.partitionBy(*keys).orderBy("day")
    day = day.withColumn("t_lag1", F.lag("t_day").over(w)).withColumn("t_7", F.avg("t_day").over(w.rowsBetween(-6, 0))).withColumn("t_30", F.avg("t_day").over(w.rowsBetween(-29, 0))).withColumn("t_trend", F.col("t_7") - F.col("t_30"))
    mean = load.groupBy(*keys).agg(F.avg(value).alias("normaliser"))
    rows = load.withColumn("day", F.to_date(ts)).join(day, [*keys, "day"], "left").join(mean, list(keys))
    h = F.hour(ts)
    return rows.withColumn("relative", F.col(value) / F.col("normaliser")).withColumn("hour_sin", F.sin(2 * 3.141592653589793 * h / 24)).withColumn("hour_cos", F.cos(2 * 3.141592653589793 * h / 24)).withColumn("weekend", F.dayofweek(ts).isin(1, 7))


def real_only(df: DataFrame, source: str, synthetic: str = "PLEXOS") -> DataFrame:
    """Rows whose source does not name a synthetic one."""
    return df.where(~F.coalesce(F.col(source).contains(synthetic), F.lit(False)))


def leave_one_out(df: DataFrame, group: str, folds: int, seed: int = 0) -> DataFrame:
    """(fold, group) of so many held-out groups, in the order of a seeded hash."""
    order = Window.orderBy(F.xxhash64(group, F.lit(seed)), group)
    groups = df.select(group).distinct()  # one small row a group
    return groups.withColumn("fold", F.row_number().over(order) - 1).where(F.col("fold") < folds)


def holidays(df: DataFrame, dates: DataFrame, key: str, day: str, holiday: str, reach: int = 7) -> DataFrame:
    """Flag, days to the next and since the last holiday, at most ``reach``.

    Each holiday is spread over the days it reaches, so it is an equi-join.
    """
    spread = dates.select(key, F.explode(F.sequence(F.date_sub(holiday, reach), F.date_add(holiday, reach))).alias(day), F.col(holiday).alias("_h"))
    away = F.datediff("_h", F.col(day))
    near = spread.groupBy(key, day).agg(F.min(F.when(away >= 0, away)).alias("_to"), F.min(F.when(away <= 0, -away)).alias("_from"))
    out = df.join(near, [key, day], "left")
    return out.withColumn("is_holiday", F.coalesce(F.col("_to") == 0, F.lit(False))).withColumn("days_to", F.coalesce("_to", F.lit(reach))).withColumn("days_from", F.coalesce("_from", F.lit(reach))).drop("_to", "_from")


def gdp_elasticity(df: DataFrame, keys: Sequence[str], demand: str, gdp: str) -> DataFrame:
    """Slope of log demand by log output."""
    return df.groupBy(*keys).agg(F.regr_slope(F.log(demand), F.log(gdp)).alias("elasticity"), F.regr_r2(F.log(demand), F.log(gdp)).alias("r2"))


def cascade(annual: DataFrame, monthly: DataFrame, daily: DataFrame, energy: str) -> DataFrame:
    """Annual energy over months and days by shares that are normalised first."""
    m = monthly.withColumn("_m", F.col("share") / F.sum("share").over(Window.partitionBy("node"))).select("node", "month", "_m")
    d = daily.withColumn("_d", F.col("share") / F.sum("share").over(Window.partitionBy("node", "month"))).select("node", "month", "day", "_d")
    return annual.join(m, "node").join(d, ["node", "month"]).select("node", "month", "day", (F.col(energy) * F.col("_m") * F.col("_d")).alias(energy))
