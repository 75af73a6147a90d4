"""Time: blocks, rolling windows, ramps, duration curves, lags, gaps, factors.

Positions ``t`` are integer steps from the horizon's start unless said otherwise. A block ``k`` of size
``r`` covers ``[k r, (k + 1) r)``. Windows are always partitioned by the series' keys, so that no series
but one shares a task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattspan.operators.quantiles import exact_quantiles, with_quantiles

HOURS_A_YEAR = 8760
MONTH730 = 730


def cleaned(x: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def block(t: Column, size: int) -> Column:
    return F.floor(t / size).cast("long")


def block_aggregate(df: DataFrame, keys: Sequence[str], t: str, value: str, size: int, stat: str = "mean", complete_only: bool = True, out: str = "value") -> DataFrame:
    """One row a key and block. ``complete_only`` drops blocks that miss a step, as a truncated tail does."""
    agg = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[stat](cleaned(F.col(value)))
    grouped = df.groupBy(*keys, block(F.col(t), size).alias("block")).agg(agg.alias(out), F.count_distinct(t).alias("_steps") if complete_only else F.lit(size).alias("_steps"))
    return grouped.where(F.col("_steps") == size).drop("_steps")


def rolling_windows(spark: SparkSession, hours: int, window: int, overlap: int) -> DataFrame:
    """window, start, end, keep_end, kept_fraction of a rolling horizon.

    ``max(1, ceil((hours - overlap) / (window - overlap)))`` windows start ``window - overlap`` apart; all
    but the last keep only what precedes the next one's start.
    """
    step = window - overlap
    n = max(1, math.ceil((hours - overlap) / step))
    w = spark.range(n).select(F.col("id").cast("int").alias("window"), (F.col("id") * step).alias("start"))
    w = w.withColumn("end", F.least(F.col("start") + window, F.lit(hours)))
    last = F.col("window") == n - 1
    w = w.withColumn("keep_end", F.when(last, F.col("end")).otherwise(F.col("start") + step))
    return w.withColumn("kept_fraction", (F.col("keep_end") - F.col("start")) / (F.col("end") - F.col("start")))


def in_windows(df: DataFrame, t: str, hours: int, window: int, overlap: int) -> DataFrame:
    """Each row once for every window that holds it; by arithmetic on ``t``, without a range join."""
    step = window - overlap
    n = max(1, math.ceil((hours - overlap) / step))
    first = F.greatest(F.lit(0), F.ceil((F.col(t) - window + 1) / step))
    last = F.least(F.lit(n - 1), F.floor(F.col(t) / step))
    inside = df.where((F.col(t) >= 0) & (F.col(t) < hours)).withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    return inside.withColumn("window", F.explode(F.sequence(F.col("_first").cast("int"), F.col("_last").cast("int")))).drop("_first", "_last")


def stitched(df: DataFrame, t: str, window_col: str, hours: int, window: int, overlap: int) -> DataFrame:
    """Rows of windowed results that a stitched series keeps."""
    step = window - overlap
    n = max(1, math.ceil((hours - overlap) / step))
    return df.where((F.col(window_col) == n - 1) | (F.col(t) < (F.col(window_col) + 1) * step))


def ramp(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, hours: float = 1.0, out: str = "ramp", first: str = "null") -> DataFrame:
    """Change from the step before, by hour. ``first``: null, or zero for the first step."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = (F.col(value) - F.lag(value).over(w)) / hours
    return df.withColumn(out, F.coalesce(change, F.lit(0.0)) if first == "zero" else change)


def duration_curve(df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """Value exceeded for each fraction of the time; linear between ranks."""
    out = exact_quantiles(df.select(*keys, cleaned(F.col(value)).alias("_value")), keys, "_value", [1.0 - f for f in fractions], "_q")
    return out.select(*keys, F.posexplode("_q").alias("rank", "value")).withColumn("fraction", F.element_at(F.array(*(F.lit(float(f)) for f in fractions)), F.col("rank") + 1)).select(*keys, "fraction", "value")


def ranked_duration(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """Descending rank of each value within its keys, and the share of time at or above it."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), *tie)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("exceedance", F.col("rank") / F.count("*").over(Window.partitionBy(*keys)))


def lags(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, steps: Sequence[int], fill_median: bool = True) -> DataFrame:
    """``<value>_lag<k>``; where there is none, the series' median if asked for."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if not fill_median:
        return df.withColumns({f"{value}_lag{k}": F.lag(value, k).over(w) for k in steps})
    filled = with_quantiles(df, keys, value, [0.5], ["_median"])
    return filled.withColumns({f"{value}_lag{k}": F.coalesce(F.lag(value, k).over(w), F.col("_median")) for k in steps}).drop("_median")


def fill_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, limit: int = 6, out: str = "filled") -> DataFrame:
    """Forward fill over at most ``limit`` steps, then backward fill likewise."""
    w = Window.partitionBy(*keys).orderBy(*order)
    forward = F.last(value, ignorenulls=True).over(w.rowsBetween(-limit, 0))
    tmp = df.withColumn("_forward", forward)
    return tmp.withColumn(out, F.coalesce("_forward", F.first("_forward", ignorenulls=True).over(w.rowsBetween(0, limit)))).drop("_forward")


def impute_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Nulls by the group's median, then by that of all rows."""
    both = with_quantiles(with_quantiles(df, keys, value, [0.5], ["_group"]), [], value, [0.5], ["_all"])
    return both.withColumn(out, F.coalesce(value, "_group", "_all")).drop("_group", "_all")


def rolling_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, back: int, ahead: int = 0, divide_by: int | None = None, out: str = "rolling") -> DataFrame:
    """Mean over rows ``-back..ahead``. ``divide_by`` divides by a fixed number even at the edges."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-back, ahead)
    return df.withColumn(out, F.sum(value).over(w) / divide_by if divide_by else F.avg(value).over(w))


def cumulative(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "cumulative") -> DataFrame:
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def minmax(df: DataFrame, keys: Sequence[str], value: str, out: str = "normalised") -> DataFrame:
    """To [0, 1] within keys; 0 where all values are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0))


def growth(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "growth") -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, F.try_divide(F.col(value), before) - 1)


def interpolate_years(df: DataFrame, keys: Sequence[str], year: str, value: str) -> DataFrame:
    """Knots to one row a year, linear between knots."""
    w = Window.partitionBy(*keys).orderBy(year)
    knots = df.withColumn("_y1", F.lead(year).over(w)).withColumn("_v1", F.lead(value).over(w))
    years = knots.withColumn("_y", F.explode(F.sequence(F.col(year), F.coalesce(F.col("_y1") - 1, F.col(year)))))
    share = (F.col("_y") - F.col(year)) / (F.col("_y1") - F.col(year))
    return years.select(*keys, F.col("_y").alias(year), F.coalesce(F.col(value) + (F.col("_v1") - F.col(value)) * share, F.col(value)).alias(value))


def month_hour_factors(df: DataFrame, keys: Sequence[str], ts: str, observed: str, forecast: str, low: float, high: float) -> DataFrame:
    """Correction factors by month and hour, clipped; 1 where the forecast is nothing."""
    factor = F.coalesce(F.try_divide(F.sum(observed), F.sum(forecast)), F.lit(1.0))
    return df.groupBy(*keys, F.month(ts).alias("month"), F.hour(ts).alias("hour")).agg(F.least(F.lit(high), F.greatest(F.lit(low), factor)).alias("factor"))


def apply_factors(df: DataFrame, factors: DataFrame, keys: Sequence[str], ts: str, value: str, out: str) -> DataFrame:
    joined = df.withColumn("month", F.month(ts)).withColumn("hour", F.hour(ts)).join(factors, [*keys, "month", "hour"], "left")
    return joined.withColumn(out, F.col(value) * F.coalesce("factor", F.lit(1.0))).drop("factor")


def hourly_grid(df: DataFrame, keys: Sequence[str], ts: str, value: str, first: str, last: str) -> DataFrame:
    """Hourly means on a complete grid of hours; null where a series has nothing."""
    means = df.groupBy(*keys, F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour_ts")).agg(F.avg(cleaned(F.col(value))).alias(value))
    grid = df.select(*keys).distinct().withColumn("hour_ts", F.explode(F.expr(f"sequence(timestamp_ntz'{first}', timestamp_ntz'{last}', interval 1 hour)")))
    return grid.join(means, [*keys, "hour_ts"], "left")


def without_leap_day(df: DataFrame, ts: str) -> DataFrame:
    return df.where(~((F.month(ts) == 2) & (F.dayofmonth(ts) == 29)))


def daily_to_hourly_temperature(df: DataFrame, low: str, high: str) -> DataFrame:
    """A cosine between the day's extremes, greatest at 14:00 and least at 02:00."""
    mean, half = (F.col(high) + F.col(low)) / 2, (F.col(high) - F.col(low)) / 2
    hours = df.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return hours.withColumn("temperature", mean + half * F.cos(2 * math.pi * (F.col("hour") - 14) / 24))


def representative_days(df: DataFrame, keys: Sequence[str], day: str, value: str, segments: int) -> DataFrame:
    """The peak day of all, and the day of highest total of each of ``segments`` equal parts of the year."""
    daily = df.groupBy(*keys, day).agg(F.sum(value).alias("total"))
    part = F.floor((F.dayofyear(day) - 1) * segments / 366).cast("int")
    w = Window.partitionBy(*keys, part).orderBy(F.desc("total"), day)
    return daily.withColumn("segment", part).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def storage_level(df: DataFrame, keys: Sequence[str], order: Sequence[str], charge: str, discharge: str, initial: float, eta_in: float, eta_out: float, hours: float = 1.0) -> DataFrame:
    """State of charge after each step of a storage without self-discharge: a running sum."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("soc", initial + F.sum(eta_in * F.col(charge) * hours - F.col(discharge) * hours / eta_out).over(w))


def subdivided(df: DataFrame, keys: Sequence[str], t: str, value: str, parts: int) -> DataFrame:
    """``parts`` steps for each step, on the line to the next step's value; the last step of a series stays level. ``t`` counts
    the finer steps."""
    following = F.coalesce(F.lead(value).over(Window.partitionBy(*keys).orderBy(t)), F.col(value))
    fine = df.withColumn("_n", following).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return fine.select(*keys, (F.col(t) * parts + F.col("_i")).alias(t), (F.col(value) + (F.col("_n") - F.col(value)) * F.col("_i") / parts).alias(value))
