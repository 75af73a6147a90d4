"""Yearly profiles: daily to hourly, synthetic availability, measures of the sun."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.functions import scalar as sc
from wattspan.operators.stored import spread

HOURS = 8760
#: Units in a task that makes their hours.
UNITS = 512


def daily_to_hourly(df: DataFrame, keys: Sequence[str], day: str, value: str, days: int = 365) -> DataFrame:
    """Each day's value for its 24 hours, days in order; the last one goes on to the year's end, more are left out."""
    series = df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(day, value))), lambda x: x[value]).alias("_v"))
    hours = series.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(days * 24 - 1))))
    return hours.select(*keys, "hour", F.get("_v", F.least(F.floor(F.col("hour") / 24), F.size("_v") - 1).cast("int")).alias(value))


def upscaled_step(hour: Column, points_a_day: int) -> Column:
    """Number of the coarse step that holds an hour, with so many steps a day."""
    return F.floor(hour / (24 / points_a_day)).cast("long")


def peak_sun_hours(ghi: str) -> Column:
    """Aggregate over hourly rows: hours a day at 1000 W a square metre with the same energy."""
    return F.sum(ghi) / 1000 / F.greatest(F.count("*") / 24, F.lit(1.0))


def performance_ratio(ghi: str, air: str, coefficient_pct: float, noct: float) -> Column:
    """Aggregate: mean temperature factor of hours with sun; 0 without any."""
    cell = sc.cell_temperature(F.col(air), F.col(ghi), noct)
    factor = F.least(F.lit(1.5), F.greatest(F.lit(0.0), 1 + coefficient_pct / 100 * (cell - 25)))
    return F.coalesce(F.avg(F.when(F.col(ghi) > 0, factor)), F.lit(0.0))


def thermal_profile(units: DataFrame, unit: str, start: Column, weeks: float, annual: float, hours: int = HOURS) -> DataFrame:
    """Firm availability with one planned outage from ``start``, at most 1 and of the annual mean where that can be reached."""
    out = int(weeks * 168)
    level = min(1.0, annual / ((hours - out) / hours))
    rows = spread(units.select(unit, start.cast("int").alias("_s")), UNITS, unit).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
    return rows.select(unit, "hour", F.when((F.col("hour") >= F.col("_s")) & (F.col("hour") < F.col("_s") + out), 0.0).otherwise(level).alias("cf"))


def hydro_profile(spark: SparkSession, latitude: float, annual: float, hours: int = HOURS) -> DataFrame:
    """Run-of-river availability with a given annual mean, before it is cut at 1."""
    rows = spark.range(hours).select(F.col("id").cast("int").alias("hour")).withColumn("_s", sc.hydro_shape(F.col("hour") / hours, latitude))
    mean = rows.agg(F.avg("_s").alias("_m"))
    return rows.join(F.broadcast(mean)).select("hour", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_s") * annual / F.col("_m"))).alias("cf"))


def hydro_profiles(units: DataFrame, unit: str, latitude: str, annual: str, hours: int = HOURS) -> DataFrame:
    """Run-of-river availability of each unit by its latitude, with its annual mean before it is cut at 1."""
    lat, t = F.col(latitude), F.col("hour") / hours
    north, south, tropic = (sc.hydro_shape(t, x) for x in (45.0, -45.0, 0.0))
    kind = F.when(F.abs(lat) < 10, "tropic").when(lat >= 0, "north").otherwise("south")
    rows = spread(units.select(unit, kind.alias("_kind"), F.col(annual).alias("_annual")), UNITS, unit).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
    shape = F.when(F.col("_kind") == "tropic", tropic).when(F.col("_kind") == "north", north).otherwise(south)
    means = units.sparkSession.range(hours).select(F.col("id").alias("hour")).agg(*[F.avg(s).alias(k) for k, s in (("north", north), ("south", south), ("tropic", tropic))]).first()  # three numbers
    mean = F.when(F.col("_kind") == "tropic", means["tropic"]).when(F.col("_kind") == "north", means["north"]).otherwise(means["south"])
    return rows.select(unit, "hour", F.least(F.lit(1.0), F.greatest(F.lit(0.0), shape * F.col("_annual") / mean)).alias("cf"))
