"""Matrices, profiles, partitioned datasets and exports."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_matrix(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A headerless numeric matrix, a row an hour and a column a node, as ``hour, node, value``.

    Text lines are numbered by file and place in it, so a file's order is the hours' order. Cells that are
    no number are null.
    """
    if PurePosixPath(path).suffix.lower() in (".xls", ".xlsx"):
        raise ValueError("spreadsheets are not read; save them as CSV")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    numbered = lines.where(F.trim("value") != "").withColumn("hour", F.row_number().over(Window.partitionBy("_f").orderBy("_b", "_i")) - 1)
    cells = numbered.select("hour", F.posexplode(F.split("value", delimiter)).alias("node", "_c"))
    return cells.select("hour", "node", F.expr("try_cast(trim(_c) AS double)").alias("value"))


def with_timestamps(df: DataFrame, hour: str, date_start: str, year: int | None = None) -> DataFrame:
    """Adds ``ts`` from a start of the form DD/MM/YYYY HH:MM; one year's rows if asked for."""
    start = F.to_timestamp_ntz(F.lit(date_start), F.lit("dd/MM/yyyy HH:mm"))
    out = df.withColumn("ts", (start + F.make_dt_interval(hours=F.col(hour))).cast("timestamp_ntz"))
    return out if year is None else out.where(F.year("ts") == year)


def tile_years(df: DataFrame, hour: str, hours_available: int, years: int, hours_a_year: int = 8760) -> DataFrame:
    """Repeats the first year where the file is shorter than the horizon, and trims what is longer."""
    horizon = years * hours_a_year
    if hours_available >= horizon:
        return df.where(F.col(hour) < horizon)
    first = df.where(F.col(hour) < hours_a_year)
    return first.withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(years - 1)))).withColumn(hour, F.col(hour) + F.col("_y") * hours_a_year).drop("_y")


def availability(profile: DataFrame | None, grid: DataFrame, hour: str, node: str, value: str, columns: int) -> DataFrame:
    """Availability on a grid of hours and nodes: ones without a file, the last column for nodes beyond the
    file's, within [0, 1]; ``from_file`` tells which."""
    if profile is None:
        return grid.withColumn(value, F.lit(1.0)).withColumn("from_file", F.lit(False))
    p = profile.select(F.col(hour).alias("_h"), F.col(node).alias("_n"), F.col(value).alias("_v"))
    joined = grid.join(p, (F.col(hour) == F.col("_h")) & (F.least(F.col(node), F.lit(columns - 1)) == F.col("_n")), "left")
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("_v", F.lit(1.0))))
    return joined.withColumn(value, clipped).withColumn("from_file", F.col("_v").isNotNull()).drop("_h", "_n", "_v")


def write_by(df: DataFrame, path: str, *partitions: str, mode: str = "overwrite") -> None:
    """Parquet in folders by partition values; the partitions prune later reads."""
    df.repartition(*partitions).write.mode(mode).partitionBy(*partitions).parquet(path)


def read_year(spark: SparkSession, path: str, year: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("year") == year)


def read_zone(spark: SparkSession, path: str, iso3: str, year: int, zone: str | None = None) -> DataFrame:
    df = spark.read.parquet(path).where((F.col("iso3") == iso3) & (F.col("year") == year))
    return df if zone is None else df.where(F.col("zone") == zone)


def in_box(df: DataFrame, lat: str, lon: str, south: float, west: float, north: float, east: float) -> DataFrame:
    """Rows in a bounding box; both conditions reach the files."""
    return df.where(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def quadkey_box(quadkey) -> list:
    """(south, west, north, east) columns of a tile's key, by base-4 digits."""
    n = F.length(quadkey)
    digits = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(quadkey, i, F.lit(1)).cast("int"))
    fold = lambda bit: F.aggregate(digits, F.lit(0), lambda a, d: a * 2 + (F.shiftright(d, bit) % 2))
    x, y, size = fold(0), fold(1), F.pow(F.lit(2.0), n)
    lat = lambda v: F.degrees(F.atan(F.sinh(3.141592653589793 * (1 - 2 * v / size))))
    return [lat(y + 1).alias("south"), (x / size * 360 - 180).alias("west"), lat(y).alias("north"), ((x + 1) / size * 360 - 180).alias("east")]


def export_csv(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*partitions) if partitions else w).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
