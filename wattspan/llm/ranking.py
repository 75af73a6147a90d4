"""Numbers of rows in a total order, without one task that sees all rows or all rows of one key.

A table is cut by ranges of its order, sorted inside them and stored with each row's range and place; a range's
first number is a sum over ranges, which are as many as partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspan.llm.common import materialise

#: ``monotonically_increasing_id`` keeps the place in the partition in so many low bits.
PLACE_BITS = 33


def numbered(df: DataFrame, order: list[Column], number: str, part: str, name: str) -> DataFrame:
    """``df`` stored, with ``number`` (from 0, in the order) and ``part`` (the range a row fell into).

    Rows that the order does not tell apart get numbers of their own, so give it a last key that does where
    many rows may be equal. Spark sorts nulls first.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    stored, _ = materialise(placed, name)
    split = stored.withColumn(part, F.shiftright("_at", PLACE_BITS)).withColumn("_place", F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1))
    sizes = split.groupBy(part).agg(F.count("*").alias("_n"))
    # One row a partition: a window without keys is no bottleneck, and the side is as small.
    before = F.coalesce(F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select(part, before.alias("_before")))
    return split.join(offsets, part).withColumn(number, F.col("_before") + F.col("_place")).drop("_at", "_place", "_before")


def key_ranges(rows: DataFrame, keys: list[str], number: str, part: str) -> DataFrame:
    """``keys, part, start, size`` of numbered rows: a key's first number and its rows, once for each range it touches.

    Joined on keys and range, a key with very many rows is spread over its ranges.
    """
    per = rows.groupBy(*keys, part).agg(F.min(number).alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    return per.select(*keys, part, F.min("_first").over(w).alias("start"), F.sum("_n").over(w).alias("size"))


def join_ranges(rows: DataFrame, ranges: DataFrame, keys: list[str], part: str) -> DataFrame:
    """Numbered rows with the columns of ``key_ranges``; null keys meet null keys."""
    other = ranges.select(*[F.col(c).alias(f"_r_{c}") for c in [*keys, part]], *[c for c in ranges.columns if c not in [*keys, part]])
    same = F.col(part) == F.col(f"_r_{part}")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return rows.join(other, same).drop(*[f"_r_{c}" for c in [*keys, part]])
