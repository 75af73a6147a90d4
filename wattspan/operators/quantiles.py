"""Exact quantiles of groups of any size.

Distinct values are counted, cut by ranges of group and value, sorted inside ranges and stored. Ranks are then sums
of counts: inside a range, over the ranges before it (as many as partitions), less the rank at which the group begins. No
task holds a group, and of a group only the values at the wanted ranks go on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattspan.operators.stored import stored

#: ``monotonically_increasing_id`` keeps the place in the partition in so many low bits.
PLACE_BITS = 33


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str = "quantiles") -> DataFrame:
    """``keys`` and an array with the value at each share of the ranks, linear between neighbours. Nulls and NaN are no
    values; groups without any are missing."""
    v = F.col(value).cast("double")
    counted = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_c"))
    order = [*map(F.col, keys), F.col("_v")]
    placed = stored(counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "quantiles")
    rows = placed.withColumn("_part", F.shiftright("_at", PLACE_BITS))
    sizes = rows.groupBy("_part").agg(F.sum("_c").alias("_s"))  # a row a partition
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))
    inside = F.sum("_c").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    upto = rows.withColumn("_in", inside).join(offsets, "_part").withColumn("_upto", F.col("_before") + F.col("_in"))
    # A group's first rank and size, once for each range it touches.
    per = upto.groupBy(*keys, "_part").agg(F.min(F.col("_upto") - F.col("_c")).alias("_first"), F.sum("_c").alias("_k"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    groups = per.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], F.col("_part").alias("_gp"), F.min("_first").over(whole).alias("_start"), F.sum("_k").over(whole).alias("_n"))
    same = F.col("_part") == F.col("_gp")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    ranked = upto.join(groups, same).withColumn("_hi", F.col("_upto") - F.col("_start") - 1).withColumn("_lo", F.col("_upto") - F.col("_c") - F.col("_start"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("h")) for i, p in enumerate(probs)])
    held = lambda x, at: at(x["h"]).between(F.col("_lo"), F.col("_hi"))
    hit = ranked.withColumn("_w", F.explode(F.filter(wanted, lambda x: held(x, F.floor) | held(x, F.ceil))))
    low = F.max(F.when(F.floor("_w.h").between(F.col("_lo"), F.col("_hi")), F.col("_v")))
    high = F.max(F.when(F.ceil("_w.h").between(F.col("_lo"), F.col("_hi")), F.col("_v")))
    h = F.first("_w.h")
    each = hit.groupBy(*keys, F.col("_w.i").alias("_i")).agg(low.alias("_a"), high.alias("_b"), (h - F.floor(h)).alias("_f"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("q"))))  # one entry a share
    return each.groupBy(*keys).agg(F.transform(ordered, lambda s: s["q"]).alias(out))


def with_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Rows with their group's quantiles under ``names``; null for groups without values."""
    q = exact_quantiles(df, keys, value, probs, "_q")
    q = q.select(*[F.col(k).alias(f"_q{i}") for i, k in enumerate(keys)], *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)])
    if not keys:
        found = q.first()  # the quantiles of one group
        return df.withColumns({n: F.lit(found[n] if found else None).cast("double") for n in names})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_q{i}"))
    return df.join(q, same, "left").drop(*[f"_q{i}" for i in range(len(keys))])
