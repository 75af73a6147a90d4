"""Storage with limits over any number of steps.

One step is a function of the level: ``x -> min(hi, max(lo, keep * x + delta))``. Such functions compose to one of the
same form, so a series is cut into blocks of steps, each block is folded to one function, blocks of blocks
likewise, until a series is one block. Levels then come down: each block's first level is known from the function of
those before it, and a block's own steps are run from there. No series, however long, is one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspan.operators.stored import stored

#: Steps of a block, and blocks of a block of blocks.
BLOCK = 256


def _clamped(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(hi, F.greatest(lo, x))


def _then(f: Column, g: Column) -> Column:
    """The function that applies ``f`` and then ``g``; both are structs of keep, delta, lo, hi."""
    on = lambda x: _clamped(g["keep"] * x + g["delta"], g["lo"], g["hi"])
    return F.struct((f["keep"] * g["keep"]).alias("keep"), (g["keep"] * f["delta"] + g["delta"]).alias("delta"), on(f["lo"]).alias("lo"), on(f["hi"]).alias("hi"))


def _folded(steps: Column) -> Column:
    """One function for an array of them, in order."""
    nothing = F.struct(F.lit(1.0).alias("keep"), F.lit(0.0).alias("delta"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    return F.aggregate(steps, nothing, _then)


def _blocks(df: DataFrame, keys: Sequence[str], at: str, block: int) -> DataFrame:
    """``keys, block, steps``: the functions of a block in the order of ``at``."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col("f").alias("f"))))
    return df.groupBy(*keys, F.floor(F.col(at) / block).alias("block")).agg(ordered.alias("steps"))


def _first_levels(blocks: DataFrame, keys: Sequence[str], start: DataFrame, block: int) -> DataFrame:
    """``keys, block, level``: the level before the first step of each block."""
    whole = stored(blocks.select(*keys, F.col("block").alias("at"), _folded(F.transform("steps", lambda s: s["f"])).alias("f")), "storage-folded")
    upper = stored(_blocks(whole, keys, "at", block), "storage-blocks")
    if upper.where("block <> 0").isEmpty():
        known = start.select(*keys, F.lit(0).cast("long").alias("block"), F.col("start").cast("double").alias("level"))
    else:
        known = _first_levels(upper, keys, start, block)
    return _levels(upper, known, keys).select(*keys, F.col("at").alias("block"), F.col("before").alias("level"))


def _levels(blocks: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, at, before, level`` of every step of blocks whose first level is known."""
    joined = blocks.join(known, [*keys, "block"])
    begin = F.struct(F.col("level").alias("now"), F.array().cast("array<struct<at:bigint,before:double,level:double>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        f = s["f"]
        after = _clamped(f["keep"] * acc["now"] + f["delta"], f["lo"], f["hi"])
        return F.struct(after.alias("now"), F.array_append(acc["out"], F.struct(s["at"].alias("at"), acc["now"].alias("before"), after.alias("level"))).alias("out"))

    return joined.select(*keys, F.explode(F.aggregate("steps", begin, step, lambda a: a["out"])).alias("s")).select(*keys, "s.*")


def bounded_levels(df: DataFrame, keys: Sequence[str], step: str, delta: str, lo: Column, hi: Column, start: DataFrame, keep: Column | float = 1.0, block: int = BLOCK) -> DataFrame:
    """``keys, step, level, spill, shortage`` of a store whose level changes by ``delta`` and stays within ``lo`` and ``hi``.

    ``start`` has ``keys, start``. ``step`` numbers a series' steps from 0, without repeats; steps that are missing change
    nothing. ``keep`` is what remains of the level over a step. What does not fit is spill, what is not there is shortage.
    """
    d = lambda c: c.cast("double")
    f = F.struct(d(F.lit(keep) if not isinstance(keep, Column) else keep).alias("keep"), d(F.col(delta)).alias("delta"), d(lo).alias("lo"), d(hi).alias("hi"))
    rows = df.select(*keys, F.col(step).cast("long").alias("at"), f.alias("f"))
    blocks = stored(_blocks(rows, keys, "at", block), "storage-steps")
    levels = _levels(blocks, _first_levels(blocks, keys, start, block), keys)
    out = rows.join(levels, [*keys, "at"])
    free = F.col("f.keep") * F.col("before") + F.col("f.delta")
    return out.select(*keys, F.col("at").alias(step), "level", F.greatest(free - F.col("f.hi"), F.lit(0.0)).alias("spill"), F.greatest(F.col("f.lo") - free, F.lit(0.0)).alias("shortage"))


def cyclic_gap(levels: DataFrame, keys: Sequence[str], step: str, start: DataFrame) -> DataFrame:
    """How far each series ends from where it began: a fleet that must return has none."""
    last = levels.groupBy(*keys).agg(F.max_by("level", step).alias("end"))
    return start.join(last, list(keys), "left").select(*keys, (F.coalesce("end", "start") - F.col("start")).alias("gap"))
