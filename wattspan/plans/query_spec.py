"""Ad-hoc result queries: variables x aggregation x statistic x transform x years, as a DataFrame plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = {"raw": 1, "daily": 24, "monthly": 730}
STATS = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class QuerySpec:
    """``t`` counts steps of ``hours`` in each year. ``monthly`` is blocks of 730 hours, ``yearly`` a row a year."""

    variables: Sequence[str]
    aggregate: str = "raw"
    stat: str = "sum"
    transform: str = "none"
    years: Sequence[int] = field(default_factory=tuple)
    keys: Sequence[str] = ()
    hours: float = 1.0
    window: int = 24


def _transform(name: str, value: Column, keys: Sequence[str], order: str, spec: QuerySpec) -> Column:
    w = Window.partitionBy(*keys).orderBy(order)
    if name == "cumulative":
        return F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if name == "rolling":  # centred; edges divide by the whole width, as zero padding does
        back = spec.window // 2
        return F.sum(value).over(w.rowsBetween(-back, spec.window - back - 1)) / spec.window
    if name == "derivative":
        return F.coalesce(value - F.lag(value).over(w), F.lit(0.0))
    if name == "normalised":
        low, high = F.min(value).over(Window.partitionBy(*keys)), F.max(value).over(Window.partitionBy(*keys))
        return F.when(high > low, (value - low) / (high - low)).otherwise(0.0)
    if name == "none":
        return value
    raise ValueError(f"unknown transform {name!r}")


def run(facts: DataFrame, spec: QuerySpec, variable: str = "variable", year: str = "year", t: str = "t", value: str = "value") -> DataFrame:
    """Rows variable, keys, year, bucket, value. Filters come first, so they reach the files."""
    if spec.stat not in STATS:
        raise ValueError(f"unknown statistic {spec.stat!r}")
    rows = facts.where(F.col(variable).isin(list(spec.variables)))
    if spec.years:
        rows = rows.where(F.col(year).isin(list(spec.years)))
    if spec.aggregate == "yearly":
        bucket = F.lit(0).cast("long")
    else:
        bucket = F.floor(F.col(t) / max(1, int(CHUNK[spec.aggregate] / spec.hours))).cast("long")
    keys = [variable, *spec.keys, year]
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    out = rows.groupBy(*keys, bucket.alias("bucket")).agg(STATS[spec.stat](x).alias("value"))
    return out.withColumn("value", _transform(spec.transform, F.col("value"), keys, "bucket", spec))
