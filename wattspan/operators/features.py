"""Mapped features: duplicates in space, validation rules, topology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspan.functions.scalar import haversine_km, plain_name
from wattspan.operators.places import expanded, is_place, near_places


def close_pairs(df: DataFrame, id_col: str, lat: str, lon: str, km: float, digits: int | None = None) -> DataFrame:
    """Pairs a < b within ``km``: pairs of places, expanded to the rows at them. The distance is rounded to ``digits``, if
    given, once for a pair of places."""
    placed = df.where(is_place(F.col(lat), F.col(lon)))
    a = placed.select(F.col(id_col).alias("a"), F.col(lat).alias("la"), F.col(lon).alias("lo"))
    b = placed.select(F.col(id_col).alias("b"), F.col(lat).alias("lb"), F.col(lon).alias("ln"))
    pairs = near_places(a.select("la", "lo").distinct(), b.select("lb", "ln").distinct(), km)
    pairs = pairs if digits is None else pairs.withColumn("km", F.round("km", digits))
    return expanded(pairs, a, ["la", "lo"], "a", b, ["lb", "ln"], "b").where("a < b").select("a", "b", "km")


def keep_by_priority(df: DataFrame, id_col: str, lat: str, lon: str, km: float, priority: Column, same: Column | None = None) -> DataFrame:
    """Features that no feature of better priority (smaller, ties by id) is near to. Ids are unique. Places hand their best
    feature to the places near them, so no pair of features is built."""
    kind = F.lit(0) if same is None else same
    ranked = df.select(F.col(id_col).alias("_id"), F.col(lat).alias("la"), F.col(lon).alias("lo"), F.struct(priority.alias("p"), F.col(id_col).alias("id")).alias("_rank"), kind.alias("_k"))
    ranked = ranked.where(is_place(F.col("la"), F.col("lo")) & F.col("_k").isNotNull())
    best = ranked.groupBy("la", "lo", "_k").agg(F.min("_rank").alias("_best"))
    spots = best.select("la", "lo").distinct()
    pairs = near_places(spots, spots.select(F.col("la").alias("lb"), F.col("lo").alias("ln")), km)
    around = pairs.join(best.select(F.col("la").alias("lb"), F.col("lo").alias("ln"), "_k", "_best"), ["lb", "ln"]).groupBy("la", "lo", "_k").agg(F.min("_best").alias("_best"))
    lost = ranked.join(around, ["la", "lo", "_k"]).where(F.col("_best") < F.col("_rank")).select(F.col("_id").alias("_lost"))
    return df.join(lost, F.col(id_col) == F.col("_lost"), "left_anti")


def duplicate_names(df: DataFrame, id_col: str, name: str) -> DataFrame:
    """Ids that share a normalised name: name, ids."""
    return df.groupBy(plain_name(F.col(name)).alias("name")).agg(F.sort_array(F.collect_set(id_col)).alias("ids")).where("size(ids) > 1 AND name <> ''")


def complete(kind: Column, name: Column, capacity: Column, voltage: Column) -> Column:
    """Whether a feature has what its kind needs."""
    return F.when(kind == "generator", capacity > 0).when(kind == "line", voltage > 0).when(kind == "substation", voltage.isNotNull() & name.isNotNull()).otherwise(name.isNotNull())


def issues(rules: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """Findings of many rules in one table: rule, severity, element. Each rule is a table of ``element``."""
    out = None
    for name, severity, found in rules:
        rows = found.select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.col("element").cast("string").alias("element"))
        out = rows if out is None else out.unionByName(rows)
    return out


def network_rules(nodes: DataFrame, lines: DataFrame, units: DataFrame) -> list[tuple[str, str, DataFrame]]:
    """Dangling ends, self-loops, nodes without lines, units without a node, units without capacity."""
    ends = lines.select(F.explode(F.array("a", "b")).alias("node"), "line")
    return [
        ("dangling_line", "error", ends.join(nodes, "node", "left_anti").select(F.col("line").alias("element")).distinct()),
        ("self_loop", "error", lines.where("a = b").select(F.col("line").alias("element"))),
        ("isolated_node", "warning", nodes.join(ends, "node", "left_anti").select(F.col("node").alias("element"))),
        ("unit_without_node", "error", units.join(nodes, "node", "left_anti").select(F.col("unit").alias("element"))),
        ("unit_without_capacity", "warning", units.where("rated_mw IS NULL OR rated_mw <= 0").select(F.col("unit").alias("element"))),
    ]


def chain_order(edges: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Consecutive points of a line as segments."""
    w = Window.partitionBy(*keys).orderBy(position)
    return edges.withColumn("next_lat", F.lead("lat").over(w)).withColumn("next_lon", F.lead("lon").over(w)).where("next_lat IS NOT NULL").withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon")))


def capped(df: DataFrame, minor: Column, order: Sequence[Column], most: int) -> DataFrame:
    """All features that are not ``minor``, and so many of the minor ones, in order, that there are ``most`` in all. The greater part
    is never cut, so there may be more."""
    kept = df.where(~minor)
    room = max(0, most - kept.count())
    return kept.unionByName(df.where(minor).orderBy(*order).limit(room))
