"""Units, profiles and lines of a system: what is active, what is available, what is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspan.operators.joins import outage_factor
from wattspan.operators.trees import bridge_flows

# Surge impedance loading (MW) from a voltage (kV) on, the least capacity of a line and the margin above a flow.
SURGE = ((500.0, 2400.0), (345.0, 1200.0), (220.0, 600.0), (110.0, 250.0), (66.0, 120.0), (33.0, 60.0), (10.0, 20.0), (0.0, 10.0))
LEAST_MW, MARGIN = 5.0, 1.25
#: A unit is active from so many MW at one node on.
ACTIVE_MW = 0.01


def active(rated: Column) -> Column:
    """Whether a unit with this list of ratings by node takes part."""
    return F.coalesce(F.array_max(rated) >= ACTIVE_MW, F.lit(False))


def year_profile(df: DataFrame, keys: Sequence[str], ts: str, year: int, hours: int) -> DataFrame:
    """The first ``hours`` rows of a year of each series, in the order of time, with their place ``hour``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1
    return df.where(F.year(ts) == year).withColumn("hour", place).where(F.col("hour") < hours)


def climate_deltas(availability: Column, technology: Column, ghi: float = 0.0, wind: float = 0.0, degrees: float = 0.0, coefficient: float = 0.004) -> Column:
    """Availability with a change of radiation and warmth for solar units, of wind speed for wind units, within [0, 1]."""
    name = F.lower(technology)
    solar = F.contains(name, F.lit("solar")) | F.contains(name, F.lit("sun")) | F.contains(name, F.lit("pv"))
    changed = F.when(solar, availability * (1 + ghi) * (1 - coefficient * degrees)).when(F.contains(name, F.lit("wind")), availability * (1 + wind)).otherwise(availability)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), changed))


def line_limits(flows: DataFrame, outages: DataFrame, line: str, t: str, flow: str, capacity: str, size: int, longest: int) -> DataFrame:
    """Flows with the limit that outages leave (``limit``) and what exceeds it (``excess``). ``outages`` has the line, start, end, availability."""
    factors = outage_factor(flows.select(line, t), outages, line, "start", "end", "availability", t, size, longest)
    limited = flows.join(factors.select(line, t, "factor"), [line, t])
    return limited.withColumn("limit", F.col(capacity) * F.col("factor")).withColumn("excess", F.greatest(F.lit(0.0), F.abs(F.col(flow)) - F.col("limit")))


def line_flows(v1: Column, v2: Column, angle: Column, r: Column, x: Column, charging: Column, tap: Column | float = 1.0) -> dict[str, Column]:
    """Active and reactive power into a line, or a transformer with a tap at its first end, at both ends (per unit) from voltages and
    the angle between them."""
    v1 = v1 / tap
    g, b = r / (r * r + x * x), -x / (r * r + x * x)
    cos, sin = F.cos(angle), F.sin(angle)
    return {
        "p_from": v1 * v1 * g - v1 * v2 * (g * cos + b * sin),
        "q_from": -v1 * v1 * (b + charging / 2) + v1 * v2 * (b * cos - g * sin),
        "p_to": v2 * v2 * g - v1 * v2 * (g * cos - b * sin),
        "q_to": -v2 * v2 * (b + charging / 2) + v1 * v2 * (b * cos + g * sin),
    }


def national_gwh(given: Column, kwh_a_head: Column, people: Column, access_pct: Column, gdp_a_head: Column, kwh_a_dollar: float) -> tuple[Column, Column]:
    """A country's yearly demand and where it comes from: what is given, else use a head, else its product; null without any."""
    access = F.when(access_pct > 0, access_pct / 100).otherwise(1.0)
    by_use, by_product = (kwh_a_head > 0) & (people > 0), (gdp_a_head > 0) & (people > 0)
    gwh = F.when(given > 0, given).when(by_use, kwh_a_head * people * access / 1e6).when(by_product, gdp_a_head * people * kwh_a_dollar / 1e6)
    return gwh, F.when(given > 0, "given").when(by_use, "use").when(by_product, "product")


def surge_cap(kv: Column) -> Column:
    """What a voltage can carry; no bound where it is unknown."""
    out = F.when(kv.isNull() | (kv <= 0), float("inf"))
    for least, mw in SURGE:
        out = out.when(kv >= least, mw)
    return out


def inferred_capacities(lines: DataFrame, injections: DataFrame, peak: float) -> DataFrame:
    """``a, b, capacity, set_by`` of lines ``a, b, kv, capacity``: at least what must flow over a bridge with a margin, within the system's
    peak and the voltage's surge loading. Capacities are never reduced; ``set_by`` is given, inferred or raised."""
    flow = bridge_flows(lines.select("a", "b"), injections).select("a", "b", "flow")
    ends = lines.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kv", "capacity")
    system = peak * MARGIN if peak > 0 else float("inf")
    needed = F.greatest(F.lit(LEAST_MW), F.least(F.col("flow") * MARGIN, F.lit(system), surge_cap(F.col("kv"))))
    none, low = F.coalesce(F.col("capacity"), F.lit(0.0)) <= 0, F.col("capacity") < needed
    return ends.join(flow, ["a", "b"]).select("a", "b", F.when(none | low, needed).otherwise(F.col("capacity")).alias("capacity"), F.when(none, "inferred").when(low, "raised").otherwise("given").alias("set_by"))


def unit_profiles(units: DataFrame, profiles: DataFrame, unit: str, profile: str, value: str, clip: bool = True) -> DataFrame:
    """Each unit's series from the profile it names: profiles are read once, however many units share them. Units whose profile is
    missing have ones (or zeros, where values are no shares)."""
    known = profiles.select(profile).distinct().withColumn("_known", F.lit(True))
    hours = [c for c in profiles.columns if c not in (profile, value)]
    named = units.join(known, profile, "left")
    have = named.where("_known").drop("_known").join(profiles, profile)
    grid = profiles.select(*hours).distinct().withColumn("_one", F.lit(1))
    rest = named.where("_known IS NULL").drop("_known").withColumn("_one", F.lit(1)).join(grid, "_one").drop("_one").withColumn(value, F.lit(1.0 if clip else 0.0))
    v = F.col(value)
    return have.unionByName(rest).withColumn(value, F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) if clip else v)


def capabilities(meta: DataFrame, run: str) -> DataFrame:
    """``run, tag``: what a result set can show, from its metadata rows (run, kind, name, value): kinds are attribute, scenario, table."""
    attribute = lambda name: (F.col("kind") == "attribute") & (F.col("name") == name)
    table = lambda name: (F.col("kind") == "table") & (F.col("name") == name)
    number = F.col("value").try_cast("double")
    mode = F.lower(F.trim("value"))
    tags = {
        "mga": attribute("num_alternatives") & (number >= 2),
        "multi_node": attribute("num_nodes") & (number > 1),
        "detailed_results": F.col("kind") == "scenario",
        "primary_energy": table("primary_energy"),
        "power_flow": table("power_flow"),
        "investment": (F.col("kind") == "attribute") & F.startswith("name", F.lit("investment_")),
        **{f"mode_{m}": attribute("simulation_mode") & (mode == m) for m in ("development", "unit_commitment", "economic_dispatch")},
    }
    each = F.array_compact(F.array(*[F.when(condition, tag) for tag, condition in tags.items()]))
    return meta.select(run, F.explode(each).alias("tag")).distinct()


def catalogue(meta: DataFrame, run: str) -> DataFrame:
    """``run, name, n``: the tables of a result set that are beside the usual ones, and how many scenarios have them."""
    usual = ["generation", "battery", "curtailment", "prices", "power_flow", "primary_energy", "demand"]
    return meta.where((F.col("kind") == "table") & ~F.col("name").isin(usual)).groupBy(run, "name").agg(F.count("*").alias("n"))
