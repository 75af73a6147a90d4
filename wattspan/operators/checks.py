"""Constraints of the dispatch model as tables: what each leaves over, and where it is broken."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ramp_violations(df: DataFrame, keys: Sequence[str], t: str, out: str, limit: str, hours: float = 1.0) -> DataFrame:
    """Steps whose change exceeds the unit's limit."""
    change = F.col(out) - F.lag(out).over(Window.partitionBy(*keys).orderBy(t))
    return df.withColumn("change", change).where(F.abs("change") > F.col(limit) * hours + 1e-9)


def run_lengths(df: DataFrame, keys: Sequence[str], t: str, on: Column) -> DataFrame:
    """Spans of equal commitment: state, first step, length, and whether an end of the horizon cuts it."""
    w = Window.partitionBy(*keys).orderBy(t)
    state = on.cast("int")
    rows = df.withColumn("_s", state).withColumn("_new", (F.coalesce(F.lag("_s").over(w), F.lit(-1)) != F.col("_s")).cast("int"))
    rows = rows.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = rows.groupBy(*keys, "_g").agg(F.first("_s").alias("state"), F.min(t).alias("start"), F.count("*").alias("length"))
    whole = Window.partitionBy(*keys)
    edge = (F.col("_g") == 1) | (F.col("_g") == F.max("_g").over(whole))
    return spans.withColumn("edge", edge).drop("_g")


def commitment_violations(df: DataFrame, keys: Sequence[str], t: str, on: Column, min_up: int, min_down: int) -> DataFrame:
    """Inner spans shorter than the minimum up or down time."""
    short = F.when(F.col("state") == 1, F.col("length") < min_up).otherwise(F.col("length") < min_down)
    return run_lengths(df, keys, t, on).where(~F.col("edge") & short)


def re_target_slack(df: DataFrame, keys: Sequence[str], renewable: Column, mw: str, demand: DataFrame, load: str, target: float, hours: float = 1.0) -> DataFrame:
    """What renewable output misses of a share of demand."""
    made = df.groupBy(*keys).agg((F.sum(F.when(renewable, F.col(mw)).otherwise(0.0)) * hours).alias("renewable"))
    need = demand.groupBy(*keys).agg((F.sum(load) * hours * target).alias("target"))
    return need.join(made, list(keys), "left").withColumn("renewable", F.coalesce("renewable", F.lit(0.0))).withColumn("slack", F.greatest(F.lit(0.0), F.col("target") - F.col("renewable")))


def co2_excess(df: DataFrame, keys: Sequence[str], t_co2: str, budget: float, share: float = 1.0) -> DataFrame:
    """Emissions above the window's share of a yearly budget."""
    return df.groupBy(*keys).agg(F.sum(t_co2).alias("t_co2")).withColumn("excess", F.greatest(F.lit(0.0), F.col("t_co2") - budget * share))


def curtailment(df: DataFrame, keys: Sequence[str], available: Column, used: str, curtailable: Column) -> DataFrame:
    """Available less used output of units that can be curtailed."""
    left = F.when(curtailable, F.greatest(F.lit(0.0), available - F.col(used))).otherwise(0.0)
    return df.groupBy(*keys).agg(F.sum(left).alias("curtailed"), F.sum(F.when(curtailable, available).otherwise(0.0)).alias("available"))


def reservoir_balance(df: DataFrame, keys: Sequence[str], t: str, level: str, inflow: str, release: str, upstream: str, delay: int = 0) -> DataFrame:
    """Level after each step by the balance, against the level given; upstream water arrives after a delay."""
    w = Window.partitionBy(*keys).orderBy(t)
    arriving = F.coalesce(F.lag(upstream, delay).over(w), F.lit(0.0)) if delay else F.col(upstream)
    expected = F.lag(level).over(w) + F.col(inflow) + arriving - F.col(release)
    return df.withColumn("expected", expected).withColumn("residual", F.col(level) - F.col("expected"))


def storage_violations(df: DataFrame, keys: Sequence[str], t: str, soc: str, charge: str, discharge: str, capacity: str, eta_in: float, eta_out: float, hours: float = 1.0) -> DataFrame:
    """Steps whose state leaves its bounds or does not follow from the step before."""
    w = Window.partitionBy(*keys).orderBy(t)
    expected = F.lag(soc).over(w) + (eta_in * F.col(charge) - F.col(discharge) / eta_out) * hours
    off = F.abs(F.col(soc) - F.col("expected")) > 1e-6
    return df.withColumn("expected", expected).where((F.col(soc) < -1e-9) | (F.col(soc) > F.col(capacity) + 1e-9) | F.coalesce(off, F.lit(False)))


def n1_critical(df: DataFrame, keys: Sequence[str], element: str, flow: str, cap: str, share: float = 0.9) -> DataFrame:
    """Elements whose loading ever reaches a share of their capacity."""
    return df.groupBy(*keys, element).agg(F.max(F.abs(F.col(flow)) / F.col(cap)).alias("loading")).where(F.col("loading") >= share)


def incidence(lines: DataFrame, line: str, a: str, b: str) -> DataFrame:
    """Long incidence matrix: +1 where a line starts, -1 where it ends."""
    ends = F.array(F.struct(F.col(a).alias("node"), F.lit(1).alias("sign")), F.struct(F.col(b).alias("node"), F.lit(-1).alias("sign")))
    return lines.select(line, F.explode(ends).alias("e")).select(line, "e.*")


def admittance(lines: DataFrame, a: str, b: str, r: str, x: str, charging: str) -> DataFrame:
    """Long bus admittance matrix: conductance and susceptance of each pair of buses."""
    z2 = F.col(r) ** 2 + F.col(x) ** 2
    g, s = F.col(r) / z2, -F.col(x) / z2
    cell = lambda i, j, gg, bb: F.struct(i.alias("i"), j.alias("j"), gg.alias("g"), bb.alias("b"))
    own = s + F.col(charging) / 2
    cells = F.array(cell(F.col(a), F.col(a), g, own), cell(F.col(b), F.col(b), g, own), cell(F.col(a), F.col(b), -g, -s), cell(F.col(b), F.col(a), -g, -s))
    return lines.select(F.explode(cells).alias("e")).select("e.*").groupBy("i", "j").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))


def nodal_balance(flows: DataFrame, line: str, a: str, b: str, flow: str, keys: Sequence[str]) -> DataFrame:
    """Net flow out of each node."""
    ends = F.array(F.struct(F.col(a).alias("node"), F.col(flow).alias("f")), F.struct(F.col(b).alias("node"), (-F.col(flow)).alias("f")))
    return flows.select(*keys, F.explode(ends).alias("e")).groupBy(*keys, F.col("e.node").alias("node")).agg(F.sum("e.f").alias("net_out"))


def hydrogen_kg(mw: Column, eff_rated: Column, eff_min: Column, energy_per_kg: Column) -> Column:
    """Hourly hydrogen of an electrolyser at a mean efficiency."""
    return mw * 1000 * (eff_rated + eff_min) / 2 / energy_per_kg


def periods(t: Column, resolution: int, investment: int) -> tuple[Column, Column]:
    """Dispatch period and investment period of an hour."""
    p = F.floor(t / resolution).cast("long")
    return p, F.floor(p / investment).cast("long")


def objective(df: DataFrame, energy: Sequence[str], other: Sequence[str], hours: float, share: float) -> DataFrame:
    """Energy costs by hours plus other costs by the window's share of the year."""
    zero = F.lit(0.0)
    e = sum((F.coalesce(F.sum(c), zero) for c in energy), zero)
    o = sum((F.coalesce(F.sum(c), zero) for c in other), zero)
    return df.agg((e * hours + o * share).alias("objective"))


def sector_residuals(shed: DataFrame, sectors: DataFrame, keys: Sequence[str], mw: str, demand: str) -> DataFrame:
    """``keys, residual, beyond``: what sectors shed less what is shed in all, and how much sectors shed beyond their demand. Steps that
    only one side has count with nothing on the other."""
    own = sectors.groupBy(*keys).agg(F.sum(mw).alias("_own"), F.sum(F.greatest(F.lit(0.0), F.col(mw) - F.greatest(F.lit(0.0), F.col(demand)))).alias("beyond"))
    both = shed.groupBy(*keys).agg(F.sum(mw).alias("_all")).join(own, list(keys), "full")
    zero = F.lit(0.0)
    return both.select(*keys, (F.coalesce("_own", zero) - F.coalesce("_all", zero)).alias("residual"), F.coalesce("beyond", zero).alias("beyond"))


def shift_excess(shifts: DataFrame, demand: DataFrame, keys: Sequence[str], sector: str, mw: str, criticality: str) -> DataFrame:
    """Steps and sectors that shift out more than the part of their demand that is not critical."""
    out = shifts.groupBy(*keys, sector).agg(F.sum(mw).alias("_out"))
    d = demand.groupBy(*keys, sector).agg(F.sum(mw).alias("_d"), F.max(criticality).alias("_c"))
    most = (1 - F.coalesce("_c", F.lit(1.0))) * F.greatest(F.lit(0.0), F.coalesce("_d", F.lit(0.0)))
    return out.join(d, [*keys, sector], "left").withColumn("excess", F.col("_out") - most).where(F.col("excess") > 1e-9).select(*keys, sector, "excess")


def fuel_shortfall(output: DataFrame, fuel: DataFrame, plants: DataFrame, keys: Sequence[str], plant: str, mw: str, tons: str, mwh_a_ton: str, hours: float = 1.0) -> DataFrame:
    """Energy that plants give beyond what their fuel gives, by plant and step; plants without a conversion need none."""
    made = output.groupBy(*keys, plant).agg((F.sum(mw) * hours).alias("_mwh")).join(plants.where(F.col(mwh_a_ton) > 1e-6), plant)
    burnt = fuel.groupBy(*keys, plant).agg(F.sum(tons).alias("_tons"))
    short = F.col("_mwh") - F.coalesce("_tons", F.lit(0.0)) * F.col(mwh_a_ton)
    return made.join(burnt, [*keys, plant], "left").withColumn("shortfall", short).where(F.col("shortfall") > 1e-6).select(*keys, plant, "shortfall")


def link_findings(links: DataFrame, invested: DataFrame, link: str, start: str, end: str, most: str, year: str, mw: str) -> DataFrame:
    """``link, rule, year, amount``: links between systems whose investments of all years exceed their limit (``limit``; the year is
    null), and pairs of links in opposite directions that are not built alike in a year (``symmetry``, under the lesser link)."""
    total = invested.groupBy(link).agg(F.sum(mw).alias("_t")).join(links.where(F.col(most) > 0), link)
    over = total.where(F.col("_t") > F.col(most) + 1e-9).select(link, F.lit("limit").alias("rule"), F.lit(None).cast("int").alias("year"), (F.col("_t") - F.col(most)).alias("amount"))
    back = links.select(F.col(link).alias("_back"), F.col(start).alias("_e"), F.col(end).alias("_s"))
    pairs = links.join(back, (F.col(start) == F.col("_s")) & (F.col(end) == F.col("_e")) & (F.col(link) < F.col("_back"))).select(link, "_back")
    mine = pairs.join(invested.select(F.col(link), F.col(year).cast("int").alias("year"), F.col(mw).alias("_m")), link)
    theirs = pairs.join(invested.select(F.col(link).alias("_back"), F.col(year).cast("int").alias("year"), F.col(mw).alias("_o")), "_back")
    both = mine.join(theirs, [link, "_back", "year"], "full")
    apart = F.coalesce("_m", F.lit(0.0)) - F.coalesce("_o", F.lit(0.0))
    return over.unionByName(both.where(F.abs(apart) > 1e-9).select(link, F.lit("symmetry").alias("rule"), "year", apart.alias("amount")))
