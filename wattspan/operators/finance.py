"""Cash flows, levelised costs and what-if analyses over yearly tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspan.functions import finance as fin
from wattspan.operators.metrics import ratio

#: Yearly columns of a cash-flow table; what is missing counts as nothing.
INFLOWS = ("revenue", "production_credit", "investment_credit", "salvage")
OUTFLOWS = ("opex", "insurance", "carbon", "penalties", "capex")


def cash_flow(yearly: DataFrame, keys: Sequence[str], year: str, rate: float, tax_rate: float, first_year: int) -> DataFrame:
    """Net flow of each year, tax on what is taxable, discount factor, and running present value.

    Taxable is revenue less running costs, depreciation and interest; losses are not carried.
    """
    have = set(yearly.columns)
    col = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    running = col("opex") + col("insurance") + col("carbon") + col("penalties")
    taxable = col("revenue") - running - col("depreciation") - col("interest")
    out = yearly.withColumn("tax", F.greatest(F.lit(0.0), taxable * tax_rate))
    net = sum((col(c) for c in INFLOWS), F.lit(0.0)) - sum((col(c) for c in OUTFLOWS), F.lit(0.0)) - F.col("tax")
    out = out.withColumn("net", net).withColumn("factor", fin.discount(rate, F.col(year) - first_year))
    w = Window.partitionBy(*keys).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("npv_to_date", F.sum(F.col("net") * F.col("factor")).over(w))


def project_metrics(flows: DataFrame, keys: Sequence[str], year: str, debt_service: str | None = None) -> DataFrame:
    """Net present value, internal rate of return, first year without a shortfall, and debt cover."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(year), F.col("net")))), lambda x: x["net"])
    cover = []
    if debt_service:
        cfads = F.col("net") + F.col(debt_service)
        ratio_ = F.when(F.col(debt_service) > 0, cfads / F.col(debt_service)).otherwise(float("inf"))
        cover = [F.min(ratio_).alias("min_dscr"), ratio(F.sum(cfads * F.col("factor")), F.sum(F.col(debt_service) * F.col("factor"))).alias("llcr")]
    out = flows.groupBy(*keys).agg(F.sum(F.col("net") * F.col("factor")).alias("npv"), ordered.alias("_flows"), fin.payback(F.col(year), F.col("npv_to_date")).alias("payback"), *cover)
    return out.withColumn("irr", fin.irr(F.col("_flows"))).drop("_flows")


def system_lcoe(yearly: DataFrame, keys: Sequence[str], fuel: str, om: str, capex: str, mwh: str, factor: str) -> DataFrame:
    """Present value of fuel, running costs and investment over discounted energy."""
    pv = lambda c: F.sum(F.col(c) * F.col(factor))
    return yearly.groupBy(*keys).agg(ratio(pv(fuel) + pv(om) + pv(capex), pv(mwh)).alias("lcoe"), pv(fuel).alias("npv_fuel"), pv(om).alias("npv_om"), pv(capex).alias("npv_capex"))


def storage_metrics(df: DataFrame, keys: Sequence[str], charge: str, discharge: str, price: str, fixed: float = 0.0) -> DataFrame:
    """Arbitrage margin and levelised cost of storage of discharged energy."""
    out = df.groupBy(*keys).agg(F.sum(F.col(discharge) * F.col(price)).alias("sold"), F.sum(F.col(charge) * F.col(price)).alias("bought"), F.sum(discharge).alias("mwh"))
    return out.withColumn("arbitrage", F.col("sold") - F.col("bought")).withColumn("lcos", ratio(F.col("bought") + fixed, F.col("mwh")))


def sweep(yearly: DataFrame, year: str, parts: Mapping[str, int], steps: Sequence[float], rate: float, first_year: int) -> DataFrame:
    """One parameter at a time: present value with each part scaled by ``1 + step``. Parts are columns with the
    sign of their effect. The sweep multiplies yearly sums, not facts."""
    sums = yearly.groupBy(year).agg(*(F.sum(c).alias(c) for c in parts))
    cases = F.array(*(F.struct(F.lit(p).alias("parameter"), F.lit(float(s)).alias("step")) for p in parts for s in steps))
    x = sums.withColumn("_e", F.explode(cases)).select(year, *parts, "_e.*")
    net = sum((sign * F.col(c) * F.when(F.col("parameter") == c, 1 + F.col("step")).otherwise(1.0) for c, sign in parts.items()), F.lit(0.0))
    return x.groupBy("parameter", "step").agg(fin.npv(net, rate, F.col(year) - first_year).alias("npv"))


def break_even(swept: DataFrame) -> DataFrame:
    """The step where the present value of each parameter crosses zero, by interpolation; null if it does not."""
    w = Window.partitionBy("parameter").orderBy("step")
    x = swept.withColumn("_s", F.lead("step").over(w)).withColumn("_n", F.lead("npv").over(w))
    cross = F.col("step") + (F.col("_s") - F.col("step")) * F.col("npv") / (F.col("npv") - F.col("_n"))
    hit = F.when(F.col("npv") == 0, F.col("step")).when(F.col("npv") * F.col("_n") < 0, cross)
    return x.groupBy("parameter").agg(F.min(hit).alias("break_even"))


def monte_carlo(yearly: DataFrame, year: str, parts: Mapping[str, int], spread: Mapping[str, float], n: int, rate: float, first_year: int, seed: int = 42) -> DataFrame:
    """Present values of ``n`` draws of normal factors around 1, drawn on the driver from a seed.

    Draws multiply yearly sums: the product is as many rows as draws times years.
    """
    rng = np.random.default_rng(seed)
    draws = {c: rng.normal(1.0, spread.get(c, 0.0), n) for c in parts}
    rows = [(i, *(float(draws[c][i]) for c in parts)) for i in range(n)]
    factors = yearly.sparkSession.createDataFrame(rows, "draw int, " + ", ".join(f"f_{c} double" for c in parts))
    sums = yearly.groupBy(year).agg(*(F.sum(c).alias(c) for c in parts))
    x = factors.join(F.broadcast(sums))
    net = sum((sign * F.col(c) * F.col(f"f_{c}") for c, sign in parts.items()), F.lit(0.0))
    return x.groupBy("draw").agg(fin.npv(net, rate, F.col(year) - first_year).alias("npv"))


def renewable_project(df: DataFrame, key: str, mw: Column, cf: Column, capex_kw: float, opex_kw: float, price: float, rate: float, years: int, degradation: float) -> DataFrame:
    """Levelised cost of the first year, present value, energy over the life, and payback within a year by interpolation; the life
    where it never pays back. A project's years are an array, so nothing is shuffled."""
    capex, opex, first = mw * 1000 * capex_kw, mw * 1000 * opex_kw, mw * cf * 8760.0
    steps = F.sequence(F.lit(1), F.lit(years))
    mwh = F.transform(steps, lambda t: first * F.pow(F.lit(1 - degradation), t - 1))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    x = df.withColumns({"_capex": capex, "_opex": opex, "_mwh": mwh}).withColumn("_cf", F.transform("_mwh", lambda e: e * price - F.col("_opex")))
    upto = lambda t: add(F.slice("_cf", F.lit(1), t)) - F.col("_capex")
    paid = F.array_min(F.filter(F.transform(steps, lambda t: F.when(upto(t) >= 0, t - 1 + (F.element_at("_cf", t) - upto(t)) / F.element_at("_cf", t))), lambda v: v.isNotNull()))
    return x.select(
        key, ((F.col("_capex") * fin.crf(F.lit(rate), F.lit(years)) + F.col("_opex")) / F.element_at("_mwh", 1)).alias("lcoe"),
        (add(F.transform("_cf", lambda c, i: c / F.pow(F.lit(1 + rate), i + 1))) - F.col("_capex")).alias("npv"), add(F.col("_mwh")).alias("mwh"), F.coalesce(paid, F.lit(float(years))).alias("payback"),
    )
