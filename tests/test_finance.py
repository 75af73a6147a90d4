"""Cash flows, what-if analyses, adoption and bias correction."""

import math

import numpy as np
from pyspark.sql import functions as F

from wattspan.operators import adoption as ad
from wattspan.operators import finance as fn


def yearly(spark):
    return spark.createDataFrame([("p", 2025, 0.0, 0.0, 100.0), ("p", 2026, 80.0, 20.0, 0.0), ("p", 2027, 80.0, 20.0, 0.0)], "k string, year int, revenue double, opex double, capex double")


def test_cash_flow(spark):
    f = fn.cash_flow(yearly(spark), ["k"], "year", 0.1, 0.25, 2025).withColumn("debt", F.lit(10.0))
    net = {r["year"]: (r["tax"], r["net"]) for r in f.collect()}
    assert net == {2025: (0, -100), 2026: (15, 45), 2027: (15, 45)}
    m = fn.project_metrics(f, ["k"], "year", "debt").first()
    assert math.isclose(m["npv"], -100 + 45 / 1.1 + 45 / 1.21) and m["payback"] is None and m["min_dscr"] == -9
    assert abs(-100 + 45 / (1 + m["irr"]) + 45 / (1 + m["irr"]) ** 2) < 1e-3


def test_what_if(spark):
    parts = {"revenue": 1, "opex": -1, "capex": -1}
    s = fn.sweep(yearly(spark), "year", parts, [-0.2, 0.0, 0.2], 0.1, 2025)
    got = {(r["parameter"], r["step"]): r["npv"] for r in s.collect()}
    base = -100 + 60 / 1.1 + 60 / 1.21
    assert math.isclose(got["capex", 0.0], base) and math.isclose(got["capex", -0.2], base + 20)
    be = {r["parameter"]: r["break_even"] for r in fn.break_even(s).collect()}
    assert math.isclose(be["capex"], base / 100)
    mc = fn.monte_carlo(yearly(spark), "year", parts, {"revenue": 0.1}, 400, 0.1, 2025).agg(F.avg("npv"), F.stddev("npv")).first()
    assert abs(mc[0] - base) < 3 and abs(mc[1] - 0.1 * 80 * (1 / 1.1 + 1 / 1.21)) < 2
    e = fn.system_lcoe(yearly(spark).withColumn("f", F.lit(1.0)).withColumn("mwh", F.lit(10.0)).withColumn("fuel", F.lit(0.0)), ["k"], "fuel", "opex", "capex", "mwh", "f").first()
    assert math.isclose(e["lcoe"], 140 / 30)


def test_adoption(spark):
    hours = spark.range(24).select(F.col("id").cast("double").alias("h"))
    day = hours.select(ad.charging_profile(F.lit(1000.0), 8.0, F.col("h"), 20.0, 3.0).alias("mw")).agg(F.sum("mw")).first()[0]
    assert math.isclose(day, 8.0)
    assert spark.range(1).select(ad.v2g_available(F.lit(1000.0), F.lit(0.5), 0.4, 7.0, 0.5)).first()[0] == 0.7


def test_quantile_mapping(spark):
    rng = np.random.default_rng(3)
    m, o = rng.normal(0, 1, 800), rng.normal(5, 2, 800)
    frame = lambda v: spark.createDataFrame([(1, float(x)) for x in v], "k int, v double")
    r = ad.quantile_map(frame(m), frame(o), ["k"], "v").agg(F.avg("corrected"), F.stddev("corrected"), F.max("corrected")).first()
    assert abs(r[0] - o.mean()) < 0.05 and abs(r[1] - o.std()) < 0.05 and math.isclose(r[2], o.max())
