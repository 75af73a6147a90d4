"""Constraint checks, AC power flow and mapped features on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from wattspan.operators import checks as ck
from wattspan.operators import features as ft
from wattspan.operators import powerflow as pf


def test_commitment_spans(spark):
    on = [0, 1, 0, 0, 1, 1, 1, 0]
    df = spark.createDataFrame([("u", i, x) for i, x in enumerate(on)], "k string, t int, on int")
    spans = [(r["state"], r["length"], r["edge"]) for r in ck.run_lengths(df, ["k"], "t", F.col("on") > 0).orderBy("start").collect()]
    assert spans == [(0, 1, True), (1, 1, False), (0, 2, False), (1, 3, False), (0, 1, True)]
    bad = ck.commitment_violations(df, ["k"], "t", F.col("on") > 0, 2, 3).orderBy("start").collect()
    assert [(r["state"], r["start"]) for r in bad] == [(1, 1), (0, 2)]


def test_storage_and_reservoir(spark):
    df = spark.createDataFrame([("b", 0, 10.0, 0.0, 0.0, 20.0), ("b", 1, 19.0, 10.0, 0.0, 20.0), ("b", 2, 25.0, 1.0, 0.0, 20.0)], "k string, t int, soc double, c double, x double, cap double")
    assert [r["t"] for r in ck.storage_violations(df, ["k"], "t", "soc", "c", "x", "cap", 0.9, 0.9).collect()] == [2]
    r = spark.createDataFrame([("h", 0, 100.0, 0.0, 0.0, 7.0), ("h", 1, 112.0, 10.0, 5.0, 0.0)], "k string, t int, l double, i double, o double, u double")
    assert [x["residual"] for x in ck.reservoir_balance(r, ["k"], "t", "l", "i", "o", "u", 1).orderBy("t").collect()] == [None, 0.0]


def test_matrices(spark):
    lines = spark.createDataFrame([(0, 0, 1, 0.1, 0.2, 0.0, 5.0), (1, 1, 2, 0.0, 0.5, 0.0, 3.0)], "line int, a int, b int, r double, x double, c double, f double")
    y = {(r["i"], r["j"]): complex(r["g"], r["b"]) for r in ck.admittance(lines, "a", "b", "r", "x", "c").collect()}
    assert np.isclose(y[0, 1], -1 / (0.1 + 0.2j)) and np.isclose(y[1, 1], 1 / (0.1 + 0.2j) + 1 / 0.5j)
    assert {(r["line"], r["node"]): r["sign"] for r in ck.incidence(lines, "line", "a", "b").collect()} == {(0, 0): 1, (0, 1): -1, (1, 1): 1, (1, 2): -1}
    assert {r["node"]: r["net_out"] for r in ck.nodal_balance(lines, "line", "a", "b", "f", []).collect()} == {0: 5, 1: -2, 2: -3}


def test_power_flow_balances(spark):
    lines = [(0, 1, 0.01, 0.1, 0.02), (1, 2, 0.02, 0.15, 0.0), (0, 2, 0.01, 0.12, 0.0)]
    rows = [(s, 0, 0, 0.0, 0.0, 1.0) for s in (1, 2)] + [(s, 1, 1, 0.4, 0.0, 1.01) for s in (1, 2)] + [(s, 2, 2, -0.5 * s, -0.2, 1.0) for s in (1, 2)]
    got = pf.power_flow(spark.createDataFrame(rows, "s int, bus int, kind int, p double, q double, v double"), lines, "s").orderBy("s", "bus").collect()
    assert all(r["converged"] for r in got)
    for s in (1, 2):
        u = np.array([r["v"] * np.exp(1j * r["angle"]) for r in got if r["s"] == s])
        out = {}
        for a, b, r, x, c in lines:
            i = (u[a] - u[b]) / complex(r, x)
            out[a] = out.get(a, 0) + u[a] * np.conj(i + u[a] * 1j * c / 2)
            out[b] = out.get(b, 0) + u[b] * np.conj(-i + u[b] * 1j * c / 2)
        assert np.isclose(out[2], complex(-0.5 * s, -0.2)) and np.isclose(out[1].real, 0.4) and np.isclose(abs(u[1]), 1.01)


def test_features(spark):
    f = spark.createDataFrame([(1, 0.0, 0.0, 2, "Plant A"), (2, 0.01, 0.0, 1, "plant  a unit 2"), (3, 5.0, 5.0, 1, "B")], "id int, lat double, lon double, p int, name string")
    assert [r["id"] for r in ft.keep_by_priority(f, "id", "lat", "lon", 3.0, F.col("p")).orderBy("id").collect()] == [2, 3]
    assert [(r["a"], r["b"]) for r in ft.close_pairs(f, "id", "lat", "lon", 3.0).collect()] == [(1, 2)]
    assert ft.duplicate_names(f, "id", "name").first()["ids"] == [1, 2]
    nodes = spark.createDataFrame([(0,), (1,), (9,)], "node int")
    lines = spark.createDataFrame([(7, 0, 1), (8, 1, 5), (6, 1, 1)], "line int, a int, b int")
    units = spark.createDataFrame([(1, 0, 5.0), (2, 4, 5.0), (3, 1, 0.0)], "unit int, node int, rated_mw double")
    got = {(r["rule"], r["element"]) for r in ft.issues(ft.network_rules(nodes, lines, units)).collect()}
    assert got == {("dangling_line", "8"), ("self_loop", "6"), ("isolated_node", "9"), ("unit_without_node", "2"), ("unit_without_capacity", "3")}
