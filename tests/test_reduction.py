"""Reduction and expansion of networks, outages, and the bounded simplex, each against a plain solution."""

import numpy as np
import pytest

from wattspan.operators import dispatch as dp
from wattspan.operators import planning as pl
from wattspan.operators import reduction as rd
from wattspan.operators import security as se


def random_network(rng, n, extra):
    """A connected network: a random tree and some more lines."""
    lines = [(k, int(rng.integers(0, k)), k) for k in range(1, n)]
    lines += [(n + k, *map(int, rng.choice(n, 2, replace=False))) for k in range(extra)]
    return [(i, a, b, float(rng.uniform(0.05, 0.5)), float(rng.uniform(20, 100))) for i, (_, a, b) in enumerate(lines)]


def angles(lines, injection):
    buses = sorted(injection)
    at = {n: i for i, n in enumerate(buses)}
    lap = np.zeros((len(buses), len(buses)))
    for _, a, b, x, _ in lines:
        i, j = at[a], at[b]
        lap[i, i] += 1 / x
        lap[j, j] += 1 / x
        lap[i, j] -= 1 / x
        lap[j, i] -= 1 / x
    theta = np.zeros(len(buses))
    theta[1:] = np.linalg.solve(lap[1:, 1:], np.array([injection[n] for n in buses])[1:])
    return dict(zip(buses, theta, strict=True))


@pytest.mark.parametrize("star", [False, True])
def test_reduction_keeps_flows_and_angles(spark, star):
    rng = np.random.default_rng(5)
    rows, kept, want = [], [], {}
    for key in range(6):
        lines = random_network(rng, 25, 6 if key else 0)
        stay = sorted(map(int, rng.choice(25, 5, replace=False)))
        mw = {n: 0.0 for n in range(25)}
        for n in stay[1:]:
            mw[n] = float(rng.normal() * 10)
        mw[stay[0]] = -sum(mw.values())
        rows += [(key, *x) for x in lines]
        kept += [(key, n) for n in stay]
        want[key] = (lines, stay, mw, angles(lines, mw))
    frame = spark.createDataFrame(rows, "k int, line long, a long, b long, x double, cap double")
    m = rd.reduce_networks(frame, "k", spark.createDataFrame(kept, "k int, bus long"), star).cache()
    found, flows, values = {}, [], []
    for r in m.where("kind = 'line'").collect():
        found.setdefault(r["k"], []).append((0, r["a"], r["b"], r["x"], r["cap"]))
    for key, (lines, stay, mw, theta) in want.items():
        small = found[key]
        assert len(small) < len(lines)
        buses = {n for x in small for n in x[1:3]}
        assert buses >= {n for n in stay if mw[n]}
        inner = angles(small, {n: mw[n] for n in buses})
        shift = theta[min(buses)] - inner[min(buses)]
        assert all(np.isclose(inner[n] + shift, theta[n]) for n in buses)
        flows += [(key, a, b, float((inner[a] - inner[b]) / x)) for _, a, b, x, _ in small]
        values += [(key, n, float(inner[n] + shift)) for n in buses]
    for r in rd.expand_lines(m, "k", spark.createDataFrame(flows, "k int, a long, b long, flow double")).collect():
        _, a, b, x, _ = want[r["k"]][0][[y[0] for y in want[r["k"]][0]].index(r["line"])]
        theta = want[r["k"]][3]
        assert np.isclose(r["flow"], (theta[a] - theta[b]) / x, atol=1e-6)
    for r in rd.expand_buses(m, "k", spark.createDataFrame(values, "k int, bus long, v double"), "v").collect():
        assert np.isclose(r["v"], want[r["k"]][3][r["bus"]], atol=1e-6)


def test_long_trees_are_pruned_whole(spark):
    rows = [(1, k, k, k + 1, 0.1, 10.0) for k in range(300)]
    frame = spark.createDataFrame(rows, "k int, line long, a long, b long, x double, cap double")
    m = rd.reduce_networks(frame, "k", spark.createDataFrame([(1, 0)], "k int, bus long"))
    assert m.where("kind = 'line'").count() == 0
    assert {(r["a"], r["b"], r["weight"]) for r in m.where("kind = 'bus_map'").collect()} == {(n, 0, 1.0) for n in range(301)}


def test_line_losses_on_a_mesh(spark):
    rng = np.random.default_rng(3)
    lines = random_network(rng, 8, 5)
    mw = {n: float(rng.normal() * 20) for n in range(1, 8)}
    mw[0] = -sum(mw.values())
    frame = spark.createDataFrame([(1, *x) for x in lines], "k int, line long, a long, b long, x double, cap double")
    given = spark.createDataFrame([(1, n, v) for n, v in mw.items()], "k int, bus long, mw double")
    got = se.line_losses(frame, given, "k").collect()
    assert len(got) == len(lines) * (len(lines) - 1)
    for k in range(len(lines)):
        rest = [x for x in lines if x[0] != k]
        mine = {r["line"]: r["flow"] for r in got if r["outage"] == k}
        try:
            theta = angles(rest, mw)
        except np.linalg.LinAlgError:
            assert any(v is None for v in mine.values())
            continue
        if any(v is None for v in mine.values()):
            continue  # an island that does not balance
        for line, a, b, x, _ in rest:
            assert np.isclose(mine[line], (theta[a] - theta[b]) / x, atol=1e-6)
    double = se.line_losses(frame, given, "k", double=True)
    assert double.where("second IS NULL").count() == 0
    assert [r["rank"] for r in se.worst_pairs(double, "k", 3).orderBy("rank").collect()] == [1, 2, 3]


def test_bounded_simplex_is_simplex():
    rng = np.random.default_rng(8)
    for _ in range(60):
        n, m = int(rng.integers(2, 7)), int(rng.integers(1, 3))
        c, a, upper = rng.normal(size=n), rng.uniform(0.1, 1, size=(m, n)), rng.uniform(0.5, 3, n)
        b = a @ (upper * rng.uniform(0, 1, n))
        x, z = dp.bounded_simplex(c, a, b, upper)
        rows = np.vstack([a, np.eye(n)])
        y, w = dp.simplex(c, rows, np.append(b, upper), ["="] * m + ["<="] * n)
        assert np.isclose(z, w) and np.allclose(a @ x, b) and (x >= -1e-9).all() and (x <= upper + 1e-9).all()
    with pytest.raises(ValueError, match="infeasible"):
        dp.bounded_simplex(np.ones(1), np.ones((1, 1)), np.array([2.0]), np.ones(1))
    with pytest.raises(ValueError, match="unbounded"):
        dp.bounded_simplex(np.array([-1.0, 0.0]), np.array([[1.0, -1.0]]), np.zeros(1), np.full(2, np.inf))


def test_linear_program_with_a_budget(spark):
    rows = [(1, u, 100.0, c, 50.0) for u, c in ((1, 10.0), (2, 20.0))] + [(2, 1, 100.0, 10.0, 60.0)]
    frame = spark.createDataFrame(rows, "t int, unit int, cap double, cost double, load double")
    got = dp.lp_dispatch(frame, ["t"], "unit", "cap", "cost", "load", budget=40.0).collect()
    assert {(r["t"], r["unit"]): (r["dispatch"], r["shed"]) for r in got} == {(1, 1): (40.0, 10.0), (1, 2): (0.0, 10.0), (2, 1): (40.0, 20.0)}
    assert dp.lp_dispatch(frame.limit(0), ["t"], "unit", "cap", "cost", "load").count() == 0


def test_projection_and_linkage(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(30, 4)) * [1, 3, 0.5, 0]
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "id int, a double, b double, c double, d double")
    got = np.array([[r["pc1"], r["pc2"]] for r in pl.projection(frame, "id", ["a", "b", "c", "d"]).orderBy("id").collect()])
    z = (m - m.mean(0)) / np.where(m.std(0) > 0, m.std(0), 1)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-6)
    points = np.array([0.0, 0.1, 0.2, 5.0, 5.1, 9.0])
    assert pl.average_linkage(np.abs(points[:, None] - points[None]), 3).tolist() == [0, 0, 0, 1, 1, 2]
