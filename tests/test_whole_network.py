"""Network queries and operators over whole tables, against plain versions."""

import numpy as np
import pytest
from conftest import DATA

from wattspan import catalog
from wattspan.operators import network as net
from wattspan.operators import security
from wattspan.queries import planning


def flows(nodes, ln, inj):
    """DC flows by a solution of the nodal balance; nodes are numbered from 0."""
    at = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(ln), len(nodes)))
    for k, (a, b, _) in enumerate(ln):
        m[k, at[a]], m[k, at[b]] = 1, -1
    y = np.array([1 / x for _, _, x in ln])
    theta = np.linalg.lstsq((m.T * y) @ m, inj, rcond=None)[0]
    return y * (m @ theta)


def test_outage_factors_are_those_of_the_whole_network(spark):
    m = net.merge_parallel(planning.lines(spark, str(DATA)), "a", "b", "x", "r", "cap").toPandas().sort_values(["from_node", "to_node"])
    ln = list(m[["from_node", "to_node", "x"]].itertuples(index=False, name=None))
    assert len(ln) > 60
    nodes = sorted({n for a, b, _ in ln for n in (a, b)})
    got = catalog.QUERIES["ptdf_lodf"](spark, str(DATA)).toPandas()
    assert len(got) == len(ln) ** 2
    f = got.pivot(index="line", columns="outage", values="lodf").to_numpy()
    inj = np.cos(np.arange(len(nodes)))
    inj -= inj.mean()
    before = flows(nodes, ln, inj)
    for k in range(0, len(ln), 7):
        after = flows(nodes, ln[:k] + ln[k + 1 :], inj)
        np.testing.assert_allclose(np.delete(before + f[:, k] * before[k], k), after, atol=1e-8)


def plain_components(edges, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for n in nodes}


def test_components_take_every_order(spark):
    o = spark.read.parquet(f"{DATA}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    edges = {(c, c * 7 % 100 + k % 5) for c, k in o}
    edges = {(a, b) for a, b in edges if a != b}
    want = plain_components(edges, {n for e in edges for n in e})
    third = {(c, c * 7 % 100 + k % 5) for c, k in o if k % 3 == 0}
    assert len({e for e in third if e[0] != e[1]}) < len(edges)
    got = {r["node"]: r["component"] for r in catalog.QUERIES["components"](spark, str(DATA)).collect()}
    assert got == want


def test_components_of_a_shuffled_chain(spark):
    order = np.random.default_rng(7).permutation(1000).tolist()
    edges = [*zip(order, order[1:]), (2000, 2001), (2001, 2001)]
    nodes = [*order, 2000, 2001, 3000]
    c = net.connected_components(spark.createDataFrame(edges, "a int, b int"), spark.createDataFrame([(n,) for n in nodes], "node int"))
    assert {r["node"]: r["component"] for r in c.collect()} == {**dict.fromkeys(order, 0), 2000: 2000, 2001: 2000, 3000: 3000}


def test_long_feeders_are_pruned_and_contracted_to_the_end(spark):
    feeder = spark.createDataFrame([(0, 1), (1, 2), (2, 0)] + [(i, i + 1) for i in range(2, 26)], "a int, b int")
    assert {tuple(r) for r in net.prune_leaves(feeder).collect()} == {(0, 1), (1, 2), (2, 0)}
    chain = spark.createDataFrame([(i, i + 1, 0.1, 50.0 + i) for i in range(60)], "a int, b int, x double, c double")
    (r,) = net.series_chains(chain, "a", "b", "x", "c").collect()
    assert {r["a"], r["b"]} == {0, 60} and abs(r["x"] - 6.0) < 1e-9 and r["cap"] == 50.0


def test_updates_of_a_factored_network_are_what_solving_anew_gives():
    rng = np.random.default_rng(5)
    for n, m in ((6, 9), (8, 7), (5, 5)):
        ends = np.array([rng.choice(n, 2, replace=False) for _ in range(m)])
        x = rng.uniform(0.1, 1, m)
        inj = rng.normal(size=n)
        net_ = security.Factored(ends, x, inj - inj.mean())
        for lost in [[k] for k in range(m)] + [[j, k] for j in range(m) for k in range(m) if j != k]:
            keep = np.setdiff1d(np.arange(m), lost)
            np.testing.assert_allclose(net_.after(lost), security.dc_flows(ends[keep], x[keep], inj - inj.mean()), atol=1e-8)


def test_outage_factors_of_a_mesh_with_a_cut(spark):
    lines = [(1, 1, 1, 2, 0.2), (1, 2, 2, 3, 0.3), (1, 3, 1, 3, 0.5), (1, 4, 3, 4, 0.1)]
    got = {(r["line"], r["outage"]): r["lodf"] for r in security.outage_factors(spark.createDataFrame(lines, "net int, line long, a long, b long, x double"), "net").collect()}
    assert got[1, 1] == -1 and got[3, 1] == pytest.approx(1) and got[2, 1] == pytest.approx(-1) and got[4, 1] == pytest.approx(0)
    assert all(got[k, 4] is None for k in (1, 2, 3)) and got[4, 4] == -1
    inj = spark.createDataFrame([(1, 1, 3.0), (1, 4, -3.0)], "net int, bus long, mw double")
    flows = {r["line"]: r["flow"] for r in security.mesh_flows(spark.createDataFrame(lines, "net int, line long, a long, b long, x double"), inj, "net").collect()}
    assert flows == pytest.approx({1: 1.5, 2: 1.5, 3: 1.5, 4: 3.0})
