"""Stores with limits against a loop, trees and bridges against removal of each edge."""

import random

import pytest
from pyspark.sql import functions as F

from wattspan.operators import network as net
from wattspan.operators import storage, trees


@pytest.mark.parametrize("block,steps", [(4, 300), (256, 40)])
def test_levels_of_a_store(spark, block, steps):
    rng = random.Random(block)
    rows = [(k, t, rng.uniform(-30, 30)) for k in ("a", "b", None) for t in range(steps) if rng.random() < 0.9 or t == 0]
    rows = [r for r in rows if r[0] is not None]
    df = spark.createDataFrame(rows, "k string, t int, d double").repartition(3)
    start = spark.createDataFrame([("a", 20.0), ("b", 60.0)], "k string, start double")
    got = {(r["k"], r["t"]): r for r in storage.bounded_levels(df, ["k"], "t", "d", F.lit(5.0), F.lit(60.0), start, keep=0.99, block=block).collect()}
    assert len(got) == len(rows)
    for k, x in (("a", 20.0), ("b", 60.0)):
        for _, t, d in sorted(r for r in rows if r[0] == k):
            free = 0.99 * x + d
            x = min(60.0, max(5.0, free))
            r = got[k, t]
            assert (r["level"], r["spill"], r["shortage"]) == pytest.approx((x, max(0, free - 60), max(0, 5 - free)), abs=1e-9)


def test_bounds_of_each_step_and_return(spark):
    rows = [("a", 0, 5.0, 0.0, 10.0), ("a", 1, 50.0, 0.0, 12.0), ("a", 2, 0.0, 0.0, 8.0), ("a", 3, -20.0, 1.0, 8.0)]
    df = spark.createDataFrame(rows, "k string, t int, d double, lo double, hi double")
    start = spark.createDataFrame([("a", 3.0), ("b", 4.0)], "k string, start double")
    levels = storage.bounded_levels(df, ["k"], "t", "d", F.col("lo"), F.col("hi"), start, block=2)
    assert [r["level"] for r in levels.orderBy("t").collect()] == [8.0, 12.0, 8.0, 1.0]
    assert {r["k"]: r["gap"] for r in storage.cyclic_gap(levels, ["k"], "t", start).collect()} == {"a": -2.0, "b": 0.0}
    assert storage.bounded_levels(df.limit(0), ["k"], "t", "d", F.col("lo"), F.col("hi"), start).count() == 0


def plain_flows(pairs, inj):
    pairs = sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})
    out = {}
    for e in pairs:
        beside: dict = {}
        for a, b in pairs:
            if (a, b) != e:
                beside.setdefault(a, []).append(b)
                beside.setdefault(b, []).append(a)
        seen, stack = {e[0]}, [e[0]]
        while stack:
            for v in beside.get(stack.pop(), []):
                if v not in seen:
                    seen.add(v)
                    stack.append(v)
        out[e] = (True, abs(sum(inj.get(n, 0.0) for n in seen))) if e[1] not in seen else (False, 0.0)
    return out


def plain_pruned(pairs, kept):
    while True:
        degree: dict = {}
        for p in pairs:
            for n in p:
                degree[n] = degree.get(n, 0) + 1
        left = [p for p in pairs if not any(degree[n] == 1 and n not in kept for n in p)]
        if len(left) == len(pairs):
            return sorted(pairs)
        pairs = left


@pytest.mark.parametrize("seed", [1, 2])
def test_bridges_flows_and_pruning(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(50), rng.randrange(50)) for _ in range(46)] + [(100, 101), (200, 200), (7, 300), (7, 300)]
    inj = {i: rng.uniform(-5, 5) for i in range(50)}
    edges = spark.createDataFrame(pairs, "a int, b int")
    got = {(r["a"], r["b"]): (r["bridge"], r["flow"]) for r in trees.bridge_flows(edges, spark.createDataFrame(list(inj.items()), "node int, mw double")).collect()}
    want = plain_flows(pairs, inj)
    assert got.keys() == want.keys()
    for k, (bridge, flow) in want.items():
        assert got[k][0] == bridge and got[k][1] == pytest.approx(flow, abs=1e-9)
    kept = spark.createDataFrame([(1,), (2,), (100,)], "node int")
    assert sorted((r["a"], r["b"]) for r in net.prune_leaves(edges, kept).collect()) == plain_pruned(pairs, {1, 2, 100})
    assert sorted((r["a"], r["b"]) for r in net.prune_leaves(edges).collect()) == plain_pruned(pairs, set())


def test_a_long_feeder(spark):
    """10,000 lines in a row, numbered at random."""
    ids = list(range(10_001))
    random.Random(3).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a int, b int")
    found = trees.bridge_flows(edges, spark.createDataFrame([(ids[0], 7.0), (ids[-1], -7.0)], "node int, mw double"))
    r = found.agg(F.count("*").alias("n"), F.min("flow").alias("lo"), F.max("flow").alias("hi"), F.min(F.col("bridge").cast("int")).alias("all")).first()
    assert (r["n"], r["lo"], r["hi"], r["all"]) == (10_000, 7.0, 7.0, 1)


def test_no_edges(spark):
    none = spark.createDataFrame([], "a int, b int")
    assert trees.bridge_flows(none, spark.createDataFrame([], "node int, mw double")).count() == 0
    assert net.prune_leaves(none).count() == 0
