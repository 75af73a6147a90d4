"""Containment, cut lines, hulls, cells, joint hazards, fits, adoption and elbows against plain versions."""

import math
import random
from itertools import pairwise
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattspan.operators import adoption, containment, demand, geometry, risk


def test_containment_is_that_of_all_pairs(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abAB éÉ") for _ in range(n))
    needles = [(0, None), (1, ""), *[(i, word(rng.randrange(1, 6))) for i in range(2, 60)]]
    hays = [(0, None), (1, ""), *[(i, word(rng.randrange(0, 12))) for i in range(2, 80)]]
    got = containment.contained(spark.createDataFrame(needles, "n int, nt string"), spark.createDataFrame(hays, "h int, ht string"), "n", "h", "nt", "ht").collect()
    want = {(n, h) for n, a in needles for h, b in hays if a is not None and b is not None and a.lower() in b.lower()}
    assert {(r["n"], r["h"]) for r in got} == want and len(got) == len(want) > 100


def test_zones_take_what_is_allowed_or_named(spark):
    zones = spark.createDataFrame([(1, "Wind", None), (2, "solar", ["g3", "gone"]), (3, "Battery", []), (4, None, None)], "zone int, technology string, allowed array<string>")
    units = spark.createDataFrame([("g1", "offshore WIND", None), ("wind_2", "gas", "x"), ("g3", "coal", "y")], "key string, fuel string, technology string")
    got = containment.match_zones(zones, units.withColumnRenamed("technology", "tech"), "zone", "technology", "allowed", "key", ["fuel", "tech"])
    assert {tuple(r) for r in got.collect()} == {(1, "g1"), (1, "wind_2"), (2, "g3")}
    stores = spark.createDataFrame([("b1",), ("b2",)], "key string")
    assert {tuple(r) for r in containment.match_storage(zones, stores, "zone", "technology", "key").collect()} == {(3, "b1"), (3, "b2")}
    buses = spark.createDataFrame([("x", 7, 40.0, 0.0), ("y", 8, 41.0, 0.0)], "bus string, node int, lat double, lon double")
    placed = spark.createDataFrame([(1, 40.9, 0.0), (2, 40.1, 0.1)], "zone int, lat double, lon double")
    tied = containment.expand_zones(placed, buses, "zone", "bus", "node", "lat", "lon", 100.0, 5.0)
    lines = {r["from_bus"]: r for r in tied["lines"].collect()}
    assert lines["zone_1_bus"]["to_bus"] == "y" and lines["zone_2_bus"]["to_bus"] == "x"
    assert all(r["cost"] == pytest.approx(100 * r["km"] + 10) for r in lines.values())
    assert {tuple(r) for r in tied["nodes"].collect()} == {("zone_1", 8), ("zone_2", 7)}


def plain_split(vertices, lines, buses, tol):
    out = []
    for l, kv in lines:
        at = [(a, o) for k, _, a, o in sorted(vertices) if k == l]
        m = 111320 * math.cos(math.radians(sum(p[0] for p in at) / len(at)))
        xy = [(o * m, a * 110540) for a, o in at]
        total, cuts = sum(math.dist(p, q) for p, q in pairwise(xy)), set()
        for _, a, o, bkv in buses:
            if kv > 0 and bkv > 0 and abs(bkv - kv) > 0.1 * kv:
                continue
            best, s0, (x, y) = None, 0.0, (o * m, a * 110540)
            for p, q in pairwise(xy):
                d = math.dist(p, q)
                t = max(0, min(1, ((x - p[0]) * (q[0] - p[0]) + (y - p[1]) * (q[1] - p[1])) / d**2))
                c = (math.hypot(x - p[0] - t * (q[0] - p[0]), y - p[1] - t * (q[1] - p[1])), s0 + t * d)
                best, s0 = c if best is None else min(best, c), s0 + d
            if best and best[0] <= tol and tol < best[1] < total - tol:
                cuts.add(round(best[1], 2))
        ends = [0.0, *sorted(cuts), total]
        out += [(l, k, *p) for k, p in enumerate([p for p in pairwise(ends) if p[1] - p[0] >= 1] or [(0.0, total)])]
    return sorted(out)


@pytest.mark.parametrize("size", [0.05, 1.0])
def test_lines_are_cut_where_buses_touch_them(spark, size):
    rng = random.Random(4)
    vertices, lines = [], []
    for l in range(40):
        a, o = (70.0 if l % 2 else 40.0) + rng.random(), rng.random()
        lines.append((l, rng.choice([110.0, 220.0, 0.0])))
        for s in range(rng.choice([1, 2, 3, 5])):
            vertices.append((l, s, a, o))
            a, o = a + rng.uniform(-0.3, 0.3), o + rng.uniform(-0.5, 0.5)
    vertices += [(99, 0, 40.0, 0.0), (99, 1, 40.0, 1.0)]  # along a parallel
    lines.append((99, 0.0))
    buses = [(b, rng.choice([40.0, 70.0]) + rng.uniform(-0.3, 1.3), rng.uniform(-0.5, 1.5), rng.choice([110.0, 115.0, 220.0, 0.0])) for b in range(300)] + [(300, 0.0, 0.0, 0.0)]
    frames = [spark.createDataFrame(x, s) for x, s in ((vertices, "l int, s int, lat double, lon double"), (lines, "l int, kv double"), (buses, "b int, lat double, lon double, kv double"))]
    got = sorted(tuple(r) for r in geometry.split_lines(*frames, "l", "s", "b", "lat", "lon", "kv", 2000.0, size).collect())
    want = plain_split(vertices, lines, buses, 2000.0)
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) > 45
    np.testing.assert_allclose([g[2:] for g in got], [w[2:] for w in want], atol=0.011)


def test_hulls_of_parts_are_hulls_of_wholes(spark):
    rng = random.Random(2)
    points = [(k, rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(4) for _ in range([1, 2, 3, 500][k])] + [(3, 0.0, 0.0)] * 5 + [(4, float(i), 2.0 * i) for i in range(9)] + [(4, None, 1.0)]
    df = spark.createDataFrame(points, "k int, x double, y double").repartition(5)
    got = {r["k"]: r for r in geometry.hulls(df, ["k"], "x", "y", 8).select("*", geometry.area(F.col("corners")).alias("area"), geometry.buffered_area(F.col("corners"), 1.0).alias("wide")).collect()}
    for k in range(5):
        whole = geometry._hull(np.array([p[1:] for p in points if p[0] == k and p[1] is not None]))
        assert {(c["x"], c["y"]) for c in got[k]["corners"]} == set(map(tuple, whole.tolist()))
    assert got[0]["wide"] == pytest.approx(math.pi) and got[4]["area"] == pytest.approx(0)
    assert got[4]["wide"] == pytest.approx(math.pi + 2 * math.hypot(8, 16))


def test_cells_fill_the_domain_and_hold_what_is_nearest(spark):
    rng = random.Random(3)
    sites = [(i, rng.uniform(0, 10), rng.uniform(0, 8)) for i in range(120)] + [(900, 1.0, 3.0), (901, 1.0, 3.0), (902, None, 1.0)] + [(1000 + i, 9 + rng.random() / 50, 7 + rng.random() / 50) for i in range(30)]
    got = geometry.voronoi_cells(spark.createDataFrame(sites, "s int, x double, y double"), "s", "x", "y", [(0, 8), (12, 8), (10, 0), (0, 0)], 0.6)
    cells = {r["site"]: [(c["x"], c["y"]) for c in r["corners"]] for r in got.collect()}
    assert len(cells) == 151 and 901 not in cells
    around = lambda c: zip(c, c[1:] + c[:1], strict=True)
    assert sum((a[0] * b[1] - b[0] * a[1]) / 2 for c in cells.values() for a, b in around(c)) == pytest.approx(88.0)
    for _ in range(400):
        x, y = rng.uniform(0, 10), rng.uniform(0, 8)
        near = min((s for s in sites if s[1] is not None), key=lambda s: (math.dist(s[1:], (x, y)), s[0]))[0]
        assert all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-9 for a, b in around(cells[near]))
    assert geometry.voronoi_cells(spark.createDataFrame(sites[:1], "s int, x double, y double"), "s", "x", "y", [(0, 0), (1, 0), (1, 1), (0, 1)], 0.1).first()["corners"] is not None


def test_normal_distribution(spark):
    zs = [-40.0, -12.0, -8.0, -7.2, -3.0, -1.0, 0.0, 0.5, 2.0, 6.0, 7.1, 9.0, 40.0]
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", risk.normal_cdf_exact(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["z"] / math.sqrt(2)), rel=1e-7, abs=1e-15)
    ps = [1e-9, 1e-4, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.999]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", risk.normal_quantile(F.col("p")).alias("z")).collect():
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-9)


def test_joint_hazards(spark):
    rows = [("a", 0.1), ("a", 0.2), ("b", 0.01), ("b", 0.01), ("b", 0.5), ("c", 0.0), ("c", 1.0), ("d", 0.3), ("e", None), ("f", 0.0)]
    df = spark.createDataFrame(rows, "k string, p double")
    got = {r["k"]: r["combined"] for r in risk.combine_gaussian(df, ["k"], "p").collect()}
    m = np.linspace(-10, 10, 4001)
    weight = np.exp(-m * m / 2) / math.sqrt(2 * math.pi) * (m[1] - m[0])
    cdf = np.vectorize(NormalDist().cdf)
    want = lambda ps: 1 - float(np.prod([cdf((math.sqrt(0.3) * m - NormalDist().inv_cdf(p)) / math.sqrt(0.7)) for p in ps], axis=0) @ weight)
    assert got == pytest.approx({"a": want([0.1, 0.2]), "b": want([0.01, 0.01, 0.5]), "c": 1.0, "d": 0.3, "f": 0.0}, abs=1e-9)
    # Published: two normal scores above their medians with correlation rho have the probability 1/4 + asin(rho) / (2 pi).
    halves = spark.createDataFrame([("x", 0.5), ("x", 0.5)], "k string, p double")
    assert risk.combine_gaussian(halves, ["k"], "p", 0.3).first()["combined"] == pytest.approx(1 - 0.25 - math.asin(0.3) / (2 * math.pi), abs=1e-8)
    # Independent hazards as a limit.
    assert risk.combine_gaussian(df.where("k = 'b'"), ["k"], "p", 0.0).first()["combined"] == pytest.approx(1 - 0.99 * 0.99 * 0.5, abs=1e-9)


def test_gumbel_by_likelihood(spark):
    rng = random.Random(6)
    rows = [("a", x) for x in [3.0, 5.0, 7.0, 4.0, 9.0, 12.0, 6.0]] + [("b", 1.0), ("b", 2.0), ("c", 4.0), ("c", 4.0), ("c", 4.0)] + [(None, x) for x in [100.0, 103.0, 98.0, 110.0]]
    rows += [("big", 50 - 8 * math.log(-math.log(rng.random()))) for _ in range(3000)] + [("a", None)]
    got = {r["k"]: r for r in risk.gumbel_likelihood(spark.createDataFrame(rows, "k string, x double"), ["k"], "x").collect()}
    assert all(abs(r["gradient"]) < 1e-8 for r in got.values()) and len(got) == 5
    assert (got["b"]["location"], got["b"]["scale"], got["c"]["location"], got["c"]["scale"]) == (2.0, 0.0, 4.0, 0.0)
    assert got["big"]["location"] == pytest.approx(50, abs=1) and got["big"]["scale"] == pytest.approx(8, abs=0.5)

    def score(k, loc, scale):
        z = [(x - loc) / scale for g, x in rows if g == k and x is not None]
        return sum(math.log(scale) + v + math.exp(-v) for v in z)

    for k in ("a", None, "big"):
        r = got[k]
        best = score(k, r["location"], r["scale"])
        assert all(score(k, r["location"] + da, r["scale"] + db) >= best for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))


def test_adoption_does_not_depend_on_partitions(spark):
    homes = spark.createDataFrame([(i, 0.03 + i % 10 * 0.02, 40 + (i * 37 % 1000) / 5000, -4 + (i * 91 % 1000) / 5000) for i in range(300)], "a long, r double, lat double, lon double")
    rounds = lambda df: sorted((r["run"], r["agent"], r["year"] or 0) for r in adoption.adoption_rounds(df, "a", "r", "lat", "lon", list(range(2025, 2029)), 2, 500.0, 0.35, 1.0).collect())
    one = rounds(homes.repartition(1))
    assert one == rounds(homes.repartition(8))
    assert 50 < sum(1 for r in one if r[2]) < 600


def test_elbow_finds_planted_groups(spark):
    rng = random.Random(1)
    centres = [(0, 0), (100, 0), (0, 100), (100, 100), (50, 180)]
    points = [(i, x + rng.gauss(0, 3), y + rng.gauss(0, 3)) for i, (x, y) in enumerate(centres * 40)]
    df = spark.createDataFrame([*points, (999, None, 1.0)], "i int, x double, y double")
    curve = demand.inertias(df, "i", ["x", "y"], 2, 9, rounds=2)
    assert demand.elbow(curve) == 5 and all(b <= a for (_, a), (_, b) in pairwise(curve))
    assert demand.elbow(demand.inertias(df.limit(0), "i", ["x", "y"], 2, 9)) is None
