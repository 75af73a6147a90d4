"""Tables with many rows at one place, of one text or in one fleet: results against plain ones, and work that does not grow with pairs."""

import contextlib
import math
import threading

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from wattspan import catalog
from wattspan.operators import adoption, containment, demand, dispatch, geometry, places, profiles, risk
from wattspan.operators import features as ft
from wattspan.operators import joins as jn


@contextlib.contextmanager
def limited(spark, seconds):
    """Jobs that take longer are cancelled, and fail the test."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def crowd(spark, n, key="k"):
    """``n`` rows at two places 500 km apart."""
    return spark.range(n).select(F.col("id").alias(key), F.when(F.col("id") % 2 == 0, 40.0).otherwise(44.5).alias("lat"), F.lit(1.0).alias("lon"))


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(h, 1.0)))


def few_places(n, seed):
    rng = np.random.default_rng(seed)
    spots = [(40 + float(a), float(b)) for a, b in rng.uniform(0, 1, (6, 2))]
    return [(i, *spots[int(rng.integers(6))]) for i in range(n)]


def test_clusters_do_not_pair_rows_of_a_place(spark):
    with limited(spark, 60):
        c = demand.density_clusters(crowd(spark, 100_000), "k", "lat", "lon", 5.0).groupBy("component").count().collect()
    assert sorted(tuple(x) for x in c) == [(0, 50_000), (1, 50_000)]


def test_an_id_at_two_places_links_them_and_rows_without_a_place_stay(spark):
    rows = [(1, 0.0, 0.0), (2, 9.0, 0.0), (3, 9.0, 0.0), (1, 9.0, 0.0), (4, None, 0.0), (5, None, 0.0), (6, float("nan"), 0.0), (7, float("nan"), 0.0)]
    c = demand.density_clusters(spark.createDataFrame(rows, "k int, lat double, lon double"), "k", "lat", "lon", 5.0)
    assert {x["node"]: x["component"] for x in c.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}


def test_ends_are_counted_before_they_meet(spark):
    lines = spark.range(2_000_000).select((F.col("id") % 2).alias("a"), F.lit(1).cast("long").alias("b"))
    with limited(spark, 60):
        got = {(x["lo"], x["hi"]): x["pairs"] for x in jn.same_ends_count(lines, lines, "a", "b").collect()}
    assert got == {(0, 1): 10**12, (1, 1): 10**12}
    few = spark.createDataFrame([(1, 2), (2, 1), (None, 1), (1, 1)], "a long, b long")
    assert {(x["lo"], x["hi"]): x["pairs"] for x in jn.same_ends_count(few, few, "a", "b").collect()} == {(1, 2): 4, (1, 1): 1}


def test_pairs_of_copies(spark):
    left, right = few_places(60, 1), [(i + 100, x, y) for i, x, y in few_places(300, 1)]
    schema = "k int, lat double, lon double"
    l, r = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).withColumnRenamed("k", "m")
    got = {(x["k"], x["m"]): x["km"] for x in jn.within(l, r, "k", "m", "lat", "lon", 40.0, digits=3).collect()}
    want = {(a[0], b[0]): km(a, b) for a in left for b in right if km(a, b) <= 40.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 6e-4 for k in want)
    close = sorted((x["a"], x["b"]) for x in ft.close_pairs(r, "m", "lat", "lon", 40.0, digits=3).collect())
    assert close == sorted((a[0], b[0]) for a in right for b in right if a[0] < b[0] and km(a, b) <= 40.0)
    taken = {b[0] for b in right if any(km(a, b) <= 20.0 for a in left[:3])}
    assert {x["m"] for x in jn.gap_fill(l.where("k < 3").withColumnRenamed("k", "m"), r, "m", "lat", "lon", 20.0).collect()} == {b[0] for b in right} - taken


def test_priority_and_gaps_do_not_pair_rows(spark):
    with limited(spark, 60):
        kept = ft.keep_by_priority(crowd(spark, 100_000), "k", "lat", "lon", 5.0, -(F.col("k") % 10)).collect()
        left = jn.gap_fill(crowd(spark, 100_000).where("k % 2 = 0"), crowd(spark, 100_000), "k", "lat", "lon", 5.0).count()
    assert sorted(x["k"] for x in kept) == [8, 9] and left == 50_000


def test_households_of_a_place_are_counted(spark):
    people = crowd(spark, 40_000, "agent").withColumn("rate", F.lit(0.05))
    with limited(spark, 100):
        got = adoption.adoption_rounds(people, "agent", "rate", "lat", "lon", [2020, 2021], 2, 1000.0, 0.2, 5.0).count()
    assert got == 80_000


def test_names_are_matched_once_and_then_expanded(spark):
    zones = spark.range(600).select(F.col("id").alias("z"), F.when(F.col("id") % 2 == 0, "Wind").otherwise("sol").alias("t"))
    parts = spark.range(900).select(F.col("id").alias("p"), F.when(F.col("id") % 3 == 0, "wind solar").when(F.col("id") % 3 == 1, "WINDY").otherwise("coal").alias("x"))
    got = containment.contained(zones, parts.unionByName(parts), "z", "p", "t", "x")
    assert got.count() == got.distinct().count() == 300 * 600 + 300 * 300
    mixed = spark.createDataFrame([(1, "wind", None), (1, "x", ["a"])], "z int, t string, allowed array<string>")
    keys = spark.createDataFrame([("a", "windmill"), ("b", "coal")], "key string, f string")
    assert [tuple(x) for x in containment.match_zones(mixed, keys, "z", "t", "allowed", "key", ["f"]).collect()] == [(1, "a")]


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_what_is_shuffled_grows_as_the_members_not_as_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(places, "CELLS", 16, raising=False)
    written = []
    for n in (6_000, 24_000):
        left = spark.range(n).select(F.lit(1).alias("x"), F.col("id").alias("a"))
        right = spark.range(n).select(F.lit(1).alias("y"), F.col("id").alias("b"))
        start = shuffled(spark)
        got = places.expanded(spark.createDataFrame([(1, 1)], "x int, y int"), left, ["x"], "a", right, ["y"], "b")
        assert got.count() == n * n
        written.append(shuffled(spark) - start)
    assert written[1] < 6 * written[0]


def test_blocks_and_slices_of_members_meet_once(spark, monkeypatch):
    monkeypatch.setattr(places, "CELLS", 2, raising=False)
    member = lambda n, c, k: spark.range(n).select((F.col("id") % 2).alias(c), F.col("id").alias(k))
    pairs = spark.createDataFrame([(0, 0, "p"), (0, 1, "q"), (1, 1, "r"), (1, 5, "s"), (7, 1, "t")], "x int, y int, km string")
    got = places.expanded(pairs, member(1_400, "x", "a"), ["x"], "a", member(2_000, "y", "b"), ["y"], "b")
    assert got.groupBy("km").agg(F.count("*"), F.countDistinct("a", "b")).orderBy("km").collect() == [("p", 700_000, 700_000), ("q", 700_000, 700_000), ("r", 700_000, 700_000)]
    none = places.expanded(pairs.where("x > 9"), member(4, "x", "a"), ["x"], "a", member(4, "y", "b"), ["y"], "b")
    assert none.columns == ["km", "a", "b"] and none.count() == 0


def test_balances_are_rounded_as_their_loads(spark):
    folder = DATA.parent / "sf0.01"
    if not folder.exists():
        pytest.skip("needs sf0.01")
    duckdb = pytest.importorskip("duckdb")
    sql = catalog.ORACLE_SQL["ac_power_flow"].replace("FROM supplier", f"FROM '{folder}/supplier.parquet'")
    want = {(u, k): p for u, k, p, _ in duckdb.connect().sql(sql).fetchall()}
    got = {(x["unit"], x["bus"]): x["p"] for x in catalog.QUERIES["ac_power_flow"](spark, str(folder)).collect()}
    assert got == want


def test_rows_that_become_many_are_dealt(spark):
    units = spark.range(2000).coalesce(1).select(F.col("id").alias("unit"), F.lit(1.0).alias("v"), F.lit(0.5).alias("m"), F.lit(0.4).alias("im"))
    hours = profiles.thermal_profile(units, "unit", F.lit(5), 1.0, 0.8, 10)
    assert hours.rdd.getNumPartitions() == 4 and hours.count() == 20_000
    loss = risk.sampled_annual_loss(units.where("unit < 3"), ["unit"], "v", "m", "im", 0.4, 200)
    assert loss.count() == 3


@pytest.mark.parametrize("by_unit", [False, True])
def test_a_fleet_is_dispatched_without_a_shuffle_of_its_steps(spark, by_unit):
    units = spark.createDataFrame([(n, u, float(3 + u % 4), float(u % 3)) for n in (1, 2) for u in range(9)], "node int, unit int, cap double, cost double")
    loads = spark.createDataFrame([(n, d, float(d * n)) for n in (1, 2) for d in range(30)], "node int, day int, load double")
    got = dispatch.fleet_merit_order(units, loads, ["node"], "day", "unit", "cap", "cost", "load", by_unit)
    want = dispatch.merit_order(units.join(loads.drop("load"), "node"), loads, ["node", "day"], "unit", "cap", "cost", "load")
    rows = lambda df: sorted(tuple(x) for x in df.select("node", "day", "unit", "load", "dispatch").collect())
    assert rows(got) == rows(want)
    grouped = got.groupBy("node", "unit" if by_unit else "day").agg(F.sum("dispatch"))
    above = grouped._jdf.queryExecution().executedPlan().toString().split("BroadcastHashJoin")[0]
    assert "Exchange" not in above


def test_buses_of_a_place_cut_a_line_once_and_blocks_of_vertices_meet(spark):
    n = geometry.VERTICES * 2 + 5
    v = spark.range(n).select(F.lit(1).alias("l"), F.col("id").alias("s"), F.lit(0.0).alias("lat"), (F.col("id") / 1000.0).alias("lon"))
    lines = spark.createDataFrame([(1, 0.0), (2, 0.0)], "l int, kv double")
    buses = spark.range(3000).select(F.col("id").alias("b"), F.lit(0.0001).alias("lat"), F.lit(1.5).alias("lon"), F.lit(110.0).alias("kv"))
    got = [tuple(x) for x in geometry.split_lines(v, lines, buses, "l", "s", "b", "lat", "lon", "kv", 200.0).orderBy("line", "piece").collect()]
    cut, end = 1.5 * geometry.LON_M, (n - 1) / 1000 * geometry.LON_M
    assert [(a, b) for a, b, *_ in got] == [(1, 0), (1, 1), (2, 0)]
    assert [x for _, _, *m in got for x in m] == pytest.approx([0, cut, cut, end, 0, 0], abs=0.02)
