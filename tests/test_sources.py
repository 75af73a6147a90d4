"""Readers, writers, the facade and streams."""

import pandas as pd
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from wattspan.plans.engine import Engine, Plugin
from wattspan.plans.query_spec import QuerySpec, run
from wattspan.sources import config, lp_text, tabular
from wattspan.sources.results import ResultStore
from wattspan.streaming import incremental as inc


def test_matrix(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,2\n3,4\n5,x\n")
    rows = {(r["hour"], r["node"]): r["value"] for r in tabular.read_matrix(spark, str(tmp_path / "m.csv")).collect()}
    assert rows == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4, (2, 0): 5, (2, 1): None}
    ts = tabular.with_timestamps(tabular.read_matrix(spark, str(tmp_path / "m.csv")), "hour", "31/12/2024 23:00", 2025)
    assert sorted(str(r["ts"]) for r in ts.where("node = 0").collect()) == ["2025-01-01 00:00:00", "2025-01-01 01:00:00"]
    with pytest.raises(ValueError):
        tabular.read_matrix(spark, "x.xlsx")


def test_tiling_and_availability(spark):
    df = spark.range(48).select(F.col("id").alias("hour"), F.lit(1.0).alias("v"))
    assert tabular.tile_years(df, "hour", 48, 2, hours_a_year=48).count() == 96 and tabular.tile_years(df, "hour", 48, 1, hours_a_year=24).count() == 24
    grid = spark.createDataFrame([(h, n) for h in range(2) for n in range(3)], "hour int, node int")
    assert {r["a"] for r in tabular.availability(None, grid, "hour", "node", "a", 0).collect()} == {1.0}
    p = spark.createDataFrame([(0, 0, 0.3), (0, 1, 1.7), (1, 0, -1.0)], "hour int, node int, a double")
    got = {(r["hour"], r["node"]): (r["a"], r["from_file"]) for r in tabular.availability(p, grid, "hour", "node", "a", 2).collect()}
    assert got == {(0, 0): (0.3, True), (0, 1): (1, True), (0, 2): (1, True), (1, 0): (0, True), (1, 1): (1, False), (1, 2): (1, False)}


def test_partitions_prune(spark, tmp_path):
    df = spark.createDataFrame([(y, i) for y in (2020, 2021) for i in range(3)], "year int, v int")
    tabular.write_by(df, str(tmp_path / "p"), "year")
    x = tabular.read_year(spark, str(tmp_path / "p"), 2021)
    assert x.count() == 3 and "PartitionFilters: [isnotnull(year" in x._jdf.queryExecution().toString()


def test_results_are_idempotent(spark, tmp_path):
    s = ResultStore(spark, str(tmp_path / "r"), "run1")
    s.begin(solver="x")
    for _ in range(2):
        s.append("fact_gen", spark.createDataFrame([("u", 1.0)], "unit string, mw double"), 2030)
    s.append("fact_gen", spark.createDataFrame([("u", 2.0)], "unit string, mw double"), 2031)
    assert not s.complete()
    s.finish()
    assert s.complete() and s.read("fact_gen").count() == 2 and s.read("fact_gen", 2031).first()["mw"] == 2


def test_config(spark, tmp_path):
    u = config.unit_rows(spark, [{"name": "Diesel", "rated_power": [50, 60], "fuel_cost": 40}])
    assert [(r["node"], r["rated_power"], r["fuel_cost"], r["ramp_up"]) for r in u.orderBy("node").collect()] == [(0, 50, 40, None), (1, 60, 40, None)]
    with pytest.raises(ValueError):
        config.unit_rows(spark, [{"name": "x", "rated_power": [1, 2], "fuel_cost": [1]}])
    with pytest.raises(ValueError):
        config.resolve_under(str(tmp_path), "../x")
    assert config.resolve_under(str(tmp_path), "a/b").name == "b"


def test_lp_text(spark):
    p = lp_text.parse("\\ a comment\nMinimize\n obj: 2 x + 3 y\nSubject To\n c1: x + y >= 10\n c2: x - 2 y\n <= 4\nBounds\n 0 <= x <= 8\n y free\nGeneral\n x\nEnd\n")
    assert p.objective == {"x": 2, "y": 3} and p.rows == [("c1", ">=", 10), ("c2", "<=", 4)]
    assert p.bounds["x"] == (0, 8) and p.bounds["y"][0] == float("-inf") and p.integers == {"x"}
    coef, rows, cols = lp_text.frames(spark, p)
    assert coef.count() == 4 and rows.count() == 2 and cols.where("integer").count() == 1


def test_hooks_and_constraints(spark):
    seen = []

    class Half(Plugin):
        def pre_year(self, engine, year):
            seen.append(year)

        def post_demand_loaded(self, engine, demand):
            return demand.withColumn("mw", F.col("mw") / 2)

    e = Engine(spark)
    e.use(Half())
    e.fire("pre_year", 2030)
    e.load_demand(spark.createDataFrame([(1, 10.0)], "node int, mw double"))
    assert seen == [2030] and e.sql("select mw from demand").first()["mw"] == 5
    with pytest.raises(ValueError):
        e.fire("nothing")
    e.constrain("limit", {("p", "gas"): 1.0}, "<=", 5.0)
    cols = spark.createDataFrame([("p", "gas", 3)], "variable string, element string, col int")
    coef, rows = e.constraint_rows(cols)
    assert coef.first()["col"] == 3 and rows.first()["rhs"] == 5
    e.constrain("bad", {("p", "coal"): 1.0}, "<=", 5.0)
    with pytest.raises(ValueError, match="coal"):
        e.constraint_rows(cols)
    e.metric("n", lambda x: x.tables["demand"].groupBy().count())
    assert e.measure("n").first()[0] == 1


def test_query_spec(spark):
    f = spark.createDataFrame([("a", 2030, i, float(i)) for i in range(48)] + [("b", 2030, 0, 1.0)], "variable string, year int, t int, value double")
    daily = {r["bucket"]: r["value"] for r in run(f, QuerySpec(["a"], "daily", "max")).collect()}
    assert daily == {0: 23, 1: 47}
    assert run(f, QuerySpec(["a"], "yearly", "sum", years=(2030,))).first()["value"] == sum(range(48))
    n = [r["value"] for r in run(f, QuerySpec(["a"], "raw", "sum", "normalised")).orderBy("bucket").collect()]
    assert n[0] == 0 and n[-1] == 1
    with pytest.raises(ValueError):
        run(f, QuerySpec(["a"], transform="?"))


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    events = pd.read_parquet(DATA / "events.parquet").sort_values("ts")
    half = len(events) // 2
    events.iloc[:half].to_parquet(src / "a.parquet", coerce_timestamps="us")
    events.iloc[half:].to_parquet(src / "b.parquet", coerce_timestamps="us")
    like = spark.read.parquet(str(src))
    s = inc.read_stream(spark, str(src), like, "ts")
    q = inc.tumbling(s, "ts", ["event_type"], "value", "1 day", "1 hour").writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("tumbling").agg(F.sum("n"), F.round(F.sum("total"), 2)).first()
    assert tuple(got) == (len(events), round(events["value"].sum(), 2))
    q = inc.append_results(s.select("user_id", "event_type", "value"), str(tmp_path / "out"), str(tmp_path / "cp"), ["event_type"])
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == len(events) and out.select("batch").distinct().count() == 2


def test_storage_state(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    pd.DataFrame({"u": ["a", "a"], "t": [0, 1], "c": [10.0, 0.0], "x": [0.0, 4.5]}).to_parquet(src / "0.parquet")
    pd.DataFrame({"u": ["a", "b"], "t": [2, 2], "c": [1000.0, 1.0], "x": [0.0, 0.0]}).to_parquet(src / "1.parquet")
    s = inc.read_stream(spark, str(src), spark.read.parquet(str(src)))
    q = inc.storage_state(s, "u", "t", "c", "x", 0.0, 100.0, 0.9, 0.9).writeStream.format("memory").queryName("soc").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["u"], r["t"]): r["soc"] for r in spark.table("soc").collect()} == {("a", 0): 9.0, ("a", 1): 4.0, ("a", 2): 100.0, ("b", 2): 0.9}
