"""Series for training."""

import datetime as dt
import math

from pyspark.sql import functions as F

from wattspan.operators import estimation as es


def test_full_year_and_hours(spark):
    rows = [("a", dt.datetime(2024, 2, 28, 23, 10), 1.0), ("a", dt.datetime(2024, 2, 28, 23, 50), 3.0), ("a", dt.datetime(2024, 2, 29, 0, 0), 9.0), ("a", dt.datetime(2024, 3, 1, 0, 5), 5.0)]
    h = es.hourly_left(spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double"), ["k"], "ts", "v").withColumnRenamed("hour_ts", "ts")
    y = es.full_year(h, ["k"], "ts", "v", 2024)
    assert y.count() == 8760
    got = {r["hour"]: r["v"] for r in y.where("v is not null").collect()}
    assert got == {59 * 24 - 1: 2.0, 59 * 24: 5.0}


def test_holidays_and_folds(spark):
    days = spark.createDataFrame([("x", dt.date(2024, 12, d)) for d in (1, 20, 25, 27)], "k string, day date")
    hol = spark.createDataFrame([("x", dt.date(2024, 12, 25))], "k string, h date")
    got = {r["day"].day: (r["is_holiday"], r["days_to"], r["days_from"]) for r in es.holidays(days, hol, "k", "day", "h").collect()}
    assert got == {1: (False, 7, 7), 20: (False, 5, 7), 25: (True, 0, 0), 27: (False, 7, 2)}
    f = es.leave_one_out(spark.createDataFrame([(c,) for c in "abcdeabc"], "g string"), "g", 3)
    assert f.count() == 3 and f.select("g").distinct().count() == 3
    assert es.real_only(spark.createDataFrame([("PLEXOS v1",), ("grid",), (None,)], "s string"), "s").count() == 2


def test_cascade_and_elasticity(spark):
    annual = spark.createDataFrame([(1, 100.0)], "node int, mwh double")
    monthly = spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0)], "node int, month int, share double")
    daily = spark.createDataFrame([(1, 1, 1, 1.0), (1, 2, 1, 1.0), (1, 2, 2, 1.0)], "node int, month int, day int, share double")
    got = {(r["month"], r["day"]): r["mwh"] for r in es.cascade(annual, monthly, daily, "mwh").collect()}
    assert got == {(1, 1): 25, (2, 1): 37.5, (2, 2): 37.5}
    e = es.gdp_elasticity(spark.createDataFrame([("x", float(g**0.5), float(g)) for g in (1, 2, 4, 9)], "k string, d double, g double"), ["k"], "d", "g").first()
    assert math.isclose(e["elasticity"], 0.5)


def test_training_rows(spark):
    t0 = dt.datetime(2024, 1, 1)
    w = spark.createDataFrame([("z", t0 + dt.timedelta(hours=h), float(h // 24)) for h in range(72)], "k string, ts timestamp_ntz, c double")
    load = w.select("k", "ts", F.lit(2.0).alias("mw"))
    x = es.training_rows(load, w, ["k"], "ts", "mw", "c").where("day = date'2024-01-03'").first()
    assert (x["t_day"], x["t_lag1"], x["t_7"], x["relative"]) == (2.0, 1.0, 1.0, 1.0)
