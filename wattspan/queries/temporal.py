"""Blocks, windows, curves, lags and factors over the hourly series and daily facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattspan import bindings as b
from wattspan.operators import temporal as t
from wattspan.plans.query_spec import QuerySpec
from wattspan.plans.query_spec import run as run_spec
from wattspan.queries import DEMAND, GEN, GT, SERIES, query, r

HOURLY = f"{SERIES}, h AS (SELECT category, hour, sum(value) AS v FROM series GROUP BY category, hour)"
DAILY = f"{DEMAND}, dly AS (SELECT node, day, sum(mw) AS v FROM demand GROUP BY node, day)"


def hourly(spark, d):
    return b.series(spark, d).groupBy("category", "hour").agg(F.sum("value").alias("v"))


def daily(spark, d):
    return b.demand(spark, d).groupBy("node", "day").agg(F.sum("mw").alias("v"))


@query(f"WITH {SERIES} SELECT CAST(floor(hour / 6) AS BIGINT) AS block, round(avg(value), 8) AS value FROM series GROUP BY 1 HAVING count(DISTINCT hour) = 6")
def block_mean_6h(spark, d):
    return t.block_aggregate(b.series(spark, d), [], "hour", "value", 6, "mean").withColumn("value", r("value", 8))


@query(f"WITH {HOURLY} SELECT category, CAST(floor(hour / 730) AS BIGINT) AS block, round(sum(v), 2) AS value FROM h GROUP BY 1, 2")
def block_sum_month730(spark, d):
    return t.block_aggregate(hourly(spark, d), ["category"], "hour", "v", 730, "sum", complete_only=False).withColumn("value", r("value", 2))


@query(f"WITH {HOURLY} SELECT category, CAST(floor(hour / 24) AS BIGINT) AS block, round(max(v), 4) AS value FROM h GROUP BY 1, 2")
def block_max_daily(spark, d):
    return t.block_aggregate(hourly(spark, d), ["category"], "hour", "v", 24, "max", complete_only=False).withColumn("value", r("value"))


@query(f"WITH {SERIES} SELECT CAST(month(ts) AS INTEGER) AS month, CAST(hour(ts) AS INTEGER) AS hour, round(avg(value), 4) AS mean FROM series GROUP BY 1, 2")
def month_hour_mean(spark, d):
    return b.series(spark, d).groupBy(F.month("ts").alias("month"), F.hour("ts").alias("hour")).agg(r(F.avg("value")).alias("mean"))


#: The horizon is as long as the series; windows of a week overlap by a day.
WINDOWS = f"{HOURLY}, hz AS (SELECT max(hour) + 1 AS z FROM h), w AS (SELECT w, w * 144 AS s, least(w * 144 + 168, z) AS e, z, n FROM (SELECT z, greatest(1, CAST(ceil((z - 24) / 144.0) AS BIGINT)) AS n, unnest(range(0, greatest(1, CAST(ceil((z - 24) / 144.0) AS BIGINT)))) AS w FROM hz))"


def horizon(h) -> int:
    """Hours of the series: one number."""
    return (h.agg(F.max("hour")).first()[0] or 0) + 1


@query(f"WITH {WINDOWS}, k AS (SELECT *, CASE WHEN w = n - 1 THEN e ELSE s + 144 END AS keep FROM w) SELECT CAST(w AS INTEGER) AS \"window\", s AS start, e AS \"end\", keep AS keep_end, round((keep - s) * 1.0 / (e - s), 6) AS kept_fraction FROM k")
def rolling_windows(spark, d):
    return t.rolling_windows(spark, horizon(hourly(spark, d)), 168, 24).select("window", "start", "end", "keep_end", r("kept_fraction", 6).alias("kept_fraction"))


@query(f"WITH {WINDOWS} SELECT category, CAST(w AS INTEGER) AS \"window\", round(sum(v), 2) AS total, count(*) AS n FROM h JOIN w ON hour >= s AND hour < e GROUP BY 1, 2")
def window_totals(spark, d):
    h = hourly(spark, d)
    x = t.in_windows(h, "hour", horizon(h), 168, 24)
    return x.groupBy("category", "window").agg(r(F.sum("v"), 2).alias("total"), F.count("*").alias("n"))


@query(f"WITH {HOURLY} SELECT category, round(sum(v), 2) AS total, count(*) AS n FROM h GROUP BY 1")
def stitched_windows(spark, d):
    h = hourly(spark, d)
    hours = horizon(h)
    x = t.stitched(t.in_windows(h, "hour", hours, 168, 24), "hour", "window", hours, 168, 24)
    return x.groupBy("category").agg(r(F.sum("v"), 2).alias("total"), F.count("*").alias("n"))


@query(f"WITH {HOURLY}, x AS (SELECT category, v - lag(v) OVER (PARTITION BY category ORDER BY hour) AS ramp FROM h) SELECT category, round(max(ramp), 4) AS up, round(min(ramp), 4) AS down, round(avg(ramp), 6) AS mean, round(stddev_pop(ramp), 4) AS std FROM x GROUP BY 1")
def ramp_stats(spark, d):
    x = t.ramp(hourly(spark, d), ["category"], ["hour"], "v")
    return x.groupBy("category").agg(r(F.max("ramp")).alias("up"), r(F.min("ramp")).alias("down"), r(F.avg("ramp"), 6).alias("mean"), r(F.stddev_pop("ramp")).alias("std"))


@query(f"WITH {DAILY} " + " UNION ALL ".join(f"SELECT node, CAST({f} AS DOUBLE) AS fraction, round(quantile_cont(v, {1 - f}), 6) AS value FROM dly GROUP BY node" for f in (0.0, 0.25, 0.5, 0.75, 1.0)))
def duration_curve(spark, d):
    return t.duration_curve(daily(spark, d), ["node"], "v", [0.0, 0.25, 0.5, 0.75, 1.0]).withColumn("value", r("value", 6))


@query(f"WITH {GEN}, p AS (SELECT year, day, avg(price) AS price FROM gen GROUP BY year, day), k AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY price DESC, day) AS rank, count(*) OVER (PARTITION BY year) AS n FROM p) SELECT year, day, round(price, 8) AS price, CAST(rank AS INTEGER) AS rank, round(rank * 1.0 / n, 6) AS exceedance FROM k")
def price_duration(spark, d):
    p = b.generation(spark, d).groupBy("year", "day").agg(F.avg("price").alias("price"))
    x = t.ranked_duration(p, ["year"], "price", ["day"])
    return x.select("year", "day", r("price", 8).alias("price"), "rank", r("exceedance", 6).alias("exceedance"))


@query(f"WITH {HOURLY}, m AS (SELECT category, quantile_cont(v, 0.5) AS md FROM h GROUP BY 1) SELECT category, hour, round(coalesce(lag(v, 1) OVER w, md), 4) AS v_lag1, round(coalesce(lag(v, 24) OVER w, md), 4) AS v_lag24, round(coalesce(lag(v, 168) OVER w, md), 4) AS v_lag168 FROM h JOIN m USING (category) WINDOW w AS (PARTITION BY category ORDER BY hour)")
def lag_features(spark, d):
    x = t.lags(hourly(spark, d), ["category"], ["hour"], "v", [1, 24, 168])
    return x.select("category", "hour", *(r(f"v_lag{k}").alias(f"v_lag{k}") for k in (1, 24, 168)))


GAPS = f"{HOURLY}, gp AS (SELECT category, hour, CASE WHEN hour % 10 < 7 THEN v END AS v FROM h)"


@query(f"""WITH {GAPS}, f AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY category ORDER BY hour ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS fw FROM gp)
SELECT category, hour, round(coalesce(fw, first_value(fw IGNORE NULLS) OVER (PARTITION BY category ORDER BY hour ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)), 4) AS filled FROM f""")
def ffill_limit6(spark, d):
    x = hourly(spark, d).withColumn("v", F.when(F.col("hour") % 10 < 7, F.col("v")))
    return t.fill_gaps(x, ["category"], ["hour"], "v", 6).select("category", "hour", r("filled").alias("filled"))


@query(f"WITH {GAPS}, m AS (SELECT category, quantile_cont(v, 0.5) AS md FROM gp GROUP BY 1), a AS (SELECT quantile_cont(v, 0.5) AS md FROM gp) SELECT category, hour, round(coalesce(v, m.md, a.md), 4) AS imputed FROM gp JOIN m USING (category), a")
def impute_median(spark, d):
    x = hourly(spark, d).withColumn("v", F.when(F.col("hour") % 10 < 7, F.col("v")))
    return t.impute_median(x, ["category"], "v", "imputed").select("category", "hour", r("imputed").alias("imputed"))


@query(f"WITH {DAILY} SELECT node, day, round(avg(v) OVER (PARTITION BY node ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS rolling FROM dly")
def rolling_mean_7d(spark, d):
    return t.rolling_mean(daily(spark, d), ["node"], ["day"], "v", 6).select("node", "day", r("rolling", 6).alias("rolling"))


@query(f"WITH {DAILY} SELECT node, day, round(sum(v) OVER (PARTITION BY node ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7, 2) AS rolling FROM dly")
def rolling_centred_padded(spark, d):
    return t.rolling_mean(daily(spark, d), ["node"], ["day"], "v", 3, 3, divide_by=7).select("node", "day", r("rolling", 2).alias("rolling"))


@query(f"WITH {DAILY} SELECT node, day, round(sum(v) OVER (PARTITION BY node ORDER BY day ROWS UNBOUNDED PRECEDING), 2) AS cumulative FROM dly")
def cumulative_sum(spark, d):
    return t.cumulative(daily(spark, d), ["node"], ["day"], "v").select("node", "day", r("cumulative", 2).alias("cumulative"))


@query(f"WITH {DAILY}, x AS (SELECT *, min(v) OVER (PARTITION BY node) AS lo, max(v) OVER (PARTITION BY node) AS hi FROM dly) SELECT node, day, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS normalised FROM x")
def minmax_normalise(spark, d):
    return t.minmax(daily(spark, d), ["node"], "v").select("node", "day", r("normalised", 6).alias("normalised"))


@query(f"WITH {GT}, y AS (SELECT tech, year, sum(mw) AS v FROM gt GROUP BY 1, 2) SELECT tech, year, round(v / lag(v) OVER (PARTITION BY tech ORDER BY year) - 1, 6) AS growth FROM y")
def growth_rate(spark, d):
    y = b.generation_by_tech(spark, d).groupBy("tech", "year").agg(F.sum("mw").alias("v"))
    return t.growth(y, ["tech"], ["year"], "v").select("tech", "year", r("growth", 6).alias("growth"))


@query(f"WITH {GT}, y AS (SELECT tech, CAST(year * 5 - 7980 AS INTEGER) AS year, sum(mw) AS v FROM gt GROUP BY 1, 2), k AS (SELECT *, lead(year) OVER (PARTITION BY tech ORDER BY year) AS y1, lead(v) OVER (PARTITION BY tech ORDER BY year) AS v1 FROM y), e AS (SELECT tech, unnest(range(year, coalesce(y1, year + 1))) AS yy, year, v, y1, v1 FROM k) SELECT tech, CAST(yy AS INTEGER) AS year, round(coalesce(v + (v1 - v) * ((yy - year) * 1.0 / (y1 - year)), v), 2) AS v FROM e")
def interpolate_five_yearly(spark, d):
    y = b.generation_by_tech(spark, d).groupBy("tech", (F.col("year") * 5 - 7980).alias("year")).agg(F.sum("mw").alias("v"))
    return t.interpolate_years(y, ["tech"], "year", "v").select("tech", F.col("year").cast("int").alias("year"), r("v", 2).alias("v"))


@query(f"WITH {SERIES} SELECT category, CAST(month(ts) AS INTEGER) AS month, CAST(hour(ts) AS INTEGER) AS hour, round(least(1.5, greatest(0.5, coalesce(sum(value) / sum(100.0), 1.0))), 6) AS factor FROM series GROUP BY 1, 2, 3")
def month_hour_factors(spark, d):
    x = b.series(spark, d).withColumn("f", F.lit(100.0))
    return t.month_hour_factors(x, ["category"], "ts", "value", "f", 0.5, 1.5).withColumn("factor", r("factor", 6))


@query(f"WITH {SERIES}, f AS (SELECT CAST(hour(ts) AS INTEGER) AS hr, least(1.5, greatest(0.5, sum(value) / sum(100.0))) AS factor FROM series GROUP BY 1) SELECT category, round(sum(100.0 * factor), 2) AS corrected FROM series JOIN f ON hour(ts) = hr GROUP BY 1")
def apply_month_hour_factors(spark, d):
    x = b.series(spark, d).withColumn("f", F.lit(100.0)).drop("hour")
    f = t.month_hour_factors(x, [], "ts", "value", "f", 0.5, 1.5)
    return t.apply_factors(x, f, [], "ts", "f", "corrected").groupBy("category").agg(r(F.sum("corrected"), 2).alias("corrected"))


@query(f"WITH {SERIES}, m AS (SELECT category, date_trunc('hour', ts) AS hour_ts, avg(value) AS value FROM series GROUP BY 1, 2), c AS (SELECT DISTINCT category FROM series), e AS (SELECT date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM series), g AS (SELECT category, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour_ts FROM c, e) SELECT g.category, g.hour_ts, round(value, 4) AS value FROM g LEFT JOIN m USING (category, hour_ts)")
def hourly_grid(spark, d):
    s = b.series(spark, d)
    ends = s.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()  # one row
    first, last = (x.replace(minute=0, second=0, microsecond=0).isoformat(" ") for x in ends)
    return t.hourly_grid(s, ["category"], "ts", "value", first, last).withColumn("value", r("value"))


@query(f"WITH {DAILY}, k AS (SELECT node, day, v AS total, CAST(year(day) AS INTEGER) AS year, CAST(floor((dayofyear(day) - 1) * 4 / 366) AS INTEGER) AS segment FROM dly), x AS (SELECT *, row_number() OVER (PARTITION BY node, year, segment ORDER BY total DESC, day) AS rn FROM k) SELECT node, day, round(total, 2) AS total, segment FROM x WHERE rn = 1")
def representative_days(spark, d):
    return t.representative_days(b.demand(spark, d), ["node", "year"], "day", "mw", 4).select("node", "day", r("total", 2).alias("total"), "segment")


@query(f"WITH {HOURLY} SELECT category, hour, round(100 + sum(0.9 * CASE WHEN hour % 24 < 12 THEN v ELSE 0 END - CASE WHEN hour % 24 >= 12 THEN v ELSE 0 END / 0.9) OVER (PARTITION BY category ORDER BY hour ROWS UNBOUNDED PRECEDING), 4) AS soc FROM h")
def storage_soc(spark, d):
    x = hourly(spark, d).withColumn("c", F.when(F.col("hour") % 24 < 12, F.col("v")).otherwise(0.0)).withColumn("x", F.when(F.col("hour") % 24 >= 12, F.col("v")).otherwise(0.0))
    return t.storage_level(x, ["category"], ["hour"], "c", "x", 100.0, 0.9, 0.9).select("category", "hour", r("soc").alias("soc"))


@query(f"WITH {HOURLY}, x AS (SELECT category, CAST(floor(hour / 24) AS INTEGER) AS day, sum(CASE WHEN hour % 24 >= 12 THEN v ELSE 0 END) AS dis FROM h GROUP BY 1, 2) SELECT category, round(avg(dis / 5000), 6) AS cycles, round(max(dis / 5000), 6) AS most FROM x GROUP BY 1")
def storage_cycles(spark, d):
    x = hourly(spark, d).groupBy("category", F.floor(F.col("hour") / 24).alias("day")).agg(F.sum(F.when(F.col("hour") % 24 >= 12, F.col("v")).otherwise(0.0)).alias("dis"))
    return x.groupBy("category").agg(r(F.avg(F.col("dis") / 5000), 6).alias("cycles"), r(F.max(F.col("dis") / 5000), 6).alias("most"))


@query(f"WITH {SERIES} SELECT category, CAST(floor(hour / 24) AS BIGINT) AS bucket, CAST(2024 AS INTEGER) AS year, round(sum(sum(value)) OVER (PARTITION BY category ORDER BY floor(hour / 24) ROWS UNBOUNDED PRECEDING), 2) AS value FROM series WHERE category IN ('click', 'purchase', 'error') GROUP BY category, floor(hour / 24)")
def custom_query_cumulative(spark, d):
    facts = b.series(spark, d).withColumn("year", F.year("ts"))
    spec = QuerySpec(variables=["click", "purchase", "error"], aggregate="daily", stat="sum", transform="cumulative", years=(2024,))
    return run_spec(facts, spec, variable="category", t="hour").select("category", "bucket", "year", r("value", 2).alias("value"))


@query(f"WITH {HOURLY}, x AS (SELECT category, hour, abs(v - lag(v) OVER (PARTITION BY category ORDER BY hour)) AS c FROM h) SELECT category, round(quantile_cont(c, 0.95), 4) AS p95, round(avg(c), 4) AS mean FROM x GROUP BY 1 HAVING max(c) >= 1e-6")
def ramp_distribution(spark, d):
    x = t.ramp(hourly(spark, d), ["category"], ["hour"], "v").withColumn("c", F.abs("ramp"))
    return x.groupBy("category").agg(r(F.percentile("c", F.lit(0.95))).alias("p95"), r(F.avg("c")).alias("mean"), F.max("c").alias("_m")).where("_m >= 1e-6").drop("_m")


@query(f"WITH {SERIES} SELECT CAST(hour(ts) AS INTEGER) AS hour, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high FROM series GROUP BY 1")
def diurnal_profile(spark, d):
    return b.series(spark, d).groupBy(F.hour("ts").alias("hour")).agg(r(F.avg("value")).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


@query(f"WITH {DAILY}, y AS (SELECT node, CAST(year(day) AS INTEGER) AS year, max(v) AS peak FROM dly GROUP BY 1, 2) SELECT node, year, round(greatest(0, peak - coalesce(max(peak) OVER (PARTITION BY node ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 2) AS increment FROM y")
def incremental_peak(spark, d):
    from wattspan.operators.planning import incremental_peak as inc

    y = daily(spark, d).groupBy("node", F.year("day").alias("year")).agg(F.max("v").alias("peak"))
    return inc(y, ["node"], "year", "peak").select("node", "year", r("increment", 2).alias("increment"))


@query(f"""WITH {SERIES}, g AS (SELECT entity, ts, event, CASE WHEN ts - lag(ts) OVER (PARTITION BY entity ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM series), s AS (SELECT entity, ts, sum(b) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT entity, min(ts) AS start, count(*) AS n FROM s GROUP BY entity, k""")
def sessions_6h(spark, d):
    from wattspan.streaming.incremental import sessions

    s = b.series(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(s, "ts", ["entity"], "6 hours").select("entity", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(f"WITH {HOURLY}, x AS (SELECT category, hour, row_number() OVER (PARTITION BY category ORDER BY v DESC, hour) AS k, v FROM h) SELECT category, hour, round(v, 4) AS v FROM x WHERE k <= 5")
def peak_hours(spark, d):
    w = Window.partitionBy("category").orderBy(F.desc("v"), "hour")
    return hourly(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 5").select("category", "hour", r("v").alias("v"))
