"""Weather, geography, text tags, adoption and yearly profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattspan import bindings as b
from wattspan.functions import scalar as sc
from wattspan.operators import adoption as ad
from wattspan.operators import demand as dem
from wattspan.operators import estimation as est
from wattspan.operators import features as ft
from wattspan.operators import joins as jn
from wattspan.operators import profiles as pr
from wattspan.operators import temporal as t
from wattspan.queries import DEMAND, GEN, SERIES, UNITS, query, r
from wattspan.sources import tabular as tab

CUST = "c AS (SELECT c_custkey AS cust, CAST(40 + (c_custkey * 37 % 1000) / 500.0 AS DOUBLE) AS lat, CAST(-4 + (c_custkey * 91 % 1000) / 500.0 AS DOUBLE) AS lon FROM customer)"
SITE = "s AS (SELECT s_suppkey AS bus, CAST(40 + (s_suppkey * 53 % 100) / 50.0 AS DOUBLE) AS lat, CAST(-4 + (s_suppkey * 29 % 100) / 50.0 AS DOUBLE) AS lon FROM supplier)"


def km_sql(a: str, c: str) -> str:
    return f"2 * 6371 * asin(sqrt(least(1, pow(sin(radians({c}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({c}.lat)) * pow(sin(radians({c}.lon - {a}.lon) / 2), 2))))"


def places(spark, d):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    c = b.table(spark, d, "customer").select(k.alias("cust"), (40 + (k * 37 % 1000) / 500.0).alias("lat"), (-4 + (k * 91 % 1000) / 500.0).alias("lon"))
    return c, b.table(spark, d, "supplier").select(s.alias("bus"), (40 + (s * 53 % 100) / 50.0).alias("lat"), (-4 + (s * 29 % 100) / 50.0).alias("lon"))


@query(f"WITH {CUST}, o AS (SELECT 40.4 AS lat, -3.7 AS lon) SELECT cust, round({km_sql('c', 'o')}, 4) AS km, round(pow(0.25 * 111.32, 2) * cos(radians(c.lat)), 6) AS cell_km2 FROM c, o")
def geo_measures(spark, d):
    c, _ = places(spark, d)
    return c.select("cust", r(sc.haversine_km(F.col("lat"), F.col("lon"), F.lit(40.4), F.lit(-3.7))).alias("km"), r(sc.cell_area_km2(F.col("lat"), 0.25), 6).alias("cell_km2"))


@query(f"""WITH {UNITS}, q AS (SELECT unit, unit % 10 AS x, unit % 7 AS y, 1 + unit % 5 AS w, 1 + unit % 3 AS h FROM units)
SELECT unit, CAST(w * h AS DOUBLE) AS area, x + w / 2.0 AS cx, y + h / 2.0 AS cy, x < 5.25 AND x + w > 5.25 AND y < 3.25 AND y + h > 3.25 AS inside,
 (x < 5.25 AND x + w > 5.25 AND y < 3.25 AND y + h > 3.25) OR (x < 2.5 AND x + w > 2.5 AND y < 1.5 AND y + h > 1.5) OR (x < 9.5 AND x + w > 9.5 AND y < 6.5 AND y + h > 6.5) AS touched FROM q""")
def ring_measures(spark, d):
    u = F.col("unit")
    q = b.units(spark, d).select("unit", (u % 10).cast("double").alias("x"), (u % 7).cast("double").alias("y"), (1 + u % 5).alias("w"), (1 + u % 3).alias("h"))
    xs, ys = F.array("x", F.col("x") + F.col("w"), F.col("x") + F.col("w"), "x"), F.array("y", "y", F.col("y") + F.col("h"), F.col("y") + F.col("h"))
    cx, cy = sc.ring_centroid(xs, ys)
    line = [F.array(*map(F.lit, v)) for v in ((2.5, 5.25, 9.5), (1.5, 3.25, 6.5))]
    return q.select("unit", sc.shoelace(xs, ys).alias("area"), cx.alias("cx"), cy.alias("cy"), sc.point_in_ring(F.lit(5.25), F.lit(3.25), xs, ys).alias("inside"), sc.line_in_ring(*line, xs, ys).alias("touched"))


RINGS = [("north", (-4, -2, -2, -4), (41, 41, 42.5, 42.5)), ("south", (-4, -2.5, -2.5, -4), (39.9, 39.9, 40.5, 40.5))]


@query(f"WITH {CUST} SELECT CASE WHEN lon > -4 AND lon < -2 AND lat > 41 AND lat < 42.5 THEN 'north' WHEN lon > -4 AND lon < -2.5 AND lat > 39.9 AND lat < 40.5 THEN 'south' ELSE 'none' END AS country, count(*) AS n FROM c WHERE lat <> 41 AND lat <> 40.5 AND lon <> -4 AND lon <> -2.5 GROUP BY 1")
def country_mask(spark, d):
    c, _ = places(spark, d)
    inner = c.where("lat <> 41 AND lat <> 40.5 AND lon <> -4 AND lon <> -2.5")  # points on an edge belong to either side
    return inner.groupBy(F.coalesce(sc.first_ring(F.col("lon"), F.col("lat"), RINGS), F.lit("none")).alias("country")).agg(F.count("*").alias("n"))


@query(f"WITH {CUST}, {SITE} SELECT cust, bus, round({km_sql('c', 's')}, 4) AS km FROM c, s WHERE {km_sql('c', 's')} <= 15")
def sites_within(spark, d):
    c, s = places(spark, d)
    return jn.within(c, s, "cust", "bus", "lat", "lon", 15.0, digits=4)


@query(f"WITH {SITE}, u AS (SELECT * FROM s) SELECT s.bus AS a, u.bus AS b, round({km_sql('s', 'u')}, 4) AS km FROM s JOIN u ON s.bus < u.bus WHERE {km_sql('s', 'u')} <= 60")
def close_sites(spark, d):
    _, s = places(spark, d)
    return ft.close_pairs(s, "bus", "lat", "lon", 60.0, digits=4)


@query(f"WITH {SITE}, u AS (SELECT * FROM s) SELECT s.bus FROM s WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.bus <> s.bus AND {km_sql('s', 'u')} <= 60 AND (u.bus % 3 < s.bus % 3 OR (u.bus % 3 = s.bus % 3 AND u.bus < s.bus)))")
def sites_by_priority(spark, d):
    _, s = places(spark, d)
    return ft.keep_by_priority(s, "bus", "lat", "lon", 60.0, F.col("bus") % 3).select("bus")


@query(f"WITH {CUST} SELECT count(*) AS n, round(sum(lat), 4) AS lat FROM c WHERE lat BETWEEN 40.5 AND 41.2 AND lon BETWEEN -3.5 AND -2.9")
def in_bounding_box(spark, d):
    c, _ = places(spark, d)
    return tab.in_box(c, "lat", "lon", 40.5, -3.5, 41.2, -2.9).agg(F.count("*").alias("n"), r(F.sum("lat")).alias("lat"))


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0) THEN 8784 ELSE 8760 END AS hours FROM orders")
def hours_by_year(spark, d):
    return b.demand(spark, d).select("year").distinct().select("year", sc.hours_in_year(F.col("year")).alias("hours"))


@query(f"WITH {SERIES} SELECT event, round(sin(2 * pi() * (hour + 0.5) / 24), 6) AS s, round(cos(2 * pi() * (hour + 0.5) / 24), 6) AS c FROM series")
def cyclical_hours(spark, d):
    s, c = sc.cyclical(F.col("hour") + 0.5, 24.0)
    return b.series(spark, d).select("event", r(s, 6).alias("s"), r(c, 6).alias("c"))


@query(f"""WITH {SERIES}, z AS (SELECT event, value, (ln(value / 100) - ln(0.5)) / 0.4 AS z FROM series), q AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM z),
 e AS (SELECT *, 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x) AS erf FROM q) SELECT event, round(CASE WHEN z >= 0 THEN 0.5 * (1 + erf) ELSE 0.5 * (1 - erf) END, 6) AS p FROM e""")
def fragility_curve(spark, d):
    return b.series(spark, d).select("event", r(sc.fragility(F.col("value") / 100, F.lit(0.5), F.lit(0.4)), 6).alias("p"))


@query(f"""WITH {SERIES}, v AS (SELECT event, value / 10 AS v, value / 10 * pow(1.1 / 1.225, 1.0 / 3) AS dense FROM series)
SELECT event, round(v * pow(8.0, 0.14), 6) AS hub, round(CASE WHEN dense < 3 THEN 0 WHEN dense <= 12 THEN (dense - 3) / 9 WHEN dense <= 25 THEN 1 ELSE 0 END, 6) AS cf, round(ln((1.2 * v + 2) / (v + 1)) / ln(8.0), 6) AS shear,
 round((1 - sqrt(1 - 0.8)) / pow(1 + 0.075 * (100 + event % 400) / 40, 2), 6) AS wake, round(2 / 8.0 * (v / 8) * exp(-pow(v / 8, 2)), 6) AS pdf FROM v""")
def wind_physics(spark, d):
    x = b.series(spark, d).select("event", (F.col("value") / 10).alias("v"))
    v, distance = F.col("v"), (100 + F.col("event") % 400).cast("double")
    dense = sc.air_density_speed(v, F.lit(1.1))
    return x.select(
        "event", r(sc.power_law(v, 10.0, 80.0, 0.14), 6).alias("hub"), r(sc.wind_capacity_factor(dense, [3, 12, 25], [0.0, 1.0, 1.0]), 6).alias("cf"),
        r(sc.shear_exponent(v + 1, 1.2 * v + 2, 10.0, 80.0), 6).alias("shear"), r(sc.wake_deficit(F.lit(0.8), distance, 40.0), 6).alias("wake"), r(sc.weibull_pdf(v, 2.0, 8.0), 6).alias("pdf"),
    )


@query(f"WITH {SERIES} SELECT category, round(0.5 * 1.225 * gamma(2.5) * pow(avg(value) / 10, 3), 4) AS power_density FROM series GROUP BY category")
def wind_power_density(spark, d):
    return b.series(spark, d).groupBy("category").agg(r(sc.weibull_power_density(F.avg("value") / 10, 2.0)).alias("power_density"))


SUN = f"{SERIES}, x AS (SELECT event, category, value * 2 AS g, CAST(10 + hour % 24 AS DOUBLE) AS air FROM series), y AS (SELECT *, air + 25 / 800.0 * g AS cell FROM x)"


def sun(spark, d):
    return b.series(spark, d).select("event", "category", (F.col("value") * 2).alias("g"), (10 + F.col("hour") % 24).cast("double").alias("air"))


@query(f"""WITH {SUN}, z AS (SELECT *, 1 - 0.004 * (cell - 25) AS derate, least(1, greatest(0, g / 1000 * 0.8)) AS cf FROM y)
SELECT event, round(cell, 8) AS cell, round(derate, 10) AS derate, round(cf, 6) AS cf, round(least(1, greatest(0, cf * 0.98 * (1 - 0.004 * 1.5))), 6) AS warmer, round(least(1, g / 1361), 6) AS clearness, round(greatest(0, g / 1000 * derate * 0.85), 6) AS rooftop FROM z""")
def solar_physics(spark, d):
    g, air = F.col("g"), F.col("air")
    cell, cf = sc.cell_temperature(air, g), sc.solar_capacity_factor(g)
    return sun(spark, d).select(
        "event", r(cell, 8).alias("cell"), r(sc.temperature_derate(cell), 10).alias("derate"), r(cf, 6).alias("cf"), r(sc.climate_availability(cf, "solar", ghi=-0.02, warming=1.5), 6).alias("warmer"),
        r(ad.clearness(g, F.lit(1361.0)), 6).alias("clearness"), r(ad.rooftop_cf(g, air), 6).alias("rooftop"),
    )


@query(f"WITH {SUN} SELECT category, round(sum(g) / 1000 / greatest(count(*) / 24.0, 1), 6) AS sun_hours, round(avg(least(1.5, greatest(0, 1 - 0.004 * (cell - 25)))), 6) AS performance FROM y WHERE g > 0 GROUP BY category")
def sun_measures(spark, d):
    return sun(spark, d).groupBy("category").agg(r(pr.peak_sun_hours("g"), 6).alias("sun_hours"), r(pr.performance_ratio("g", "air", -0.4, 45.0), 6).alias("performance"))


@query(f"WITH {DEMAND} SELECT order_key, round(mw * (1 + 0.01 * greatest(18.0 - order_key % 35, 0) + 0.02 * greatest(order_key % 35 - 24.0, 0)), 4) AS mw FROM demand")
def climate_adjusted_demand(spark, d):
    temperature = (F.col("order_key") % 35).cast("double")
    return b.demand(spark, d).select("order_key", r(ad.climate_demand(F.col("mw"), temperature, 0.01, 0.02)).alias("mw"))


@query(f"WITH {SERIES}, x AS (SELECT category, CAST(ts AS DATE) AS day, avg(value) / 3 AS dt FROM series GROUP BY 1, 2) SELECT category, day, round(0.9 * least(1.2, greatest(0, dt / 20)), 6) AS cf, round(1 - 278.15 / (278.15 + dt), 6) AS carnot FROM x")
def ocean_thermal_days(spark, d):
    x = b.series(spark, d).groupBy("category", F.to_date("ts").alias("day")).agg((F.avg("value") / 3).alias("dt"))
    return x.select("category", "day", r(sc.otec_capacity_factor(F.col("dt"), 0.9, 20.0), 6).alias("cf"), r(sc.carnot(F.lit(5.0), 5.0 + F.col("dt")), 6).alias("carnot"))


@query(f"""WITH {SERIES}, x AS (SELECT category, CAST(ts AS DATE) AS day, avg(value) AS v FROM series GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY category) AS n FROM x)
SELECT category, CAST(h AS INTEGER) AS hour, round(v, 8) AS v FROM range(8760) g(h) JOIN k ON i = least(floor(h / 24), n - 1)""")
def daily_to_hourly(spark, d):
    x = b.series(spark, d).groupBy("category", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return pr.daily_to_hourly(x, ["category"], "day", "v").select("category", "hour", r("v", 8).alias("v"))


@query(f"WITH {SERIES} SELECT category, CAST(floor(hour / 6.0) AS BIGINT) AS step, round(avg(value), 8) AS mean FROM series GROUP BY 1, 2")
def upscaled_steps(spark, d):
    return b.series(spark, d).groupBy("category", pr.upscaled_step(F.col("hour"), 4).alias("step")).agg(r(F.avg("value"), 8).alias("mean"))


@query(f"""WITH {DEMAND}, x AS (SELECT node, day, min(mw) / 1e4 AS lo, max(mw) / 1e4 AS hi FROM demand GROUP BY 1, 2), y AS (SELECT node, day, h, (hi + lo) / 2 + (hi - lo) / 2 * cos(2 * pi() * (h - 14) / 24) AS tmp FROM x, range(24) g(h))
SELECT node, CAST(h AS INTEGER) AS hour, round(avg(tmp), 4) AS temperature FROM y GROUP BY 1, 2""")
def hourly_temperature(spark, d):
    x = b.demand(spark, d).groupBy("node", "day").agg((F.min("mw") / 1e4).alias("lo"), (F.max("mw") / 1e4).alias("hi"))
    return t.daily_to_hourly_temperature(x, "lo", "hi").groupBy("node", "hour").agg(r(F.avg("temperature")).alias("temperature"))


@query(f"WITH {GEN} SELECT year, count(*) AS n, round(sum(mw), 2) AS mw FROM gen WHERE NOT (month(day) = 2 AND day(day) = 29) GROUP BY year")
def without_leap_days(spark, d):
    return t.without_leap_day(b.generation(spark, d), "day").groupBy("year").agg(F.count("*").alias("n"), r(F.sum("mw"), 2).alias("mw"))


@query(f"""WITH {SERIES}, h AS (SELECT category, date_trunc('hour', ts) AS ts, avg(value) AS v FROM series GROUP BY 1, 2), g AS (SELECT category, x AS ts FROM (SELECT DISTINCT category FROM series), generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31 23:00:00', INTERVAL 1 HOUR) g(x) WHERE NOT (month(x) = 2 AND day(x) = 29)),
 n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ts) - 1 AS hour FROM g) SELECT category, count(*) AS hours, CAST(max(hour) AS INTEGER) AS last, count(v) AS known, round(sum(v * hour), 4) AS moment FROM n LEFT JOIN h USING (category, ts) GROUP BY category""")
def aligned_year(spark, d):
    s = est.hourly_left(b.series(spark, d), ["category"], "ts", "value").withColumnRenamed("hour_ts", "ts")
    x = est.full_year(s, ["category"], "ts", "value", 2024)
    return x.groupBy("category").agg(F.count("*").alias("hours"), F.max("hour").alias("last"), F.count("value").alias("known"), r(F.sum(F.col("value") * F.col("hour")), 4).alias("moment"))


YEARS = f"{DEMAND}, y AS (SELECT DISTINCT year, year - 1995 AS t FROM demand)"


@query(f"""WITH {YEARS} SELECT year, round(1e6 / (1 + exp(-0.5 * (year - 1998))), 4) AS fleet, round(1000 * (1 - exp(-0.41 * t)) / (1 + 0.38 / 0.03 * exp(-0.41 * t)), 6) AS bass, round(exp(-0.3 * (2 + t)), 8) AS adoption,
 round(1000.0 * t * 0.8 * 0.3 * 7 * 0.8 / 1000, 6) AS v2g_mw, round((50 + t) * 0.85, 6) AS payment, round(40 / (1 + exp(-1.2 * (t - 3))), 6) AS logistic FROM y""")
def adoption_curves(spark, d):
    y = b.demand(spark, d).select("year").distinct().withColumn("t", F.col("year") - 1995)
    f = ad.fleet(y, "year", 1e6, 0.5, 1998)
    k = F.col("t")
    return f.select(
        "year", r("vehicles").alias("fleet"), r(sc.bass(k, 1000.0, 0.03, 0.38), 6).alias("bass"), r(dem.techno_economic_adoption(2 + k), 8).alias("adoption"),
        r(ad.v2g_available(1000.0 * k, F.lit(0.8), 0.3, 7.0, 0.2), 6).alias("v2g_mw"), r(ad.v2g_payment(50 + k), 6).alias("payment"), r(sc.logistic(k, 40.0, 1.2, 3.0), 6).alias("logistic"),
    )


@query("""WITH c AS (SELECT * FROM (VALUES (1.0, 8.0, 22.0, 3.0), (0.1, 120.0, 2.0, 4.0), (0.3, 20.0, 20.0, 2.0)) x(share, kwh, peak, width)), h AS (SELECT h FROM range(24) g(h)),
 w AS (SELECT share, kwh, h, exp(-pow(abs((h - peak + 36) % 24 - 12), 2) / (2 * width * width)) AS w FROM c, h), n AS (SELECT share, kwh, h, w / sum(w) OVER (PARTITION BY share) AS w FROM w), nd AS (SELECT n_nationkey AS node, 1000.0 + n_nationkey * 10 AS fleet FROM nation)
SELECT node, CAST(h AS INTEGER) AS hour, round(sum(fleet * share * kwh / 1000 * w), 6) AS mw, round(any_value(40 + 20 * exp(-pow(h - 8, 2) / 8.0) + 35 * exp(-pow(h - 19, 2) / 18.0)), 6) AS price FROM n, nd GROUP BY node, h""")
def electric_vehicle_hours(spark, d):
    """Charging of three kinds of vehicles, summed by node and hour, and a synthetic price."""
    kinds = [(1.0, 8.0, 22.0, 3.0), (0.1, 120.0, 2.0, 4.0), (0.3, 20.0, 20.0, 2.0)]
    x = b.nodes(spark, d).select("node", (1000.0 + F.col("node") * 10).alias("fleet")).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    parts = F.array(*(ad.charging_profile(F.col("fleet") * share, kwh, F.col("hour"), peak, width) for share, kwh, peak, width in kinds))
    mw = x.withColumn("mw", F.explode(parts)).groupBy("node", "hour").agg(r(F.sum("mw"), 6).alias("mw"))
    return mw.withColumn("price", r(ad.price_shape(F.col("hour"), 40.0, [(8.0, 20.0, 2.0), (19.0, 35.0, 3.0)]), 6))


FUELS = ["sun", "wind", "water", "naturalgas", "coal", "fuel_oil", "diesel", "nuclear", "biomass", "biogas", "waste", "other"]
HINTS = ["", "offshore", "pumped", "run of river", "open cycle", "combined cycle", "steam"]


@query(f"""WITH x AS (SELECT p_partkey AS part, [{', '.join(repr(f) for f in FUELS)}][p_partkey % 12 + 1] AS fuel, [{', '.join(repr(h) for h in HINTS)}][p_size % 7 + 1] AS hint, p_size * 4.0 AS cap FROM part)
SELECT part, CASE WHEN fuel = 'sun' THEN 'PV' WHEN fuel = 'wind' THEN CASE WHEN hint = 'offshore' THEN 'Offshore Wind' ELSE 'Onshore Wind' END WHEN fuel = 'water' THEN CASE hint WHEN 'pumped' THEN 'Pumped Storage' WHEN 'run of river' THEN 'Run-Of-River' ELSE 'Reservoir' END
 WHEN fuel = 'naturalgas' THEN CASE WHEN hint = 'open cycle' THEN 'OCGT' WHEN hint = 'combined cycle' THEN 'CCGT' WHEN cap > 0 AND cap < 100 THEN 'OCGT' ELSE 'CCGT' END WHEN fuel = 'coal' THEN 'Coal ST' WHEN fuel = 'fuel_oil' THEN 'Oil ST' WHEN fuel = 'diesel' THEN CASE WHEN hint = 'steam' THEN 'Oil ST' ELSE 'Combustion Engine' END
 WHEN fuel = 'nuclear' THEN 'Nuclear' WHEN fuel = 'biomass' THEN 'Biomass ST' WHEN fuel = 'biogas' THEN 'Biogas Engine' WHEN fuel = 'waste' THEN 'Waste-to-Energy' ELSE 'Other' END AS technology FROM x""")
def technology_classes(spark, d):
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    p = b.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("part"), sc.technology_class(pick(FUELS, F.col("p_partkey") % 12), pick(HINTS, F.col("p_size") % 7), F.col("p_size") * 4.0).alias("technology"))


@query("""WITH ty AS (SELECT * FROM (VALUES (33.0, 0.250, 0.400, 8.5), (66.0, 0.150, 0.400, 8.8), (110.0, 0.095, 0.380, 9.2), (132.0, 0.090, 0.370, 9.3), (220.0, 0.060, 0.301, 12.5), (300.0, 0.040, 0.265, 13.2), (380.0, 0.030, 0.246, 13.8), (500.0, 0.020, 0.270, 13.0), (750.0, 0.013, 0.276, 13.1)) x(v, r, x, c)),
 l AS (SELECT s_suppkey AS line, CASE WHEN s_suppkey % 50 = 0 THEN 110.0 ELSE s_suppkey * 17 % 800 + 0.25 END AS kv FROM supplier) SELECT line, CAST(arg_min(r, abs(v - kv)) AS DOUBLE) AS r, CAST(arg_min(x, abs(v - kv)) AS DOUBLE) AS x, round(100 * pi() * arg_min(c, abs(v - kv)) * 0.001, 6) AS b FROM l, ty GROUP BY line""")
def line_parameters(spark, d):
    k = F.col("s_suppkey")
    kv = F.when(k % 50 == 0, 0.0).otherwise(k * 17 % 800 + 0.25)
    x = b.table(spark, d, "supplier").select(k.alias("line"), sc.line_parameters(kv).alias("p"))
    return x.select("line", F.col("p.r").alias("r"), F.col("p.x").alias("x"), r("p.b", 6).alias("b"))


@query("""SELECT p_partkey AS part, CAST(p_size AS DOUBLE) AS kv, round(CAST(CASE p_size % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000.0 ELSE p_size * 0.001 END AS DOUBLE), 9) AS mw, ['Natural Gas', 'Oil', 'Coal', 'Solar', 'Wind', 'Hydro', 'Peat Moss'][p_partkey % 7 + 1] AS fuel, p_brand || ' - ' || p_type AS safe, p_size + 2.5 AS numbers FROM part""")
def text_tags(spark, d):
    """Voltages, capacities, fuels, safe names and lists of numbers as text."""
    p, size = b.table(spark, d, "part"), F.col("p_size")
    fuels = F.array(*map(F.lit, ["LNG", "hfo", "hard_coal", "pv", "offshore wind", "water", "peat_moss"]))
    return p.select(
        F.col("p_partkey").alias("part"), sc.voltage_kv(F.concat_ws(";", size * 500, size * 1000, F.lit("x"))).alias("kv"),
        r(sc.capacity_mw(F.concat_ws(" ", size, F.element_at(F.array(F.lit("MW"), F.lit("GW"), F.lit("kW")), size % 3 + 1))), 9).alias("mw"),
        sc.fuel_name(F.element_at(fuels, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("fuel"), sc.safe_name(F.concat_ws("/", "p_brand", "p_type")).alias("safe"), F.aggregate(sc.number_list(F.concat(F.lit("["), size, F.lit(", 2.5]"))), F.lit(0.0), lambda a, x: a + x).alias("numbers"),
    )


@query("SELECT p_partkey AS part, CASE WHEN p_size % 4 = 0 THEN p_size > 20 WHEN p_size % 4 = 1 THEN p_size > 10 WHEN p_size % 4 = 2 THEN true ELSE p_brand IS NOT NULL END AS complete FROM part")
def complete_features(spark, d):
    size = F.col("p_size")
    kind = F.when(size % 4 == 0, "generator").when(size % 4 == 1, "line").when(size % 4 == 2, "substation").otherwise("area")
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("part"), ft.complete(kind, F.col("p_brand"), size - 20, size - 10).alias("complete"))


@query(f"WITH {UNITS}, x AS (SELECT unit, h // 24 AS day, CASE WHEN h >= unit * 7919 % 8000 AND h < unit * 7919 % 8000 + 504 THEN 0.0 ELSE 0.85 / ((8760 - 504) / 8760.0) END AS cf FROM units, range(0, 8760) g(h)) SELECT unit, CAST(day AS INTEGER) AS day, round(avg(cf), 8) AS cf, count(*) FILTER (cf = 0) AS out_hours FROM x GROUP BY 1, 2")
def thermal_availability(spark, d):
    """Planned outages of firm units: each day's mean of all hours, and its hours out."""
    x = pr.thermal_profile(b.units(spark, d), "unit", F.col("unit") * 7919 % 8000, 3.0, 0.85).withColumn("day", F.floor(F.col("hour") / 24).cast("int"))
    return x.groupBy("unit", "day").agg(r(F.avg("cf"), 8).alias("cf"), F.count_if(F.col("cf") == 0).alias("out_hours"))


@query(f"""WITH {UNITS}, s AS (SELECT unit, h // 730 AS month, 0.3 + unit % 5 / 10.0 AS annual, CASE WHEN unit % 7 = 0 THEN 0.5 + 0.4 * sin(2 * pi() * (h / 8760.0 - 0.30)) + 0.3 * sin(4 * pi() * (h / 8760.0 - 0.05)) ELSE 0.6 + 0.5 * cos(2 * pi() * (h / 8760.0 - CASE WHEN unit % 2 = 0 THEN 0.40 ELSE 0.90 END)) END AS raw FROM units, range(0, 8760) g(h)),
 c AS (SELECT *, least(1.5, greatest(0.05, raw)) AS shape FROM s) SELECT unit, CAST(month AS INTEGER) AS month, round(avg(least(1, greatest(0, shape * annual / m))), 6) AS cf FROM (SELECT *, avg(shape) OVER (PARTITION BY unit) AS m FROM c) GROUP BY 1, 2""")
def hydro_availability(spark, d):
    """Run-of-river availability of each unit by its latitude, as means of blocks of 730 hours."""
    lat = F.when(F.col("unit") % 7 == 0, 5.0).when(F.col("unit") % 2 == 0, 45.0).otherwise(-30.0)
    u = b.units(spark, d).select("unit", lat.alias("lat"), (0.3 + F.col("unit") % 5 / 10.0).alias("annual"))
    x = pr.hydro_profiles(u, "unit", "lat", "annual").withColumn("month", F.floor(F.col("hour") / 730).cast("int"))
    return x.groupBy("unit", "month").agg(r(F.avg("cf"), 6).alias("cf"))


@query(f"WITH {SERIES} SELECT event, round(value * 1.5 + 10, 3) AS corrected FROM series")
def quantile_mapping(spark, d):
    """Bias correction towards a linear change of the same values gives that change."""
    s = b.series(spark, d)
    return ad.quantile_map(s, s.withColumn("value", F.col("value") * 1.5 + 10), ["category"], "value").select("event", r("corrected", 3).alias("corrected"))


@query(f"WITH {SERIES} SELECT category, count(*) AS n FROM series WHERE category IS NOT NULL AND NOT contains(category, 'log') GROUP BY category")
def measured_only(spark, d):
    return est.real_only(b.series(spark, d), "category", "log").groupBy("category").agg(F.count("*").alias("n"))


@query(f"""WITH {DEMAND}, h AS (SELECT DISTINCT node, day AS hol FROM demand WHERE day(day) = 1), s AS (SELECT DISTINCT node, day FROM demand), j AS (SELECT s.node, s.day, min(CASE WHEN hol >= s.day THEN hol - s.day END) AS a, min(CASE WHEN hol <= s.day THEN s.day - hol END) AS z FROM s LEFT JOIN h ON h.node = s.node AND abs(hol - s.day) <= 7 GROUP BY 1, 2)
SELECT node, day, coalesce(a = 0, false) AS is_holiday, CAST(coalesce(a, 7) AS INTEGER) AS days_to, CAST(coalesce(z, 7) AS INTEGER) AS days_from FROM j""")
def holiday_features(spark, d):
    s = b.demand(spark, d).select("node", "day").distinct()
    return est.holidays(s, s.where("day(day) = 1").select("node", F.col("day").alias("hol")), "node", "day", "hol").select("node", "day", "is_holiday", "days_to", "days_from")


@query(f"""WITH {DEMAND}, y AS (SELECT node, year, ln(sum(mw)) AS q, ln(count(*) + 100.0) AS g FROM demand GROUP BY 1, 2) SELECT node, round(regr_slope(q, g), 5) AS elasticity, round(regr_r2(q, g), 5) AS r2 FROM y GROUP BY node""")
def demand_elasticity(spark, d):
    y = b.demand(spark, d).groupBy("node", "year").agg(F.sum("mw").alias("q"), (F.count("*") + 100.0).alias("g"))
    return est.gdp_elasticity(y, ["node"], "q", "g").select("node", r("elasticity", 5).alias("elasticity"), r("r2", 5).alias("r2"))


@query(f"""WITH {DEMAND}, a AS (SELECT node, sum(mw) AS e FROM demand GROUP BY node), m AS (SELECT node, month(day) AS month, sum(mw) AS s FROM demand GROUP BY 1, 2), dd AS (SELECT node, month(day) AS month, day(day) AS day, sum(mw) AS s FROM demand GROUP BY 1, 2, 3)
SELECT dd.node, CAST(dd.month AS INTEGER) AS month, CAST(dd.day AS INTEGER) AS day, round(dd.s, 2) AS e FROM dd""")
def energy_cascade(spark, d):
    """Annual energy over months and days by the demand's own shares gives the demand of each day."""
    x = b.demand(spark, d).withColumn("month", F.month("day")).withColumn("dom", F.dayofmonth("day"))
    monthly = x.groupBy("node", "month").agg(F.sum("mw").alias("share"))
    daily = x.groupBy("node", "month", F.col("dom").alias("day")).agg(F.sum("mw").alias("share"))
    return est.cascade(x.groupBy("node").agg(F.sum("mw").alias("e")), monthly, daily, "e").select("node", "month", "day", r("e", 2).alias("e"))


@query(f"WITH {SERIES}, a AS (SELECT category, sum(value) * 3 AS e FROM series GROUP BY category), s AS (SELECT category, hour, sum(value) AS w FROM series GROUP BY 1, 2) SELECT category, hour, round(e * w / sum(w) OVER (PARTITION BY category), 4) AS mw FROM s JOIN a USING (category)")
def hourly_from_annual(spark, d):
    s = b.series(spark, d)
    shape = s.groupBy("category", "hour").agg(F.sum("value").alias("w"))
    return dem.hourly_from_annual(s.groupBy("category").agg((F.sum("value") * 3).alias("e")), shape, "e", ["category"], "w").select("category", "hour", r("mw").alias("mw"))


@query(f"""WITH RECURSIVE {DEMAND}, b0 AS (SELECT sum(mw) AS base FROM demand WHERE year = 1995), s AS (SELECT 1995 AS year, base AS level, CAST(0 AS DOUBLE) AS share FROM b0 UNION ALL SELECT year + 1, level * (1 + 0.03 * 0.8) * (1 - 0.01), share + 0.02 * (1 - share / 0.4) FROM s WHERE year < 2004)
SELECT CAST(year AS INTEGER) AS year, round(level * (1 + share), 2) AS demand FROM s""")
def demand_trajectory(spark, d):
    base = b.demand(spark, d).where("year = 1995").agg(F.sum("mw")).first()[0]  # the first year is the parameter
    return dem.trajectory(spark, base, 1995, 10, 0.03, 0.8, 0.01, 0.02, 0.4).withColumn("demand", r("demand", 2))


@query(f"""WITH {SERIES}, wx AS (SELECT category, CAST(ts AS DATE) AS day, avg(value) AS t_day, max(value) - min(value) AS t_range FROM series GROUP BY 1, 2), lagged AS (SELECT *, lag(t_day) OVER (PARTITION BY category ORDER BY day) AS t_lag1 FROM wx), m AS (SELECT category, avg(value) AS n FROM series GROUP BY 1)
SELECT event, round(value / n, 6) AS relative, round(t_day, 6) AS t_day, round(t_lag1, 6) AS t_lag1, round(t_range, 6) AS t_range, dayofweek(ts) IN (0, 6) AS weekend FROM series JOIN m USING (category) JOIN lagged ON lagged.category = series.category AND lagged.day = CAST(ts AS DATE)""")
def training_dataset(spark, d):
    s = b.series(spark, d)
    x = est.training_rows(s, s, ["category"], "ts", "value", "value")
    return x.select("event", r("relative", 6).alias("relative"), r("t_day", 6).alias("t_day"), r("t_lag1", 6).alias("t_lag1"), r("t_range", 6).alias("t_range"), "weekend")


@query(f"""WITH {DEMAND}, y AS (SELECT min(year) AS lo, max(year) AS hi FROM demand), f AS (SELECT k AS fold, lo + 2 + k AS y FROM y, range(0, 20) g(k) WHERE lo + 2 + k <= hi) SELECT CAST(fold AS INTEGER) AS fold, count(CASE WHEN year < y THEN 1 END) AS train, count(CASE WHEN year = y THEN 1 END) AS test FROM demand, f GROUP BY fold""")
def expanding_folds(spark, d):
    x = b.demand(spark, d)
    lo, hi = x.agg(F.min("year"), F.max("year")).first()
    folds = F.array(*(F.struct(F.lit(k).alias("fold"), F.lit(a).alias("a"), F.lit(z).alias("z"), F.lit(p).alias("p"), F.lit(q).alias("q")) for k, a, z, p, q in dem.expanding_folds(lo, hi, 2)))
    e = x.withColumn("f", F.explode(folds)).select("year", "f.*")
    between = lambda p, q: F.sum(F.col("year").between(F.col(p), F.col(q)).cast("long"))
    return e.groupBy("fold").agg(between("a", "z").alias("train"), between("p", "q").alias("test"))
