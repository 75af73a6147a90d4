"""Stores with limits, adoption round by round, joint hazards, fits of extremes, and the choice of k."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattspan import bindings as b
from wattspan.operators import adoption as ad
from wattspan.operators import demand as dem
from wattspan.operators import risk as rk
from wattspan.operators import storage as st
from wattspan.queries import DEMAND, GT, SERIES, query, r

# Stores. A fleet charges and drives hour by hour; a fuel is supplied and used month by month.
FLEET = f"{SERIES}, ch AS (SELECT entity, hour, sum(CASE WHEN event % 3 = 0 THEN -value / 0.95 ELSE 0.45 * value END) AS delta FROM series GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY hour) AS k FROM ch)"
FLEET_LEVELS = f"""WITH RECURSIVE {FLEET}, lv AS (
 SELECT entity, CAST(0 AS BIGINT) AS k, -1 AS hour, CAST(60 AS DOUBLE) AS level, CAST(0 AS DOUBLE) AS spill, CAST(0 AS DOUBLE) AS shortage FROM (SELECT DISTINCT entity FROM ch)
 UNION ALL SELECT lv.entity, n.k, n.hour, least(120, greatest(20, level + delta)), greatest(level + delta - 120, 0), greatest(20 - level - delta, 0) FROM lv JOIN n ON n.entity = lv.entity AND n.k = lv.k + 1)"""


def fleet(spark, d):
    s = b.series(spark, d)
    net = F.when(F.col("event") % 3 == 0, -F.col("value") / 0.95).otherwise(0.45 * F.col("value"))
    ch = s.groupBy("entity", "hour").agg(F.sum(net).alias("delta"))
    start = s.select("entity", F.lit(60.0).alias("start")).distinct()
    return st.bounded_levels(ch, ["entity"], "hour", "delta", F.lit(20.0), F.lit(120.0), start), start


@query(f"{FLEET_LEVELS} SELECT entity, hour, round(level, 6) AS level, round(spill, 6) AS spill, round(shortage, 6) AS shortage FROM lv WHERE k > 0")
def fleet_levels(spark, d):
    """Charge of each vehicle fleet after each hour, within its bounds."""
    return fleet(spark, d)[0].select("entity", F.col("hour").cast("int").alias("hour"), r("level", 6).alias("level"), r("spill", 6).alias("spill"), r("shortage", 6).alias("shortage"))


@query(f"{FLEET_LEVELS} SELECT entity, round(arg_max(level, k) - 60, 6) AS gap FROM lv GROUP BY entity")
def fleet_return_gap(spark, d):
    """How far each fleet ends from the charge it began with."""
    levels, start = fleet(spark, d)
    return st.cyclic_gap(levels, ["entity"], "hour", start).select("entity", r("gap", 6).alias("gap"))


@query(f"""WITH RECURSIVE {GT}, ch AS (SELECT tech, (year - 1990) * 12 + CAST(month(day) AS INTEGER) AS period, sum(CASE WHEN order_key % 2 = 0 THEN mw ELSE -mw END) AS delta FROM gt GROUP BY 1, 2),
 n AS (SELECT *, row_number() OVER (PARTITION BY tech ORDER BY period) AS k FROM ch), lv AS (
 SELECT tech, CAST(0 AS BIGINT) AS k, -1 AS period, CAST(100 AS DOUBLE) AS level, CAST(0 AS DOUBLE) AS spill, CAST(0 AS DOUBLE) AS shortage FROM (SELECT DISTINCT tech FROM ch)
 UNION ALL SELECT lv.tech, n.k, n.period, least(500, greatest(0, 0.99 * level + delta)), greatest(0.99 * level + delta - 500, 0), greatest(-0.99 * level - delta, 0) FROM lv JOIN n ON n.tech = lv.tech AND n.k = lv.k + 1)
 SELECT tech, period, round(level, 6) AS level, round(spill, 6) AS spill, round(shortage, 6) AS shortage FROM lv WHERE k > 0""")
def fuel_storage(spark, d):
    """Fuel in store after each month, with losses, of supply and use by technology."""
    x = b.generation_by_tech(spark, d).withColumn("period", (F.col("year") - 1990) * 12 + F.month("day"))
    ch = x.groupBy("tech", "period").agg(F.sum(F.when(F.col("order_key") % 2 == 0, F.col("mw")).otherwise(-F.col("mw"))).alias("delta"))
    levels = st.bounded_levels(ch, ["tech"], "period", "delta", F.lit(0.0), F.lit(500.0), ch.select("tech", F.lit(100.0).alias("start")).distinct(), keep=0.99)
    return levels.select("tech", F.col("period").cast("int").alias("period"), r("level", 6).alias("level"), r("spill", 6).alias("spill"), r("shortage", 6).alias("shortage"))


# Adoption: households are customers; four years in two runs.
YEARS, RUNS, COST, TARIFF, NEAR_KM = (2030, 2031, 2032, 2033), 2, 500.0, 0.35, 3.0
_DRAW = "((((({k} * 7919 + {y} * 104729 + {r} * 1299709 + {s} * 15485863) % 2147483647) * 48271 % 2147483647) * 16807 % 2147483647) + 0.5) / 2147483648.0"


def _normal(y: int, salt: int, spread: float) -> str:
    u = lambda s: _DRAW.format(k="s.agent", y=y, r="s.run", s=s)
    return f"{spread} * sqrt(-2 * ln({u(salt)})) * cos(2 * pi() * {u(salt + 1)})"


def _adoption_sql() -> str:
    parts = [
        "h AS (SELECT c_custkey AS agent, 0.02 + (c_custkey % 29) / 100.0 AS rate, CAST(40 + (c_custkey * 37 % 1000) / 500.0 AS DOUBLE) AS lat, CAST(-4 + (c_custkey * 91 % 1000) / 500.0 AS DOUBLE) AS lon FROM customer)",
        f"near AS (SELECT p.agent AS a, q.agent AS b FROM h p JOIN h q ON p.agent <> q.agent AND q.lat BETWEEN p.lat - 0.05 AND p.lat + 0.05 WHERE 2 * 6371 * asin(sqrt(least(1, pow(sin(radians(p.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - q.lon) / 2), 2)))) <= {NEAR_KM})",
        "many AS (SELECT a, count(*) + 1 AS n FROM near GROUP BY a)",
        f"s0 AS (SELECT agent, rate, n, run, CAST(NULL AS BIGINT) AS year FROM h LEFT JOIN many ON a = agent, range(0, {RUNS}) x(run))",
    ]
    for t, y in enumerate(YEARS):
        annuity = "rate * pow(1 + rate, 25) / (pow(1 + rate, 25) - 1)"
        economic = f"1 / (1 + exp(-10 * ({TARIFF} - {COST} * pow(0.96, {t}) * {annuity} / 1280.0)))"
        aware = f"greatest(0, least(1, 1 / (1 + exp(-0.3 * ({t} - 10))) + {_normal(y, 1, 0.1)}))"
        parts.append(f"p{t} AS (SELECT s.run, near.a, count(*) AS k FROM s{t} s JOIN near ON s.agent = near.b WHERE year IS NOT NULL GROUP BY 1, 2)")
        parts.append(f"s{t + 1} AS (SELECT s.agent, rate, n, s.run, coalesce(year, CASE WHEN 0.5 * {economic} + 0.3 * coalesce(k / n, 0) + 0.2 * {aware} > 0.5 + {_normal(y, 3, 0.05)} THEN {y} END) AS year FROM s{t} s LEFT JOIN p{t} p ON p.a = s.agent AND p.run = s.run)")
    return "WITH " + ",\n ".join(parts) + f" SELECT run, agent, year FROM s{len(YEARS)}"


def adopters(spark, d):
    c = b.table(spark, d, "customer")
    h = c.select(F.col("c_custkey").alias("agent"), (0.02 + F.col("c_custkey") % 29 / 100.0).alias("rate"), (40 + (F.col("c_custkey") * 37 % 1000) / 500.0).alias("lat"), (-4 + (F.col("c_custkey") * 91 % 1000) / 500.0).alias("lon"))
    return ad.adoption_rounds(h, "agent", "rate", "lat", "lon", YEARS, RUNS, COST, TARIFF, NEAR_KM)


@query(_adoption_sql())
def household_adoption(spark, d):
    """When each household adopts in each run."""
    return adopters(spark, d)


@query(f"WITH a AS ({_adoption_sql()}), s AS (SELECT y AS year, run, avg(CASE WHEN year <= y THEN 1.0 ELSE 0 END) AS share FROM a, (VALUES {', '.join(f'({y})' for y in YEARS)}) v(y) GROUP BY 1, 2) SELECT year, round(avg(share), 9) AS mean, round(quantile_cont(share, 0.1), 9) AS low, round(quantile_cont(share, 0.9), 9) AS high FROM s GROUP BY year")
def adoption_penetration(spark, d):
    return ad.penetration(adopters(spark, d), YEARS).select("year", r("mean", 9).alias("mean"), r("low", 9).alias("low"), r("high", 9).alias("high"))


# Hazards of a unit: a probability for each of its order lines. The SQL integrates over the common factor by trapezoids.
_CDF = """(CASE WHEN {z} > 0 THEN 1 ELSE 0 END + CASE WHEN {z} > 0 THEN -1 ELSE 1 END * exp(-{z} * {z} / 2)
 * ((((((0.0352624965998911 * abs({z}) + 0.700383064443688) * abs({z}) + 6.37396220353165) * abs({z}) + 33.912866078383) * abs({z}) + 112.079291497871) * abs({z}) + 221.213596169931) * abs({z}) + 220.206867912376)
 / (((((((0.0883883476483184 * abs({z}) + 1.75566716318264) * abs({z}) + 16.064177579207) * abs({z}) + 86.7807322029461) * abs({z}) + 296.564248779674) * abs({z}) + 637.333633378831) * abs({z}) + 793.826512519948) * abs({z}) + 440.413735824752))"""


@query(f"""WITH RECURSIVE p AS (SELECT l_suppkey AS node, (l_discount + 0.01) / 40 AS p, count(*) AS k FROM lineitem GROUP BY 1, 2), q AS (
 SELECT p, 0 AS i, CAST(-6 AS DOUBLE) AS lo, CAST(6 AS DOUBLE) AS hi FROM (SELECT DISTINCT p FROM p)
 UNION ALL SELECT p, i + 1, CASE WHEN {_CDF.format(z="((lo + hi) / 2)")} < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_CDF.format(z="((lo + hi) / 2)")} < p THEN hi ELSE (lo + hi) / 2 END FROM q WHERE i < 60
), z AS (SELECT p, (lo + hi) / 2 AS z FROM q WHERE i = 60), g AS (SELECT (i - 320) / 40.0 AS m FROM range(0, 641) x(i)),
 s AS (SELECT p, m, (sqrt(0.3) * m - z) / sqrt(0.7) AS u FROM z, g), l AS (SELECT p, m, ln({_CDF.format(z="u")}) AS l FROM s),
 f AS (SELECT node, m, sum(k * l) AS l FROM p JOIN l USING (p) GROUP BY 1, 2)
 SELECT node, round(1 - sum(exp(l) * exp(-m * m / 2)) / sqrt(2 * pi()) / 40, 7) AS combined FROM f GROUP BY node""")
def copula_hazards(spark, d):
    """Chance that any of a unit's hazards strikes, where all hang together by one factor."""
    x = b.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), ((F.col("l_discount") + 0.01) / 40).alias("p"))
    return rk.combine_gaussian(x, ["node"], "p", 0.3).select("node", r("combined", 7).alias("combined"))


@query(f"""WITH RECURSIVE {DEMAND}, y AS (SELECT node, year, max(mw) AS m FROM demand GROUP BY 1, 2), l AS (SELECT node, list(m) AS x, count(*) AS n, avg(m) AS mean, min(m) AS lo, max(m) AS hi FROM y GROUP BY node), s AS (
 SELECT node, 0 AS i, (hi - lo) / 1000 AS a, 10 * (hi - lo) AS b FROM l WHERE n >= 3 AND hi > lo
 UNION ALL SELECT s.node, i + 1, CASE WHEN f < 0 THEN (a + b) / 2 ELSE a END, CASE WHEN f < 0 THEN b ELSE (a + b) / 2 END
 FROM (SELECT s.*, (a + b) / 2 - mean + lo + list_sum(list_transform(x, lambda v: (v - lo) * exp(-2 * (v - lo) / (a + b)))) / list_sum(list_transform(x, lambda v: exp(-2 * (v - lo) / (a + b)))) AS f FROM s JOIN l ON l.node = s.node WHERE i < 80) s)
 SELECT node, n, round(coalesce(lo - a * ln(list_sum(list_transform(x, lambda v: exp(-(v - lo) / a))) / n), hi), 3) AS location, round(coalesce(a, 0), 3) AS scale FROM l LEFT JOIN s USING (node) WHERE i = 80 OR i IS NULL""")
def gumbel_likelihood(spark, d):
    """Greatest-likelihood fit of each node's yearly peaks."""
    y = b.demand(spark, d).groupBy("node", "year").agg(F.max("mw").alias("m"))
    return rk.gumbel_likelihood(y, ["node"], "m").select("node", "n", r("location", 3).alias("location"), r("scale", 3).alias("scale"))


# The choice of k: customers of a region stand together. The SQL takes the seeds as centres.
@query("""WITH RECURSIVE p AS (SELECT c_custkey AS id, n_regionkey % 5 * 100 + (c_custkey * 37 % 100) / 20.0 AS x, n_regionkey % 2 * 150 + (c_custkey * 91 % 100) / 20.0 AS y FROM customer JOIN nation ON c_nationkey = n_nationkey), s AS (
 SELECT 1 AS k, id, x, y, pow(x - (SELECT arg_min(x, id) FROM p), 2) + pow(y - (SELECT arg_min(y, id) FROM p), 2) AS d FROM p
 UNION ALL SELECT k + 1, id, x, y, least(d, pow(x - first_value(x) OVER w, 2) + pow(y - first_value(y) OVER w, 2)) FROM s WHERE k < 10 WINDOW w AS (ORDER BY d DESC, id)
), c AS (SELECT k, sum(d) AS d FROM s WHERE k >= 2 GROUP BY k), e AS (SELECT min(k) AS k0, max(k) AS k1, arg_min(d, k) AS d0, arg_max(d, k) AS d1 FROM c)
 SELECT CAST(arg_max(k, abs((k - k0) / (k1 - k0) + (d - d1) / (d0 - d1) - 1)) AS INTEGER) AS k FROM c, e""".replace("abs((k - k0) / (k1 - k0)", "abs((k - k0) * 1.0 / (k1 - k0)"))
def elbow_clusters(spark, d):
    """How many groups the customers' places form: one row."""
    n = b.nodes(spark, d).select(F.col("node").alias("c_nationkey"), F.col("system").alias("region"))
    c = b.table(spark, d, "customer").join(n, "c_nationkey")
    p = c.select(F.col("c_custkey").alias("id"), (F.col("region") % 5 * 100 + F.col("c_custkey") * 37 % 100 / 20.0).alias("x"), (F.col("region") % 2 * 150 + F.col("c_custkey") * 91 % 100 / 20.0).alias("y"))
    return spark.createDataFrame([(dem.elbow(dem.inertias(p, "id", ["x", "y"], 2, 10, rounds=3)),)], "k int")
