"""Metrics and aggregates of generation, demand and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan import bindings as b
from wattspan.operators import metrics as m
from wattspan.operators import temporal as t
from wattspan.queries import DEMAND, GEN, GT, NODES, SERIES, UNITS, query, r


@query(f"""WITH {GT}, {UNITS} SELECT year, tech, round(sum(cost) / sum(gt.mw), 4) AS lcoe, round(sum(gt.mw), 2) AS mwh, round(avg(gt.mw / rated_mw), 6) AS capacity_factor, count(*) AS n
FROM gt JOIN units USING (unit) GROUP BY year, tech""")
def flagship_lcoe_by_type_year(spark: SparkSession, d: str) -> DataFrame:
    g = b.generation_by_tech(spark, d).join(b.units(spark, d).select("unit", "rated_mw"), "unit")
    return g.groupBy("year", "tech").agg(r(F.sum("cost") / F.sum("mw")).alias("lcoe"), r(F.sum("mw"), 2).alias("mwh"), r(F.avg(F.col("mw") / F.col("rated_mw")), 6).alias("capacity_factor"), F.count("*").alias("n"))


@query(f"WITH {GEN}, {UNITS} SELECT unit, round(CASE WHEN any_value(rated_mw) > 0 THEN avg(mw) / any_value(rated_mw) ELSE 0 END, 6) AS capacity_factor FROM gen JOIN units USING (unit) GROUP BY unit")
def capacity_factor_by_unit(spark, d):
    g = b.generation(spark, d).select("unit", "mw").join(b.units(spark, d).select("unit", "rated_mw"), "unit")
    return m.capacity_factor(g, ["unit"], "mw", F.any_value("rated_mw")).withColumn("capacity_factor", r("capacity_factor", 6))


@query(f"WITH {GT} SELECT year, round(sum(CASE WHEN renewable THEN mw ELSE 0 END) / sum(mw), 6) AS re_share FROM gt GROUP BY year")
def re_share_generation(spark, d):
    return m.re_share_generation(["year"], b.generation_by_tech(spark, d), "mw", "renewable").withColumn("re_share", r("re_share", 6))


@query(f"""WITH {GT}, {UNITS}, {DEMAND}, a AS (SELECT node, year, sum(mw) * 1000 AS available FROM gt JOIN units USING (unit) WHERE renewable GROUP BY node, year),
 q AS (SELECT node, year, sum(mw) AS demand FROM demand GROUP BY node, year)
SELECT q.year, round(least(1.0, greatest(0.0, sum(least(coalesce(available, 0), demand)) / sum(demand))), 6) AS re_usable FROM q LEFT JOIN a USING (node, year) GROUP BY q.year""")
def re_usable_min(spark, d):
    g = b.generation_by_tech(spark, d).where("renewable").join(b.units(spark, d).select("unit", "node"), "unit")
    available = g.groupBy("node", "year").agg((F.sum("mw") * 1000).alias("available"))
    demand = b.demand(spark, d).groupBy("node", "year").agg(F.sum("mw").alias("demand"))
    return m.re_share_usable(available, demand, ["node", "year"], ["year"]).withColumn("re_usable", r("re_usable", 6))


@query(f"""WITH {GT}, {UNITS}, {NODES} SELECT system, year, round(sum(CASE WHEN renewable THEN greatest(mw, 0) ELSE 0 END) / sum(greatest(mw, 0)), 6) AS re_share
FROM gt JOIN units USING (unit) JOIN nodes USING (node) GROUP BY system, year""")
def re_share_by_system_clipped(spark, d):
    g = b.generation_by_tech(spark, d).join(b.units(spark, d).select("unit", "node"), "unit").join(b.nodes(spark, d).select("node", "system"), "node")
    return m.re_share_clipped(["system", "year"], g, "mw", "renewable").withColumn("re_share", r("re_share", 6))


@query(f"WITH {GT} SELECT tech, year, round(sum(mw * CASE tech WHEN 'LARGE' THEN 0.9 WHEN 'PROMO' THEN 0.4 WHEN 'STANDARD' THEN 0.6 ELSE 0 END), 3) AS t_co2 FROM gt GROUP BY tech, year")
def co2_by_type(spark, d):
    return m.emissions(b.generation_by_tech(spark, d), b.CO2_FACTOR, "tech", "mw", ["tech", "year"]).withColumn("t_co2", r("t_co2", 3))


@query(f"WITH {GT} SELECT year, round(sum(mw * CASE tech WHEN 'LARGE' THEN 0.9 WHEN 'PROMO' THEN 0.4 WHEN 'STANDARD' THEN 0.6 ELSE 0 END) / sum(mw), 6) AS intensity, round(sum(mw), 2) AS mwh FROM gt GROUP BY year")
def co2_intensity_by_year(spark, d):
    g = b.generation_by_tech(spark, d)
    co2 = m.emissions(g, b.CO2_FACTOR, "tech", "mw", ["year"])
    return co2.join(g.groupBy("year").agg(F.sum("mw").alias("mwh")), "year").select("year", r(F.col("t_co2") / F.col("mwh"), 6).alias("intensity"), r("mwh", 2).alias("mwh"))


@query(f"WITH {GT} SELECT tech, round(sum(mw * CASE tech WHEN 'LARGE' THEN 25.0 WHEN 'PROMO' THEN 45.0 WHEN 'STANDARD' THEN 35.0 ELSE 0 END), 2) AS fuel_cost FROM gt GROUP BY tech")
def fuel_cost_by_type(spark, d):
    costs = F.create_map(*(F.lit(x) for p in b.FUEL_COST.items() for x in p))
    return b.generation_by_tech(spark, d).groupBy("tech").agg(r(F.sum(F.col("mw") * F.try_element_at(costs, F.col("tech"))), 2).alias("fuel_cost"))


@query(f"WITH {GEN} SELECT unit, round(sum(price * mw) / sum(mw), 4) AS selling_price FROM gen WHERE mw > 1e-6 GROUP BY unit")
def selling_price(spark, d):
    return m.selling_price(b.generation(spark, d), ["unit"], "price", "mw").withColumn("selling_price", r("selling_price"))


@query(f"""WITH {GEN}, {UNITS}, p AS (SELECT day, node, avg(price) AS price FROM gen JOIN units USING (unit) GROUP BY day, node),
 s AS (SELECT *, avg(price) OVER (PARTITION BY day) AS energy FROM p)
SELECT node, round(avg(energy), 4) AS energy, round(avg(price - energy), 4) AS congestion, round(avg(price), 4) AS price FROM s GROUP BY node""")
def price_lambda_mu(spark, d):
    p = b.generation(spark, d).join(b.units(spark, d).select("unit", "node"), "unit").groupBy("day", "node").agg(F.avg("price").alias("price"))
    return m.price_split(p, "day", "price").groupBy("node").agg(r(F.avg("energy")).alias("energy"), r(F.avg("congestion")).alias("congestion"), r(F.avg("price")).alias("price"))


@query(f"WITH {GEN} SELECT year, round(CASE WHEN sum(mw) > 0 THEN sum(price * mw) / sum(mw) ELSE avg(price) END, 4) AS price FROM gen GROUP BY year")
def system_price_by_year(spark, d):
    return m.system_price(b.generation(spark, d), ["year"], "price", "mw").withColumn("price", r("price"))


@query(f"""WITH {GT}, o AS (SELECT sum(price * mw) / sum(mw) AS overall FROM gen)
SELECT tech, round((sum(revenue) / sum(mw)) / any_value(overall), 6) AS capture FROM gt, o GROUP BY tech""")
def capture_rate(spark, d):
    g = b.generation_by_tech(spark, d)
    overall = b.generation(spark, d).agg((F.sum("revenue") / F.sum("mw")).alias("overall"))
    return g.groupBy("tech").agg((F.sum("revenue") / F.sum("mw")).alias("p")).join(F.broadcast(overall)).select("tech", r(F.col("p") / F.col("overall"), 6).alias("capture"))


@query(f"""WITH {GT}, {UNITS}, o AS (SELECT sum(revenue) / sum(mw) AS overall FROM gen), dd AS (SELECT day, sum(mw) AS dm FROM gen GROUP BY day), p90 AS (SELECT quantile_cont(dm, 0.9) AS q FROM dd),
 g AS (SELECT gt.*, rated_mw, dm >= q AS peak FROM gt JOIN units USING (unit) JOIN dd USING (day), p90),
 x AS (SELECT tech, any_value(renewable) AS renewable, sum(cost) / sum(mw) AS lcoe, sum(revenue) / sum(mw) AS sp, coalesce(avg(CASE WHEN peak THEN least(1, mw / rated_mw) END), 0) AS credit, max(mw) - min(mw) AS ramp, max(rated_mw) AS rated FROM g GROUP BY tech)
SELECT tech, round(lcoe * (1 + (1 - sp / overall) + 0.15 * (0.85 - credit) - 0.1 * CASE WHEN renewable THEN 0 ELSE ramp / rated END), 4) AS vallcoe FROM x, o""")
def vallcoe(spark, d):
    g = b.generation_by_tech(spark, d).join(b.units(spark, d).select("unit", "rated_mw"), "unit")
    daily = b.generation(spark, d).groupBy("day").agg(F.sum("mw").alias("dm"))
    q = daily.agg(F.percentile("dm", F.lit(0.9)).alias("q"))
    peak = daily.join(F.broadcast(q)).select("day", (F.col("dm") >= F.col("q")).alias("peak"))
    overall = b.generation(spark, d).agg((F.sum("revenue") / F.sum("mw")).alias("overall"))
    x = g.join(peak, "day").groupBy("tech").agg(
        F.any_value("renewable").alias("renewable"), (F.sum("cost") / F.sum("mw")).alias("lcoe"), (F.sum("revenue") / F.sum("mw")).alias("sp"),
        F.coalesce(F.avg(F.when(F.col("peak"), F.least(F.lit(1.0), F.col("mw") / F.col("rated_mw")))), F.lit(0.0)).alias("credit"), (F.max("mw") - F.min("mw")).alias("ramp"), F.max("rated_mw").alias("rated"),
    )
    v = m.vallcoe(F.col("lcoe"), F.col("sp") / F.col("overall"), F.col("credit"), F.col("ramp"), F.col("rated"), F.col("renewable"))
    return x.join(F.broadcast(overall)).select("tech", r(v).alias("vallcoe"))


@query(f"""WITH {GEN}, {UNITS}, {DEMAND}, s AS (SELECT node, day, sum(mw) * 3000 AS supply FROM gen JOIN units USING (unit) GROUP BY node, day), q AS (SELECT node, day, sum(mw) AS dm FROM demand GROUP BY node, day),
 j AS (SELECT q.node, q.day, greatest(dm - coalesce(supply, 0), 0) AS u FROM q LEFT JOIN s USING (node, day)), f AS (SELECT *, CAST(u > 1e-6 AS INTEGER) AS s FROM j),
 e AS (SELECT *, CASE WHEN s = 1 AND coalesce(lag(s) OVER (PARTITION BY node ORDER BY day), 0) = 0 THEN 1 ELSE 0 END AS e FROM f)
SELECT node, round(avg(s), 6) AS lolp, round(sum(u) * 24, 2) AS ens, CAST(sum(s) * 24 AS DOUBLE) AS lolh, CAST(sum(e) AS BIGINT) AS lolf, round(max(u), 2) AS peak_unserved FROM e GROUP BY node""")
def reliability_lolp(spark, d):
    s = b.generation(spark, d).join(b.units(spark, d).select("unit", "node"), "unit").groupBy("node", "day").agg((F.sum("mw") * 3000).alias("supply"))
    q = b.demand(spark, d).groupBy("node", "day").agg(F.sum("mw").alias("dm"))
    j = q.join(s, ["node", "day"], "left").withColumn("supply", F.coalesce("supply", F.lit(0.0)))
    out = m.reliability(j, ["node"], "day", "dm", "supply", hours=24.0)
    return out.select("node", r("lolp", 6).alias("lolp"), r("ens", 2).alias("ens"), "lolh", "lolf", r("peak_unserved", 2).alias("peak_unserved"))


@query(f"""WITH {SERIES}, f AS (SELECT entity, ts, event, CAST(value > 100 AS INTEGER) AS s FROM series), e AS (SELECT *, CASE WHEN s = 1 AND coalesce(lag(s) OVER (PARTITION BY entity ORDER BY ts, event), 0) = 0 THEN 1 ELSE 0 END AS e FROM f)
SELECT entity, CAST(sum(e) AS BIGINT) AS events, CAST(sum(s) AS BIGINT) AS steps FROM e GROUP BY entity""")
def lolf_events(spark, d):
    return m.rising_edges(b.series(spark, d), ["entity"], ["ts", "event"], F.col("value") > 100)


@query(f"""WITH {GEN}, {UNITS}, fl AS (SELECT node AS i, CAST((node + part) % 25 AS INTEGER) AS j, mw - 25 AS flow FROM gen JOIN units USING (unit)),
 e AS (SELECT j AS node, greatest(flow, 0) AS a, greatest(-flow, 0) AS o FROM fl UNION ALL SELECT i, greatest(-flow, 0), greatest(flow, 0) FROM fl)
SELECT node, round(sum(a) / 1e3, 6) AS imports, round(sum(o) / 1e3, 6) AS exports FROM e GROUP BY node""")
def imports_exports(spark, d):
    g = b.generation(spark, d).join(b.units(spark, d).select("unit", "node"), "unit")
    flows = g.select(F.col("node").alias("i"), ((F.col("node") + F.col("part")) % 25).cast("int").alias("j"), (F.col("mw") - 25).alias("flow"))
    return m.imports_exports(flows, "i", "j", "flow").select("node", r("imports", 6).alias("imports"), r("exports", 6).alias("exports"))


@query(f"WITH {GEN} SELECT unit, round(sum(mw), 2) AS mwh FROM gen GROUP BY unit ORDER BY sum(mw) DESC, unit LIMIT 10")
def top_units_by_output(spark, d):
    return b.generation(spark, d).groupBy("unit").agg(r(F.sum("mw"), 2).alias("mwh")).orderBy(F.desc("mwh"), "unit").limit(10)


@query(f"""WITH {SERIES} SELECT category, count(value) AS n, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, round(stddev_pop(value), 4) AS std, round(quantile_cont(value, 0.05), 4) AS p05, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95,
 round(stddev_pop(value) / avg(value), 4) AS cv, round(avg(value) / max(value), 4) AS load_factor, round(avg(CASE WHEN isodow(ts) < 6 THEN value END), 4) AS weekday_mean, round(avg(CASE WHEN isodow(ts) >= 6 THEN value END), 4) AS weekend_mean FROM series GROUP BY category""")
def demand_deep_stats(spark, d):
    s = m.deep_stats(b.series(spark, d), ["category"], "value", "ts").drop("peak_hour")
    return s.select("category", "n", r("mean").alias("mean"), "low", "high", *(r(c).alias(c) for c in ("std", "p05", "p50", "p95", "cv", "load_factor", "weekday_mean", "weekend_mean")))


@query(f"""WITH {GEN}, {UNITS}, {NODES} SELECT system, node, unit, round(sum(mw), 2) AS mwh, CAST(grouping(system, node, unit) AS INTEGER) AS level FROM gen JOIN units USING (unit) JOIN nodes USING (node) GROUP BY ROLLUP (system, node, unit)""")
def drill_down_system_node_unit(spark, d):
    g = b.generation(spark, d).select("unit", "mw").join(b.units(spark, d).select("unit", "node"), "unit").join(b.nodes(spark, d).select("node", "system"), "node")
    return g.rollup("system", "node", "unit").agg(r(F.sum("mw"), 2).alias("mwh"), F.grouping_id("system", "node", "unit").cast("int").alias("level"))


@query(f"WITH {GT} SELECT year, " + ", ".join(f"round(sum(CASE WHEN tech = '{x}' THEN mw END), 2) AS {x.lower()}" for x in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM gt GROUP BY year")
def annual_mix_pivot(spark, d):
    names = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    p = b.generation_by_tech(spark, d).groupBy("year").pivot("tech", names).agg(F.sum("mw"))
    return p.select("year", *(r(x, 2).alias(x.lower()) for x in names))


@query(f"WITH {GT}, y AS (SELECT year, tech, sum(mw) AS v FROM gt GROUP BY year, tech) SELECT year, tech, round(v, 2) AS mwh, round(sum(v) OVER (PARTITION BY tech ORDER BY year), 2) AS total FROM y")
def cumulative_investment_by_tech(spark, d):
    y = b.generation_by_tech(spark, d).groupBy("year", "tech").agg(F.sum("mw").alias("v"))
    return t.cumulative(y, ["tech"], ["year"], "v", "total").select("year", "tech", r("v", 2).alias("mwh"), r("total", 2).alias("total"))


@query(f"WITH {GT}, f AS (SELECT tech, count(DISTINCT brand) AS n FROM gt GROUP BY tech) SELECT tech, n AS brands, round(least(1.0, greatest(0.05, 1.0 / n)), 6) AS weight FROM f")
def inverse_zone_weights(spark, d):
    n = b.technologies(spark, d).join(b.generation(spark, d).select("part").distinct(), "part", "left_semi").groupBy("tech").agg(F.count_distinct("brand").alias("brands"))
    return n.select("tech", "brands", r(F.least(F.lit(1.0), F.greatest(F.lit(0.05), 1.0 / F.col("brands"))), 6).alias("weight"))


@query(f"WITH {GT}, a AS (SELECT tech, brand, avg(mw) AS v FROM gt GROUP BY tech, brand) SELECT tech, round(avg(v), 6) AS normaliser FROM a GROUP BY tech")
def mean_of_group_means(spark, d):
    return b.generation_by_tech(spark, d).groupBy("tech", "brand").agg(F.avg("mw").alias("v")).groupBy("tech").agg(r(F.avg("v"), 6).alias("normaliser"))


@query(f"WITH {SERIES} SELECT CAST(floor(entity / 4) AS INTEGER) AS cell_x, CAST(floor(value / 50) AS INTEGER) AS cell_y, count(*) AS n, round(sum(value), 2) AS total FROM series GROUP BY 1, 2")
def raster_aggregate(spark, d):
    return b.series(spark, d).groupBy(F.floor(F.col("entity") / 4).cast("int").alias("cell_x"), F.floor(F.col("value") / 50).cast("int").alias("cell_y")).agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"))


@query(f"""WITH {DEMAND}, q AS (SELECT node, sum(mw) AS mw FROM demand GROUP BY node), sh AS (SELECT c_nationkey AS node, c_mktsegment AS sector, count(*) AS w FROM customer GROUP BY 1, 2), s AS (SELECT *, w / sum(w) OVER (PARTITION BY node) AS s FROM sh)
SELECT node, sector, round(mw * s, 2) AS sector_mw FROM q JOIN s USING (node)""")
def sectoral_demand(spark, d):
    from wattspan.operators.demand import sector_split

    q = b.demand(spark, d).groupBy("node").agg(F.sum("mw").alias("mw"))
    shares = b.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("node"), F.col("c_mktsegment").alias("sector")).agg(F.count("*").alias("w"))
    return sector_split(q, shares, "node", "sector", "w", "mw").select("node", "sector", r("sector_mw", 2).alias("sector_mw"))


@query(f"""WITH {GT}, a AS (SELECT brand, tech, sum(mw) AS v FROM gt GROUP BY brand, tech), s AS (SELECT tech, min(v) AS low, max(v) AS high, quantile_cont(v, 0.5) AS median, avg(v) AS mean, stddev_pop(v) AS std FROM a GROUP BY tech)
SELECT tech, round(low, 2) AS low, round(high, 2) AS high, round(median, 2) AS median, round(mean, 4) AS mean, round(std / mean, 6) AS cv, std / mean <= 0.1 AS robust, low <= 1e-6 AS flexible FROM s""")
def mga_statistics(spark, d):
    from wattspan.operators.planning import mga_statistics as stats

    a = b.generation_by_tech(spark, d).groupBy("brand", "tech").agg(F.sum("mw").alias("v"))
    return stats(a, ["tech"], "v").select("tech", r("low", 2).alias("low"), r("high", 2).alias("high"), r("median", 2).alias("median"), r("mean").alias("mean"), r("cv", 6).alias("cv"), "robust", "flexible")


@query(f"""WITH {GEN}, ranked AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY price, order_key, line) - 1 AS k, count(*) OVER (PARTITION BY unit) AS n FROM gen)
SELECT unit, round(max(CASE WHEN k = CAST(floor(0.05 * n) AS BIGINT) THEN price END), 4) AS var, round(avg(CASE WHEN k <= CAST(floor(0.05 * n) AS BIGINT) THEN price END), 4) AS cvar FROM ranked GROUP BY unit""")
def price_var_cvar(spark, d):
    return m.tail_mean(b.generation(spark, d), ["unit"], "price", 0.05, ["order_key", "line"]).select("unit", r("var").alias("var"), r("cvar").alias("cvar"))


@query(f"""WITH {GEN}, {DEMAND}, g AS (SELECT day, sum(mw) * 3000 AS f FROM gen GROUP BY day), o AS (SELECT day, sum(mw) AS o FROM demand GROUP BY day), j AS (SELECT year(day) AS year, o, f FROM o JOIN g USING (day))
SELECT CAST(year AS INTEGER) AS year, round(avg(abs(f - o)), 2) AS mae, round(sqrt(avg((f - o) * (f - o))), 2) AS rmse, round((max(f) - max(o)) / max(o) * 100, 4) AS peak_error, round((sum(f) - sum(o)) / sum(o) * 100, 4) AS energy_error FROM j GROUP BY year""")
def forecast_metrics(spark, d):
    g = b.generation(spark, d).groupBy("day").agg((F.sum("mw") * 3000).alias("f"))
    o = b.demand(spark, d).groupBy("day").agg(F.sum("mw").alias("o"))
    j = o.join(g, "day").withColumn("year", F.year("day"))
    return m.forecast_metrics(j, ["year"], "o", "f").select("year", r("mae", 2).alias("mae"), r("rmse", 2).alias("rmse"), r("peak_error").alias("peak_error"), r("energy_error").alias("energy_error"))


@query(f"""WITH {GT} SELECT tech, year, round(sum(revenue), 2) AS revenue, round(sum(cost), 2) AS cost, round(sum(revenue - cost), 2) AS margin, round(sum(revenue - cost) / sum(revenue), 6) AS margin_share FROM gt GROUP BY tech, year""")
def profitability_by_tech(spark, d):
    g = b.generation_by_tech(spark, d)
    return g.groupBy("tech", "year").agg(r(F.sum("revenue"), 2).alias("revenue"), r(F.sum("cost"), 2).alias("cost"), r(F.sum(F.col("revenue") - F.col("cost")), 2).alias("margin"), r(F.sum(F.col("revenue") - F.col("cost")) / F.sum("revenue"), 6).alias("margin_share"))


@query(f"""WITH {GT}, {UNITS} SELECT 'fuel:' || tech AS source, 'node:' || node AS target, round(sum(mw), 2) AS mwh FROM gt JOIN units USING (unit) GROUP BY tech, node
UNION ALL SELECT 'node:' || node, 'system', round(sum(mw), 2) FROM gt JOIN units USING (unit) GROUP BY node""")
def sankey_links(spark, d):
    g = b.generation_by_tech(spark, d).join(b.units(spark, d).select("unit", "node"), "unit")
    # The second level adds up the first, so facts are read and shuffled once.
    first = g.groupBy("tech", "node").agg(F.sum("mw").alias("v"))
    a = first.select(F.concat(F.lit("fuel:"), "tech").alias("source"), F.concat(F.lit("node:"), F.col("node").cast("string")).alias("target"), r("v", 2).alias("mwh"))
    s = first.groupBy("node").agg(F.sum("v").alias("v")).select(F.concat(F.lit("node:"), F.col("node").cast("string")).alias("source"), F.lit("system").alias("target"), r("v", 2).alias("mwh"))
    return a.unionByName(s)


@query(f"WITH {GT}, s AS (SELECT year, sum(CASE WHEN renewable THEN mw ELSE 0 END) / sum(mw) AS x, sum(CASE WHEN renewable THEN mw ELSE 0 END) AS re, sum(mw) AS a FROM gt GROUP BY year) SELECT round(max(x), 6) AS peak_share, round(sum(re) / sum(a), 6) AS energy_share, round(avg(x), 6) AS mean_share FROM s")
def re_share_over_years(spark, d):
    s = b.generation_by_tech(spark, d).groupBy("year").agg(F.sum(F.when(F.col("renewable"), F.col("mw")).otherwise(0.0)).alias("re"), F.sum("mw").alias("a"))
    return s.agg(r(F.max(F.col("re") / F.col("a")), 6).alias("peak_share"), r(F.sum("re") / F.sum("a"), 6).alias("energy_share"), r(F.avg(F.col("re") / F.col("a")), 6).alias("mean_share"))


@query(f"""WITH {GT}, s AS (SELECT year, sum(mw) AS mwh, sum(cost) AS cost FROM gt GROUP BY year) SELECT year, round(mwh, 2) AS mwh, round(cost, 2) AS cost, round(cost - first_value(cost) OVER (ORDER BY year), 2) AS change FROM s""")
def kpi_cards(spark, d):
    s = b.generation_by_tech(spark, d).groupBy("year").agg(F.sum("mw").alias("mwh"), F.sum("cost").alias("cost"))
    first = s.agg(F.min_by("cost", "year").alias("first"))
    return s.join(F.broadcast(first)).select("year", r("mwh", 2).alias("mwh"), r("cost", 2).alias("cost"), r(F.col("cost") - F.col("first"), 2).alias("change"))


@query(f"""WITH {GT}, {UNITS} SELECT tech, node, round(stddev_pop(mw), 6) AS spread FROM gt JOIN units USING (unit) GROUP BY tech, node""")
def spatial_spread(spark, d):
    g = b.generation_by_tech(spark, d).join(b.units(spark, d).select("unit", "node"), "unit")
    return g.groupBy("tech", "node").agg(r(F.stddev_pop("mw"), 6).alias("spread"))

