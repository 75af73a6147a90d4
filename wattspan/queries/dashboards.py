"""Chart and dashboard payloads as rows, and checks of dispatch results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattspan import bindings as b
from wattspan.operators import checks as ck
from wattspan.operators import features as ft
from wattspan.operators.quantiles import with_quantiles
from wattspan.queries import DEMAND, GEN, GT, NODES, SERIES, UNITS, query, r
from wattspan.queries.planning import DISPATCH_SQL, LINES, dispatched, lines


@query(f"WITH {GT} SELECT tech, CAST(year(day) * 12 + month(day) AS INTEGER) AS period, round(sum(mw), 2) AS mwh FROM gt GROUP BY 1, 2")
def generation_mix_monthly(spark, d):
    return b.generation_by_tech(spark, d).groupBy("tech", (F.year("day") * 12 + F.month("day")).alias("period")).agg(r(F.sum("mw"), 2).alias("mwh"))


@query(f"WITH {SERIES} SELECT CAST(dayofweek(ts) AS INTEGER) AS weekday, " + ", ".join(f"round(sum(CASE WHEN hour(ts) = {h} THEN CASE WHEN category = 'purchase' THEN value ELSE -value END END), 2) AS h{h}" for h in range(0, 24, 6)) + " FROM series GROUP BY 1")
def storage_net_heatmap(spark, d):
    s = b.series(spark, d).withColumn("net", F.when(F.col("category") == "purchase", F.col("value")).otherwise(-F.col("value")))
    p = s.withColumn("h", F.hour("ts")).groupBy((F.dayofweek("ts") - 1).alias("weekday")).pivot("h", list(range(0, 24, 6)))
    return p.agg(F.sum("net")).select("weekday", *(r(str(h), 2).alias(f"h{h}") for h in range(0, 24, 6)))


@query(f"WITH {GT} SELECT tech, year, round(avg(CASE WHEN mw > 0 THEN cost / mw END), 4) AS lcoe, round(quantile_cont(cost / mw, 0.05), 4) AS p05, round(quantile_cont(cost / mw, 0.95), 4) AS p95 FROM gt GROUP BY 1, 2")
def lcoe_distribution(spark, d):
    g = b.generation_by_tech(spark, d).withColumn("c", F.col("cost") / F.col("mw"))
    return g.groupBy("tech", "year").agg(r(F.avg(F.when(F.col("mw") > 0, F.col("c")))).alias("lcoe"), r(F.percentile("c", F.lit(0.05))).alias("p05"), r(F.percentile("c", F.lit(0.95))).alias("p95"))


@query(f"WITH {GEN}, {UNITS}, p AS (SELECT day, node, avg(price) AS price FROM gen JOIN units USING (unit) GROUP BY day, node) SELECT day, round(avg(price), 9) AS mean, round(min(price), 9) AS low, round(max(price), 9) AS high FROM p GROUP BY day")
def price_band(spark, d):
    p = b.generation(spark, d).join(b.units(spark, d).select("unit", "node"), "unit").groupBy("day", "node").agg(F.avg("price").alias("price"))
    return p.groupBy("day").agg(r(F.avg("price"), 9).alias("mean"), r(F.min("price"), 9).alias("low"), r(F.max("price"), 9).alias("high"))


@query(f"WITH {DISPATCH_SQL} SELECT node, unit FROM disp GROUP BY node, unit HAVING max(CAST(dispatch > cap / 2 AS INTEGER)) > 0.5 AND min(CAST(dispatch > cap / 2 AS INTEGER)) < 0.5")
def cycling_units(spark, d):
    on = (F.col("dispatch") > F.col("cap") / 2).cast("int")
    return dispatched(spark, d, by_unit=True).groupBy("node", "unit").agg(F.max(on).alias("hi"), F.min(on).alias("lo")).where("hi > 0.5 AND lo < 0.5").select("node", "unit")


@query(f"WITH {DISPATCH_SQL}, s AS (SELECT node, day, greatest(0, max(load) - sum(dispatch)) AS shed FROM disp GROUP BY node, day) SELECT node, day, round(sum(shed) OVER (PARTITION BY node ORDER BY day ROWS UNBOUNDED PRECEDING), 4) AS cumulative FROM s")
def shed_timeline(spark, d):
    from wattspan.operators.dispatch import load_shed
    from wattspan.operators.temporal import cumulative

    return cumulative(load_shed(dispatched(spark, d), ["node", "day"], "load"), ["node"], ["day"], "shed").select("node", "day", r("cumulative").alias("cumulative"))


@query(f"WITH {DISPATCH_SQL}, x AS (SELECT node, day, unit, dispatch - lag(dispatch) OVER (PARTITION BY node, unit ORDER BY day) AS change FROM disp) SELECT node, day, unit, round(change, 4) AS change FROM x WHERE abs(change) > 1000 + 1e-9")
def ramp_violations(spark, d):
    x = dispatched(spark, d, by_unit=True).withColumn("limit", F.lit(1000.0))
    return ck.ramp_violations(x, ["node", "unit"], "day", "dispatch", "limit").select("node", "day", "unit", r("change").alias("change"))


@query(f"""WITH {DISPATCH_SQL}, x AS (SELECT node, unit, day, CAST(dispatch > cap / 2 AS INTEGER) AS s FROM disp), f AS (SELECT *, CASE WHEN coalesce(lag(s) OVER w, -1) <> s THEN 1 ELSE 0 END AS nw FROM x WINDOW w AS (PARTITION BY node, unit ORDER BY day)),
 g AS (SELECT *, sum(nw) OVER (PARTITION BY node, unit ORDER BY day ROWS UNBOUNDED PRECEDING) AS g FROM f), sp AS (SELECT node, unit, g, any_value(s) AS state, min(day) AS start, count(*) AS length FROM g GROUP BY node, unit, g), e AS (SELECT *, g = 1 OR g = max(g) OVER (PARTITION BY node, unit) AS edge FROM sp)
SELECT node, unit, state, start, length FROM e WHERE NOT edge AND length < 3""")
def commitment_violations(spark, d):
    v = ck.commitment_violations(dispatched(spark, d, by_unit=True), ["node", "unit"], "day", F.col("dispatch") > F.col("cap") / 2, 3, 3)
    return v.select("node", "unit", "state", "start", "length")


@query(f"WITH {GT}, {UNITS}, {DEMAND}, m AS (SELECT node, year, sum(CASE WHEN renewable THEN mw ELSE 0 END) * 1000 AS re FROM gt JOIN units USING (unit) GROUP BY 1, 2), q AS (SELECT node, year, sum(mw) * 0.3 AS target FROM demand GROUP BY 1, 2) SELECT q.node, q.year, round(target, 4) AS target, round(coalesce(re, 0), 2) AS renewable, round(greatest(0, target - coalesce(re, 0)), 4) AS slack FROM q LEFT JOIN m USING (node, year)")
def re_target_slack(spark, d):
    g = b.generation_by_tech(spark, d).join(b.units(spark, d).select("unit", "node"), "unit").withColumn("mw", F.col("mw") * 1000)
    x = ck.re_target_slack(g, ["node", "year"], F.col("renewable"), "mw", b.demand(spark, d), "mw", 0.3)
    return x.select("node", "year", r("target").alias("target"), r("renewable", 2).alias("renewable"), r("slack").alias("slack"))


@query(f"WITH {GT}, x AS (SELECT year, sum(mw * CASE tech WHEN 'LARGE' THEN 0.9 WHEN 'PROMO' THEN 0.4 WHEN 'STANDARD' THEN 0.6 ELSE 0 END) AS t FROM gt GROUP BY year) SELECT year, round(t, 3) AS t_co2, round(greatest(0, t - 5000), 3) AS excess FROM x")
def co2_budget(spark, d):
    f = F.create_map(*(F.lit(x) for p in b.CO2_FACTOR.items() for x in p))
    g = b.generation_by_tech(spark, d).withColumn("t", F.col("mw") * F.coalesce(F.try_element_at(f, F.col("tech")), F.lit(0.0)))
    return ck.co2_excess(g, ["year"], "t", 5000.0).select("year", r("t_co2", 3).alias("t_co2"), r("excess", 3).alias("excess"))


@query(f"WITH {GT}, {UNITS} SELECT node, round(sum(CASE WHEN renewable THEN greatest(0, rated_mw / 100 - mw) ELSE 0 END), 4) AS curtailed, round(sum(CASE WHEN renewable THEN rated_mw / 100 ELSE 0 END), 4) AS available FROM gt JOIN units USING (unit) GROUP BY node")
def curtailment(spark, d):
    g = b.generation_by_tech(spark, d).join(b.units(spark, d).select("unit", "node", "rated_mw"), "unit")
    x = ck.curtailment(g, ["node"], F.col("rated_mw") / 100, "mw", F.col("renewable"))
    return x.select("node", r("curtailed").alias("curtailed"), r("available").alias("available"))


@query(f"WITH {LINES}, e AS (SELECT a AS i, a AS j, r / (r * r + x * x) AS g, -x / (r * r + x * x) AS b FROM ln UNION ALL SELECT b, b, r / (r * r + x * x), -x / (r * r + x * x) FROM ln UNION ALL SELECT a, b, -r / (r * r + x * x), x / (r * r + x * x) FROM ln UNION ALL SELECT b, a, -r / (r * r + x * x), x / (r * r + x * x) FROM ln) SELECT i, j, round(sum(g), 4) AS g, round(sum(b), 4) AS b FROM e GROUP BY i, j")
def admittance_matrix(spark, d):
    x = lines(spark, d).withColumn("c", F.lit(0.0))
    return ck.admittance(x, "a", "b", "r", "x", "c").select("i", "j", r("g").alias("g"), r("b").alias("b"))


@query(f"WITH {LINES}, e AS (SELECT a AS node, cap - 30 AS f FROM ln UNION ALL SELECT b, 30 - cap FROM ln) SELECT node, round(sum(f), 4) AS net_out FROM e GROUP BY node")
def nodal_net_flow(spark, d):
    x = lines(spark, d).withColumn("line", F.lit(0)).withColumn("f", F.col("cap") - 30)
    return ck.nodal_balance(x, "line", "a", "b", "f", []).withColumn("net_out", r("net_out"))


@query("WITH n AS (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name, p_partkey FROM part) SELECT name, CAST(count(*) AS INTEGER) AS n, min(p_partkey) AS first FROM n WHERE name <> '' GROUP BY name HAVING count(*) > 1")
def duplicate_plants(spark, d):
    x = ft.duplicate_names(b.table(spark, d, "part"), "p_partkey", "p_name")
    return x.select("name", F.size("ids").alias("n"), F.element_at("ids", 1).alias("first"))


@query("SELECT 'unit_without_capacity' AS rule, 'warning' AS severity, CAST(s_suppkey AS VARCHAR) AS element FROM supplier WHERE abs(s_acctbal) + 1 <= 0 UNION ALL SELECT 'isolated_node', 'warning', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) AND n_nationkey NOT IN (SELECT c_nationkey FROM customer) UNION ALL SELECT 'self_loop', 'error', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = c_custkey % 25")
def network_issues(spark, d):
    nodes = b.nodes(spark, d).select("node")
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("line"), F.col("c_nationkey").alias("a"), (F.col("c_custkey") % 25).cast("int").alias("b"))
    s = b.units(spark, d)
    both = c.unionByName(s.select((-F.col("unit") - 1).alias("line"), F.col("node").alias("a"), ((F.col("node") + 1) % 25).alias("b")))
    found = [x for x in ft.network_rules(nodes, both, s) if x[0] in ("self_loop", "unit_without_capacity")]
    alone = nodes.join(c.select(F.col("a").alias("node")).unionByName(s.select("node")), "node", "left_anti").select(F.col("node").alias("element"))
    return ft.issues([*found, ("isolated_node", "warning", alone)])


@query(f"WITH {UNITS}, {NODES}, {GEN} SELECT node, count(DISTINCT unit) AS units, round(sum(DISTINCT rated_mw), 2) AS capacity FROM units GROUP BY node")
def installed_capacity(spark, d):
    return b.units(spark, d).groupBy("node").agg(F.count_distinct("unit").alias("units"), r(F.sum_distinct("rated_mw"), 2).alias("capacity"))


@query(f"WITH {SERIES}, x AS (SELECT category, hour, sum(value) AS v FROM series GROUP BY 1, 2), q AS (SELECT category, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.5) AS p50 FROM x GROUP BY 1) SELECT x.category, CASE WHEN v >= p95 THEN 'scarcity' WHEN v >= p50 THEN 'normal' ELSE 'low' END AS regime, count(*) AS n, round(avg(v), 4) AS mean FROM x JOIN q USING (category) GROUP BY 1, 2")
def price_regimes(spark, d):
    x = b.series(spark, d).groupBy("category", "hour").agg(F.sum("value").alias("v"))
    q = with_quantiles(x, ["category"], "v", [0.95, 0.5], ["p95", "p50"])
    regime = F.when(F.col("v") >= F.col("p95"), "scarcity").when(F.col("v") >= F.col("p50"), "normal").otherwise("low")
    return q.groupBy("category", regime.alias("regime")).agg(F.count("*").alias("n"), r(F.avg("v")).alias("mean"))


@query(f"WITH {GT}, y AS (SELECT year, tech, sum(mw) AS v FROM gt GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY v DESC, tech) AS rk FROM y) SELECT year, tech, round(v, 2) AS mwh, CAST(rk AS INTEGER) AS rank, round(v / sum(v) OVER (PARTITION BY year), 6) AS share FROM k")
def technology_ranking(spark, d):
    y = b.generation_by_tech(spark, d).groupBy("year", "tech").agg(F.sum("mw").alias("v"))
    rank = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("v"), "tech"))
    return y.select("year", "tech", r("v", 2).alias("mwh"), rank.alias("rank"), r(F.col("v") / F.sum("v").over(Window.partitionBy("year")), 6).alias("share"))
