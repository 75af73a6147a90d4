"""Active units, profiles, limits of lines, national demand, inferred capacities, and what a result set can show."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattspan import bindings as b
from wattspan.operators import assets as at
from wattspan.operators import checks as ck
from wattspan.operators.stored import scratch
from wattspan.queries import DEMAND, NODES, SERIES, query, r
from wattspan.queries.planning import OUT
from wattspan.queries.spatial import TREE, tree_edges


@query("SELECT l_partkey AS unit, count(*) AS nodes FROM lineitem GROUP BY 1 HAVING max(l_discount * l_tax * 2) >= 0.01")
def active_units(spark, d):
    """Units with a rating at any node."""
    x = b.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("unit")).agg(F.collect_list(F.col("l_discount") * F.col("l_tax") * 2).alias("rated"))
    return x.where(at.active(F.col("rated"))).select("unit", F.size("rated").cast("long").alias("nodes"))


@query(f"WITH {DEMAND}, q AS (SELECT node, day, sum(mw) AS mw FROM demand WHERE year = 1996 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY day) - 1 AS hour FROM q) SELECT node, CAST(hour AS INTEGER) AS hour, round(mw, 2) AS mw FROM k WHERE hour < 100")
def profile_of_year(spark, d):
    """The first hundred steps of a year."""
    q = b.demand(spark, d).groupBy("node", "day").agg(F.sum("mw").alias("mw"))
    return at.year_profile(q, ["node"], "day", 1996, 100).select("node", "hour", r("mw", 2).alias("mw"))


@query(f"WITH {SERIES}, k AS (SELECT event, value / 100 AS a, CASE event % 4 WHEN 0 THEN 'Solar PV' WHEN 1 THEN 'Onshore Wind' WHEN 2 THEN 'sun' ELSE 'gas' END AS tech FROM series) SELECT event, round(least(1, greatest(0, CASE WHEN tech IN ('Solar PV', 'sun') THEN a * 0.98 * (1 - 0.004 * 1.5) WHEN tech = 'Onshore Wind' THEN a * 1.03 ELSE a END)), 8) AS cf FROM k")
def climate_availability(spark, d):
    """Availability under a changed climate."""
    k = F.col("event") % 4
    tech = F.when(k == 0, "Solar PV").when(k == 1, "Onshore Wind").when(k == 2, "sun").otherwise("gas")
    return b.series(spark, d).select("event", r(at.climate_deltas(F.col("value") / 100, tech, -0.02, 0.03, 1.5), 8).alias("cf"))


@query(f"""WITH {OUT}, f AS (SELECT per.element, t, product((1 - (least("end", t + 24) - greatest(start, t)) / 24.0) + (least("end", t + 24) - greatest(start, t)) / 24.0 * av) AS factor FROM per JOIN ow ON per.element = ow.element AND t < "end" AND t + 24 > start GROUP BY 1, 2),
 x AS (SELECT element AS line, t, abs(s_acctbal) + 1 AS cap, coalesce(factor, 1) AS factor FROM per LEFT JOIN f USING (element, t) JOIN supplier ON s_suppkey = element)
SELECT line, t, round(cap * factor, 6) AS limit_mw, round(greatest(0, 0.7 * cap - cap * factor), 6) AS excess FROM x""")
def line_limits(spark, d):
    """What outages leave of each line's capacity, and what a flow of seven tenths exceeds it by."""
    u = b.units(spark, d).select(F.col("unit").alias("line"), F.col("rated_mw").alias("cap"), (-0.7 * F.col("rated_mw")).alias("flow"))
    per = u.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(720).cast("long"), F.lit(24).cast("long"))))
    x = b.table(spark, d, "lineitem")
    ow = x.select(F.col("l_suppkey").alias("line"), (F.col("l_orderkey") % 700).alias("start"), (F.col("l_orderkey") % 700 + 5 + F.col("l_linenumber") * 7).alias("end"), (F.col("l_discount") * 5).alias("availability"))
    return at.line_limits(per, ow, "line", "t", "flow", "cap", 24, 48).select("line", "t", r("limit", 6).alias("limit_mw"), r("excess", 6).alias("excess"))


_Y = "v AS (SELECT l_orderkey, l_linenumber, (1 + l_discount) / (1 + l_linenumber % 2 * 0.05) AS v1, 1 + l_tax AS v2, (l_quantity - 25) / 100 AS th, 0.01 + l_discount / 10 AS r, 0.05 + l_tax AS x, l_discount / 5 AS c FROM lineitem), y AS (SELECT *, r / (r * r + x * x) AS g, -x / (r * r + x * x) AS b FROM v)"


@query(f"""WITH {_Y} SELECT l_orderkey AS "order", l_linenumber AS line, round(v1 * v1 * g - v1 * v2 * (g * cos(th) + b * sin(th)), 8) AS p_from, round(-v1 * v1 * (b + c / 2) + v1 * v2 * (b * cos(th) - g * sin(th)), 8) AS q_from,
 round(v2 * v2 * g - v1 * v2 * (g * cos(th) - b * sin(th)), 8) AS p_to, round(-v2 * v2 * (b + c / 2) + v1 * v2 * (b * cos(th) + g * sin(th)), 8) AS q_to FROM y""")
def ac_line_flows(spark, d):
    """Power into both ends of lines from voltages and angles."""
    x = b.table(spark, d, "lineitem")
    flows = at.line_flows(1 + F.col("l_discount"), 1 + F.col("l_tax"), (F.col("l_quantity") - 25) / 100, 0.01 + F.col("l_discount") / 10, 0.05 + F.col("l_tax"), F.col("l_discount") / 5, 1 + F.col("l_linenumber") % 2 * 0.05)
    return x.select(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), *[r(c, 8).alias(n) for n, c in flows.items()])


@query(f"""WITH {DEMAND}, {NODES}, c AS (SELECT c_nationkey AS node, count(*) * 1000.0 AS people, avg(c_acctbal) AS gdp FROM customer GROUP BY 1), w AS (SELECT node, sum(mw) AS mw FROM demand GROUP BY node),
 k AS (SELECT node, system, people, gdp, CASE WHEN node % 5 = 0 THEN 120.0 ELSE 0 END AS given, CASE WHEN node % 5 IN (1, 2) THEN 900.0 + node ELSE 0 END AS kwh, CASE WHEN node % 5 = 1 THEN 80.0 ELSE 0 END AS access FROM nodes JOIN c USING (node)),
 g AS (SELECT *, CASE WHEN given > 0 THEN given WHEN kwh > 0 THEN kwh * people * CASE WHEN access > 0 THEN access / 100 ELSE 1 END / 1e6 ELSE gdp * people * 0.15 / 1e6 END AS gwh, CASE WHEN given > 0 THEN 'given' WHEN kwh > 0 THEN 'use' ELSE 'product' END AS source FROM k)
SELECT node, source, round(gwh, 6) AS gwh, round(gwh * 1000 * mw / sum(mw) OVER (PARTITION BY system), 4) AS mwh FROM g JOIN w USING (node)""")
def national_demand(spark, d):
    """Yearly demand of each country from what is known of it, and its share by the weights of its system."""
    from pyspark.sql import Window

    c = b.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("node")).agg((F.count("*") * 1000.0).alias("people"), F.avg("c_acctbal").alias("gdp"))
    w = b.demand(spark, d).groupBy("node").agg(F.sum("mw").alias("mw"))
    five = F.col("node") % 5
    given, kwh = F.when(five == 0, 120.0).otherwise(0.0), F.when(five.isin(1, 2), 900.0 + F.col("node")).otherwise(0.0)
    gwh, source = at.national_gwh(given, kwh, F.col("people"), F.when(five == 1, 80.0).otherwise(0.0), F.col("gdp"), 0.15)
    x = b.nodes(spark, d).join(c, "node").join(w, "node").withColumn("gwh", gwh).withColumn("source", source)
    share = F.col("mw") / F.sum("mw").over(Window.partitionBy("system"))
    return x.select("node", "source", r("gwh", 6).alias("gwh"), r(F.col("gwh") * 1000 * share).alias("mwh"))


_SURGE = "CASE " + " ".join(f"WHEN kv >= {kv} THEN {mw}" for kv, mw in at.SURGE if kv > 0) + f" ELSE {at.SURGE[-1][1]} END"


@query(f"""WITH RECURSIVE {TREE}, arc AS (SELECT a AS u, b AS v, a, b FROM e UNION ALL SELECT b, a, a, b FROM e), reach AS (
 SELECT a, b, a AS node FROM e UNION SELECT reach.a, reach.b, arc.v FROM reach JOIN arc ON arc.u = reach.node AND NOT (arc.a = reach.a AND arc.b = reach.b)
), side AS (SELECT a, b, max(CASE WHEN node = b THEN 1 ELSE 0 END) AS back, sum(s_acctbal) / 20 AS mw FROM reach JOIN supplier ON s_suppkey = node GROUP BY 1, 2),
 f AS (SELECT a, b, CASE WHEN back = 0 THEN abs(mw) ELSE 0 END AS flow, CASE (a + b) % 4 WHEN 0 THEN 0 WHEN 1 THEN 66 WHEN 2 THEN 220 ELSE 500 END AS kv, CASE (a + b) % 3 WHEN 0 THEN 0 ELSE 40.0 * (a % 9) END AS cap FROM side),
 n AS (SELECT *, greatest(5, least(flow * 1.25, 5000 * 1.25, CASE WHEN kv <= 0 THEN 1e300 ELSE {_SURGE} END)) AS needed FROM f)
SELECT a, b, round(CASE WHEN cap <= 0 OR cap < needed THEN needed ELSE cap END, 6) AS capacity, CASE WHEN cap <= 0 THEN 'inferred' WHEN cap < needed THEN 'raised' ELSE 'given' END AS set_by FROM n""")
def inferred_capacities(spark, d):
    """Capacities of lines that have none, or less than must flow over them."""
    ab = F.col("a") + F.col("b")
    kv = F.when(ab % 4 == 0, 0.0).when(ab % 4 == 1, 66.0).when(ab % 4 == 2, 220.0).otherwise(500.0)
    lines = tree_edges(spark, d).withColumn("kv", kv).withColumn("capacity", F.when(ab % 3 == 0, 0.0).otherwise(40.0 * (F.col("a") % 9)))
    inj = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_acctbal") / 20).alias("mw"))
    return at.inferred_capacities(lines, inj, 5000.0).select("a", "b", r("capacity", 6).alias("capacity"), "set_by")


@query(f"""WITH {SERIES}, p AS (SELECT category, CAST(hour % 24 AS INTEGER) AS hour, avg(value) / 60 AS v FROM series GROUP BY 1, 2), u AS (SELECT p_partkey AS unit, CASE p_partkey % 6 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'none such' ELSE 'view' END AS profile FROM part),
 g AS (SELECT DISTINCT hour FROM p), k AS (SELECT unit, g.hour, v, category, EXISTS (SELECT 1 FROM p q WHERE q.category = profile) AS known FROM u CROSS JOIN g LEFT JOIN p ON p.category = profile AND p.hour = g.hour)
SELECT unit, count(*) AS n, round(sum(least(1, greatest(0, CASE WHEN known THEN v ELSE 1 END))), 6) AS share, round(sum(CASE WHEN known THEN v ELSE 0 END), 6) AS inflow FROM k WHERE NOT known OR v IS NOT NULL GROUP BY unit""")
def profiles_of_units(spark, d):
    """Availability (within 0 and 1) and inflow (as it is) of many units from few stored profiles."""
    path = scratch(spark, "profiles")
    s = b.series(spark, d).groupBy(F.col("category").alias("profile"), (F.col("hour") % 24).alias("hour")).agg((F.avg("value") / 60).alias("v"))
    s.write.partitionBy("profile").parquet(path)
    stored = spark.read.schema("hour int, v double, profile string").parquet(path)
    k = F.col("unit") % 6
    u = b.table(spark, d, "part").select(F.col("p_partkey").alias("unit")).withColumn("profile", F.when(k == 0, "click").when(k == 1, "error").when(k == 2, "purchase").when(k == 3, "none such").otherwise("view"))
    share = at.unit_profiles(u, stored, "unit", "profile", "v").groupBy("unit").agg(F.count("*").alias("n"), r(F.sum("v"), 6).alias("share"))
    inflow = at.unit_profiles(u, stored, "unit", "profile", "v", clip=False).groupBy("unit").agg(r(F.sum("v"), 6).alias("inflow"))
    return share.join(inflow, "unit")


META = f"""{NODES}, m AS (SELECT system AS run, 'attribute' AS kind, 'num_nodes' AS name, CAST(count(*) AS VARCHAR) AS value FROM nodes GROUP BY system
 UNION ALL SELECT system, 'attribute', 'simulation_mode', CASE system % 3 WHEN 0 THEN ' Development' WHEN 1 THEN 'economic_dispatch' ELSE 'other' END FROM nodes
 UNION ALL SELECT system, 'attribute', 'num_alternatives', CAST(system AS VARCHAR) FROM nodes
 UNION ALL SELECT system, 'scenario', CAST(year(l_shipdate) AS VARCHAR), '' FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nodes ON s_nationkey = node
 UNION ALL SELECT system, 'table', CASE s_suppkey % 4 WHEN 0 THEN 'generation' WHEN 1 THEN 'power_flow' WHEN 2 THEN 'heat' ELSE 'transport' END, '' FROM supplier JOIN nodes ON s_nationkey = node
 UNION ALL SELECT system, 'attribute', 'investment_' || s_suppkey, '1' FROM supplier JOIN nodes ON s_nationkey = node WHERE s_acctbal > 5000)"""


def metadata(spark, d):
    n = b.nodes(spark, d)
    row = lambda df, kind, name, value: df.select(F.col("system").alias("run"), F.lit(kind).alias("kind"), name.alias("name"), value.cast("string").alias("value"))
    s = b.units(spark, d).join(n, "node")
    three, four = F.col("system") % 3, F.col("unit") % 4
    raw = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), "s_acctbal")
    parts = [
        row(n.groupBy("system").agg(F.count("*").alias("k")), "attribute", F.lit("num_nodes"), F.col("k")),
        row(n, "attribute", F.lit("simulation_mode"), F.when(three == 0, " Development").when(three == 1, "economic_dispatch").otherwise("other")),
        row(n, "attribute", F.lit("num_alternatives"), F.col("system")),
        row(b.generation(spark, d).join(s, "unit"), "scenario", F.col("year").cast("string"), F.lit("")),
        row(s, "table", F.when(four == 0, "generation").when(four == 1, "power_flow").when(four == 2, "heat").otherwise("transport"), F.lit("")),
        row(s.join(raw, "unit").where("s_acctbal > 5000"), "attribute", F.concat(F.lit("investment_"), F.col("unit")), F.lit("1")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {META} SELECT DISTINCT run, CASE WHEN name = 'num_nodes' THEN 'multi_node' WHEN name = 'num_alternatives' THEN 'mga' WHEN name = 'simulation_mode' THEN 'mode_' || lower(trim(value)) WHEN kind = 'scenario' THEN 'detailed_results' WHEN kind = 'table' THEN name ELSE 'investment' END AS tag FROM m
WHERE (name = 'num_nodes' AND CAST(value AS INTEGER) > 1) OR (name = 'num_alternatives' AND CAST(value AS INTEGER) >= 2) OR (name = 'simulation_mode' AND value <> 'other') OR kind = 'scenario' OR name = 'power_flow' OR starts_with(name, 'investment_')""")
def result_capabilities(spark, d):
    """What each system's results can show."""
    return at.capabilities(metadata(spark, d), "run")


@query(f"WITH {META} SELECT run, name, count(*) AS n FROM m WHERE kind = 'table' AND name NOT IN ('generation', 'power_flow') GROUP BY 1, 2")
def result_catalogue(spark, d):
    """Tables of each system's results beside the usual ones."""
    return at.catalogue(metadata(spark, d), "run")


# Rules that a dispatch or a plan must keep, over given results.


@query("""WITH s AS (SELECT o_custkey % 25 AS node, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS sector, o_totalprice AS d, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 1.1 ELSE o_totalprice / 10 END AS mw FROM orders), a AS (SELECT node, year, sum(mw) AS own, sum(greatest(0, mw - d)) AS beyond FROM s GROUP BY 1, 2), t AS (SELECT node, year, sum(d) / 10 AS total FROM s GROUP BY 1, 2)
SELECT CAST(node AS INTEGER) AS node, year, round(own - total, 3) AS residual, round(beyond, 3) AS beyond FROM a JOIN t USING (node, year)""")
def sector_shedding(spark, d):
    """What sectors shed against what is shed in all."""
    o = b.table(spark, d, "orders").select((F.col("o_custkey") % 25).cast("int").alias("node"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("demand"), (F.col("o_orderkey") % 10 == 0).alias("more"))
    own = o.withColumn("mw", F.when(F.col("more"), F.col("demand") * 1.1).otherwise(F.col("demand") / 10))
    total = o.select("node", "year", (F.col("demand") / 10).alias("mw"))
    return ck.sector_residuals(total, own, ["node", "year"], "mw", "demand").select("node", "year", r("residual", 3).alias("residual"), r("beyond", 3).alias("beyond"))


@query("""WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS sector, o_totalprice AS mw, o_orderkey FROM orders), d AS (SELECT year, sector, sum(mw) AS d, max(CASE sector[1] WHEN '1' THEN 0.95 WHEN '2' THEN 0.8 ELSE 0.3 END) AS c FROM o GROUP BY 1, 2), s AS (SELECT year, sector, sum(mw * (o_orderkey % 3) / 5) AS out FROM o GROUP BY 1, 2)
SELECT year, sector, round(out - (1 - c) * d, 2) AS excess FROM s JOIN d USING (year, sector) WHERE out - (1 - c) * d > 1e-9""")
def demand_shift_excess(spark, d):
    """Sectors that shift more than what is not critical."""
    first = F.substring("o_orderpriority", 1, 1)
    o = b.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("sector"), F.col("o_totalprice").alias("mw"), "o_orderkey", F.when(first == "1", 0.95).when(first == "2", 0.8).otherwise(0.3).alias("crit"))
    return ck.shift_excess(o.withColumn("mw", F.col("mw") * (F.col("o_orderkey") % 3) / 5), o, ["year"], "sector", "mw", "crit").select("year", "sector", r("excess", 2).alias("excess"))


@query("""WITH g AS (SELECT l_suppkey AS plant, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) * 3 AS mwh, sum(l_quantity * (1 - l_discount * 4)) AS tons FROM lineitem GROUP BY 1, 2), p AS (SELECT plant, year, mwh - tons * (2.5 + plant % 5 / 4.0) AS shortfall FROM g WHERE plant % 7 > 0)
SELECT plant, year, round(shortfall, 4) AS shortfall FROM p WHERE shortfall > 1e-6""")
def fuel_shortfall(spark, d):
    """Energy beyond what the fuel that a plant burns gives; every seventh plant burns none."""
    x = b.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("plant"), F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("mw"), (F.col("l_quantity") * (1 - F.col("l_discount") * 4)).alias("tons"))
    plants = b.units(spark, d).select(F.col("unit").alias("plant"), F.when(F.col("unit") % 7 == 0, 0.0).otherwise(2.5 + F.col("unit") % 5 / 4.0).alias("rate"))
    return ck.fuel_shortfall(x, x, plants, ["year"], "plant", "mw", "tons", "rate", 3.0).select("plant", "year", r("shortfall", 4).alias("shortfall"))


@query("""WITH l AS (SELECT c_nationkey * 100 + o_orderkey % 25 AS link, min(c_nationkey) AS s, min(o_orderkey % 25) AS e, 300000.0 + 100 * min(c_nationkey) AS most FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> o_orderkey % 25 GROUP BY 1),
 i AS (SELECT c_nationkey * 100 + o_orderkey % 25 AS link, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) / 10 AS mw FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> o_orderkey % 25 GROUP BY 1, 2), t AS (SELECT link, sum(mw) AS t FROM i GROUP BY 1),
 p AS (SELECT a.link AS link, b.link AS back FROM l a JOIN l b ON a.s = b.e AND a.e = b.s AND a.link < b.link), y AS (SELECT DISTINCT year FROM i)
SELECT CAST(link AS BIGINT) AS link, 'limit' AS rule, CAST(NULL AS INTEGER) AS year, round(t - most, 3) AS amount FROM t JOIN l USING (link) WHERE t > most + 1e-9
UNION ALL SELECT CAST(p.link AS BIGINT), 'symmetry', y.year, round(coalesce(m.mw, 0) - coalesce(o.mw, 0), 3) FROM p CROSS JOIN y LEFT JOIN i m ON m.link = p.link AND m.year = y.year LEFT JOIN i o ON o.link = p.back AND o.year = y.year WHERE abs(coalesce(m.mw, 0) - coalesce(o.mw, 0)) > 1e-9""")
def link_findings(spark, d):
    """Links between systems beyond their limit, or built unlike their opposites."""
    o = b.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 25).alias("e"), F.year("o_orderdate").alias("year"), (F.col("o_totalprice") / 10).alias("mw"))
    x = o.join(b.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("s")), "c_custkey").where("s <> e").withColumn("link", (F.col("s") * 100 + F.col("e")).cast("long"))
    links = x.select("link", "s", "e", (300000.0 + 100 * F.col("s")).alias("most")).distinct()
    invested = x.groupBy("link", "year").agg(F.sum("mw").alias("mw"))
    return ck.link_findings(links, invested, "link", "s", "e", "most", "year", "mw").select("link", "rule", "year", r("amount", 3).alias("amount"))
