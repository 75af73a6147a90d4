"""Files and streams, plugins and programs, and single operators that other queries do not reach."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattspan import bindings as b
from wattspan.functions import finance as fin
from wattspan.functions import scalar as sc
from wattspan.operators import checks as ck
from wattspan.operators import demand as dem
from wattspan.operators import estimation as est
from wattspan.operators import features as ft
from wattspan.operators import joins as jn
from wattspan.operators import network as net
from wattspan.operators import planning as pl
from wattspan.operators import powerflow as pf
from wattspan.operators import security as se
from wattspan.operators import temporal as t
from wattspan.operators.stored import scratch
from wattspan.plans.engine import Engine, Plugin
from wattspan.queries import DEMAND, GEN, GT, NODES, SERIES, UNITS, query, r
from wattspan.queries.planning import HAV, LINES, MERGED, PTS, merged, points
from wattspan.sources import config, lp_text
from wattspan.sources import tabular as tab
from wattspan.streaming import incremental as inc

HOURLY = f"{SERIES}, h AS (SELECT category, hour, sum(value) AS v FROM series GROUP BY category, hour)"


def hourly(spark, d):
    return b.series(spark, d).groupBy("category", "hour").agg(F.sum("value").alias("v"))


# Files.


@query(f"WITH {HOURLY} SELECT category, CAST(DATE '2024-01-01' + CAST(hour // 24 AS INTEGER) AS DATE) AS day, round(sum(v), 4) AS v FROM h GROUP BY 1, 2")
def stamped_demand(spark, d):
    """Hours of a matrix as times from its start."""
    x = tab.with_timestamps(hourly(spark, d), "hour", "01/01/2024 00:00", 2024)
    return x.groupBy("category", F.to_date("ts").alias("day")).agg(r(F.sum("v")).alias("v"))


@query(f"WITH {HOURLY}, y AS (SELECT category, hour + 500 * k AS hour, v FROM h, range(0, 3) x(k) WHERE hour < 500) SELECT category, CAST(hour // 500 AS INTEGER) AS year, count(*) AS n, round(sum(v), 4) AS v FROM y GROUP BY 1, 2")
def tiled_years(spark, d):
    """A short series repeated over a longer horizon."""
    x = tab.tile_years(hourly(spark, d), "hour", 720, 3, 500)
    return x.groupBy("category", F.floor(F.col("hour") / 500).cast("int").alias("year")).agg(F.count("*").alias("n"), r(F.sum("v")).alias("v"))


@query(f"WITH {GEN} SELECT unit, count(*) AS n, round(sum(mw), 2) AS mw FROM gen WHERE year = (SELECT min(year) FROM gen) GROUP BY unit")
def first_year_of_dataset(spark, d):
    """A dataset written by year, of which the first year and one column are read."""
    g = b.generation(spark, d).select("unit", "year", "mw", "price")
    path = scratch(spark, "by-year")
    tab.write_by(g, path, "year")
    first = g.agg(F.min("year")).first()[0]
    return tab.read_year(spark, path, first).groupBy("unit").agg(F.count("*").alias("n"), r(F.sum("mw"), 2).alias("mw"))


@query(f"WITH {DEMAND}, {NODES}, x AS (SELECT node_name, year, 'zone ' || system AS zone, mw FROM demand JOIN nodes USING (node)) SELECT zone, count(*) AS n, round(sum(mw), 2) AS mw FROM x WHERE node_name = 'NATION_3' AND year = 1997 GROUP BY zone")
def country_year(spark, d):
    """One country and year of a dataset by country, year and zone."""
    x = b.demand(spark, d).join(b.nodes(spark, d), "node").select(F.col("node_name").alias("iso3"), "year", F.concat(F.lit("zone "), "system").alias("zone"), "mw")
    path = scratch(spark, "zones")
    tab.write_by(x, path, "iso3", "year", "zone")
    return tab.read_zone(spark, path, "NATION_3", 1997).groupBy("zone").agg(F.count("*").alias("n"), r(F.sum("mw"), 2).alias("mw"))


@query(f"WITH {GT}, x AS (SELECT tech, year, sum(cost) AS cost FROM gt GROUP BY 1, 2) SELECT kind, tech, year, round(cost, 2) AS cost FROM x, (VALUES ('csv'), ('json')) k(kind)")
def exported_costs(spark, d):
    """Yearly costs exported as CSV and as JSON, and read again."""
    x = b.generation_by_tech(spark, d).groupBy("tech", "year").agg(r(F.sum("cost"), 2).alias("cost"))
    csv, json = scratch(spark, "csv"), scratch(spark, "json")
    tab.export_csv(x, csv, ["year"])
    tab.export_json(x, json)
    schema = "tech string, cost double, year int"
    back = spark.read.schema(schema).option("header", True).csv(csv).withColumn("kind", F.lit("csv")).unionByName(spark.read.schema(schema).json(json).withColumn("kind", F.lit("json")))
    return back.select("kind", "tech", "year", "cost")


@query(f"WITH {UNITS}, k AS (SELECT unit, unit % 4 AS d1, unit // 4 % 4 AS d2, unit // 16 % 4 AS d3 FROM units), t AS (SELECT unit, d1 % 2 * 4 + d2 % 2 * 2 + d3 % 2 AS x, d1 // 2 * 4 + d2 // 2 * 2 + d3 // 2 AS y FROM k) SELECT unit, round(x / 8.0 * 360 - 180, 6) AS west, round((x + 1) / 8.0 * 360 - 180, 6) AS east, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 8.0)))), 6) AS south, round(degrees(atan(sinh(pi() * (1 - 2 * y / 8.0)))), 6) AS north FROM t")
def tile_boxes(spark, d):
    """Bounding boxes of tiles by their keys."""
    u = F.col("unit")
    key = F.concat(*[(F.floor(u / k) % 4).cast("string") for k in (1, 4, 16)])
    return b.units(spark, d).select("unit", *[r(c, 6).alias(n) for c, n in zip(tab.quadkey_box(key), ("south", "west", "north", "east"), strict=True)])


@query(f"WITH {NODES} SELECT 'plant ' || node AS unit, CAST(k AS INTEGER) AS node, CAST(100 + node * (k + 1) AS DOUBLE) AS rated_power, 30.0 + node AS fuel_cost FROM nodes, range(0, 3) x(k)")
def configured_units(spark, d):
    """Parameter lists of a configuration as a row a unit and node; a configuration has few units, here one a nation."""
    units = [{"name": f"plant {n['node']}", "type": "thermal", "rated_power": [100 + n["node"] * (k + 1) for k in range(3)], "fuel_cost": 30.0 + n["node"]} for n in b.nodes(spark, d).collect()]
    return config.unit_rows(spark, units).select("unit", "node", "rated_power", "fuel_cost")


@query(f"WITH {NODES} SELECT 'balance' AS row, 'gen_' || node AS col, CAST(1 AS DOUBLE) AS val, CAST(10 + node AS DOUBLE) AS obj, CAST(5 * node + 1 AS DOUBLE) AS ub FROM nodes UNION ALL SELECT 'system_' || system, 'gen_' || node, CAST(0.5 + node AS DOUBLE), CAST(10 + node AS DOUBLE), CAST(5 * node + 1 AS DOUBLE) FROM nodes")
def program_matrix(spark, d):
    """A linear program as text, parsed to sparse tables; it has one column a nation."""
    nodes = b.nodes(spark, d).orderBy("node").collect()
    terms = lambda xs: " + ".join(xs)
    lines = ["Minimize", " cost: " + terms(f"{10 + n['node']} gen_{n['node']}" for n in nodes), "Subject To", " balance: " + terms(f"gen_{n['node']}" for n in nodes) + " >= 100"]
    for s in sorted({n["system"] for n in nodes}):
        lines.append(f" system_{s}: " + terms(f"{0.5 + n['node']} gen_{n['node']}" for n in nodes if n["system"] == s) + " <= 900")
    lines += ["Bounds", *(f" 0 <= gen_{n['node']} <= {5 * n['node'] + 1}" for n in nodes), "End"]
    coef, rows, cols = lp_text.frames(spark, lp_text.parse("\n".join(lines)))
    return coef.join(rows, "row").join(cols, "col").select("row", "col", "val", "obj", "ub")


# Streams.


@query(f"WITH {SERIES} SELECT category, count(*) AS n, round(sum(value), 4) AS value FROM series GROUP BY category")
def streamed_results(spark, d):
    """Events appended batch by batch as they arrive, and read back."""
    like = b.table(spark, d, "events")
    path = scratch(spark, "appended")
    inc.append_results(inc.read_stream(spark, f"{d}/events.parquet*", like).drop("props"), path, scratch(spark, "appended-log"), ["event_type"]).awaitTermination()
    back = spark.read.parquet(path)
    return back.groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n"), r(F.sum("value")).alias("value"))


@query("SELECT event_type AS category, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def streamed_days(spark, d):
    """Days of a stream by event time; the table holds the state after the last batch."""
    like = b.table(spark, d, "events")
    path = scratch(spark, "days")
    days = inc.tumbling(inc.read_stream(spark, f"{d}/events.parquet*", like, "ts"), "ts", ["event_type"], "value", "1 day", "10 minutes")
    save = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    days.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", scratch(spark, "days-log")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select(F.col("event_type").alias("category"), F.to_date("start").alias("day"), "n", r("total").alias("total"), r("mean", 6).alias("mean"))


@query(f"""WITH RECURSIVE {SERIES}, c AS (SELECT entity, hour, sum(CASE WHEN event % 3 = 0 THEN 0 ELSE value END) AS ch, sum(CASE WHEN event % 3 = 0 THEN value ELSE 0 END) AS di FROM series GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY hour) AS k FROM c),
 s AS (SELECT DISTINCT entity, CAST(0 AS BIGINT) AS k, -1 AS hour, CAST(40 AS DOUBLE) AS soc FROM c UNION ALL SELECT s.entity, n.k, n.hour, least(150, greatest(0, soc + 0.9 * ch - di / 0.95)) FROM s JOIN n ON n.entity = s.entity AND n.k = s.k + 1)
SELECT entity, hour, round(soc, 6) AS soc FROM s WHERE k > 0""")
def streamed_storage(spark, d):
    """States of charge carried from batch to batch; the series comes in four files, in the order of time."""
    s = b.series(spark, d)
    out = F.col("event") % 3 == 0
    c = s.groupBy("entity", "hour").agg(F.sum(F.when(out, 0.0).otherwise(F.col("value"))).alias("ch"), F.sum(F.when(out, F.col("value")).otherwise(0.0)).alias("di"))
    feed, path = scratch(spark, "feed"), scratch(spark, "states")
    last = c.agg(F.max("hour")).first()[0] or 0
    for k in range(4):
        c.where(F.floor(F.col("hour") * 4 / (last + 1)) == k).coalesce(1).write.mode("append").parquet(feed)
    states = inc.storage_state(inc.read_stream(spark, feed, c), "entity", "hour", "ch", "di", 40.0, 150.0, 0.9, 0.95)
    states.writeStream.outputMode("append").option("checkpointLocation", scratch(spark, "states-log")).trigger(availableNow=True).start(path, format="parquet").awaitTermination()
    return spark.read.schema("entity bigint, hour int, soc double").parquet(path).select("entity", "hour", r("soc", 6).alias("soc"))


# Plugins and constraints.


class Growth(Plugin):
    """Demand a tenth higher."""

    name = "growth"

    def post_demand_loaded(self, engine, demand):
        return demand.withColumn("mw", F.col("mw") * 1.1)


class Remainder(Plugin):
    """Demand less what behind-the-meter units give: the last plugin's table stands."""

    name = "remainder"

    def post_demand_loaded(self, engine, demand):
        return demand.withColumn("mw", F.col("mw") - 1000)


@query(f"WITH {DEMAND} SELECT node, year, round(sum(mw * 1.1 - 1000), 2) AS mw FROM demand GROUP BY 1, 2")
def plugin_demand(spark, d):
    """Demand that two plugins replace in turn, measured by a user's metric."""
    e = Engine(spark)
    e.use(Growth())
    e.use("wattspan.queries.runs:Remainder")
    e.load_demand(b.demand(spark, d))
    e.metric("yearly", lambda engine: engine.tables["demand"].groupBy("node", "year").agg(r(F.sum("mw"), 2).alias("mw")))
    return e.measure("yearly")


@query(f"WITH {NODES} SELECT 'cap_' || system AS row, CAST(node AS BIGINT) AS col, 1.0 + node AS val, '<=' AS sense, 100.0 * system AS rhs FROM nodes")
def constraint_rows(spark, d):
    """A user's constraints, one for each system over the nodes' investments, as rows of the program."""
    nodes = b.nodes(spark, d)
    e = Engine(spark)
    by_system: dict = {}
    for n in nodes.collect():  # a nation a row
        by_system.setdefault(n["system"], {})["build", n["node_name"]] = 1.0 + n["node"]
    for system, terms in by_system.items():
        e.constrain(f"cap_{system}", terms, "<=", 100.0 * system)
    columns = nodes.select(F.lit("build").alias("variable"), F.col("node_name").alias("element"), F.col("node").cast("long").alias("col"))
    coef, rows = e.constraint_rows(columns)
    return coef.join(rows, "row").select("row", "col", "val", "sense", "rhs")


# Joins and text.


@query("WITH f AS (SELECT * FROM (VALUES ('ring', 1, 'coal'), ('g', 2, 'gas'), ('t', 3, 'oil')) x(suffix, priority, fuel)) SELECT part, fuel FROM (SELECT p_partkey AS part, fuel, row_number() OVER (PARTITION BY p_partkey ORDER BY priority NULLS LAST) AS rn FROM part LEFT JOIN f ON ends_with(p_name, suffix)) WHERE rn = 1")
def fuel_by_suffix(spark, d):
    """The fuel of the first suffix, by priority, that a unit's name ends in."""
    fuels = spark.createDataFrame([("ring", 1, "coal"), ("g", 2, "gas"), ("t", 3, "oil")], "suffix string, priority int, fuel string")
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_name")
    return jn.first_match(p, fuels, "part", F.endswith("p_name", "suffix"), "priority").select("part", "fuel")


@query("WITH n AS (SELECT p_partkey AS part, CASE p_partkey % 6 WHEN 0 THEN 'Natural_Gas' WHEN 1 THEN 'Diesel' WHEN 2 THEN 'hard coal' WHEN 3 THEN ' PV ' WHEN 4 THEN 'offshore_wind' ELSE p_type END AS name FROM part) SELECT part, CASE part % 6 WHEN 0 THEN 'Natural Gas' WHEN 1 THEN 'Oil' WHEN 2 THEN 'Coal' WHEN 3 THEN 'Solar' WHEN 4 THEN 'Wind' ELSE upper(name[1]) || lower(name[2:]) END AS fuel FROM n")
def fuel_names(spark, d):
    """Fuels by the words of their tags."""
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, "Natural_Gas").when(k == 1, "Diesel").when(k == 2, "hard coal").when(k == 3, " PV ").when(k == 4, "offshore_wind").otherwise(F.col("p_type"))
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("part"), sc.fuel_name(name).alias("fuel"))


@query(f"WITH {DEMAND}, {UNITS}, n AS (SELECT node, sum(mw) AS mw FROM demand GROUP BY node), q AS (SELECT * FROM n WHERE mw > (SELECT avg(mw) FROM n)) SELECT unit, round(coalesce(mw, 7), 2) AS mw FROM units LEFT JOIN q USING (node)")
def node_values_on_buses(spark, d):
    """The demand of nodes above the mean on each of their buses, a default elsewhere."""
    n = b.demand(spark, d).groupBy("node").agg(F.sum("mw").alias("mw"))
    q = n.withColumn("_m", F.avg("mw").over(Window.partitionBy())).where("mw > _m").drop("_m")  # a node a row
    return jn.nodes_to_buses(q, b.units(spark, d).select("node", "unit"), "node", "unit", "mw", "property", 7.0).select("unit", r("mw", 2).alias("mw"))


@query("SELECT p_partkey AS part, p_name AS plain FROM part")
def investment_names(spark, d):
    """Candidates' names without the mark of an investment and their number."""
    p = b.table(spark, d, "part")
    marked = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Investment "), "p_name", F.lit(" ("), F.col("p_partkey"), F.lit(")"))).otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("part"), sc.strip_investment(marked).alias("plain"))


@query(f"WITH {HOURLY}, n AS (SELECT *, coalesce(lead(v) OVER (PARTITION BY category ORDER BY hour), v) AS nx FROM h) SELECT category, CAST(hour * 4 + i AS INTEGER) AS quarter, round(v + (nx - v) * i / 4, 6) AS v FROM n, range(0, 4) x(i)")
def quarter_hours(spark, d):
    """Hours on the way to the next ones, by quarters."""
    x = t.subdivided(hourly(spark, d), ["category"], "hour", "v", 4)
    return x.select("category", F.col("hour").alias("quarter"), r("v", 6).alias("v"))


@query("WITH p AS (SELECT p_partkey, p_type = 'ECONOMY' AS minor FROM part), k AS (SELECT count(*) FILTER (NOT minor) AS n, count(*) AS z FROM p) SELECT p_partkey AS part FROM p WHERE NOT minor UNION ALL SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey DESC) AS rn FROM p WHERE minor), k WHERE rn <= z * 9 // 10 - n")
def capped_features(spark, d):
    """Nine tenths of all features: every major one, and the first of the minor ones."""
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_type")
    return ft.capped(p, F.col("p_type") == "ECONOMY", [F.desc("part")], p.count() * 9 // 10).select("part")


# Finance and plans.


@query(f"WITH {GT}, x AS (SELECT tech, year, sum(cost) AS c FROM gt GROUP BY 1, 2), m AS (SELECT * FROM (VALUES (0, 0.2), (1, 0.32), (2, 0.192), (3, 0.1152), (4, 0.1152), (5, 0.0576)) v(k, s)) SELECT tech, CAST(year + k AS INTEGER) AS year, round(sum(c * s), 2) AS amount FROM x, m GROUP BY 1, 2")
def accelerated_depreciation(spark, d):
    """Each year's investment written off at accelerated shares."""
    x = b.generation_by_tech(spark, d).groupBy("tech", "year").agg(F.sum("cost").alias("c"))
    return pl.vintage_schedule(x, ["tech"], "year", F.col("c"), fin.depreciation("macrs", 5)).select("tech", F.col("year").cast("int").alias("year"), r("amount", 2).alias("amount"))


@query(f"WITH {UNITS} SELECT unit, round(rated_mw * 1000 * 0.07 * pow(1.07, 10 + unit % 20) / (pow(1.07, 10 + unit % 20) - 1), 4) AS annuity FROM units")
def debt_annuity(spark, d):
    return b.units(spark, d).select("unit", r(fin.annuity(F.col("rated_mw") * 1000, F.lit(0.07), 10 + F.col("unit") % 20)).alias("annuity"))


@query(f"WITH {UNITS} SELECT unit, CAST(i AS INTEGER) AS block, round(20 + unit % 7 + 30 * (i + 0.5) / 5, 6) AS price FROM units, range(0, 5) x(i)")
def cost_blocks(spark, d):
    """Prices of the blocks of each unit's cost curve."""
    low = 20 + F.col("unit") % 7
    return b.units(spark, d).select("unit", F.posexplode(sc.cost_blocks(low, low + 30, 5)).alias("block", "price"))


@query(f"""WITH RECURSIVE {GT}, y AS (SELECT year, sum(CASE WHEN renewable THEN mw ELSE 0 END) / sum(mw) AS share, row_number() OVER (ORDER BY year) AS k, count(*) OVER () AS n FROM gt GROUP BY year),
 t AS (SELECT CAST(1 AS BIGINT) AS k, CAST(0.3 AS DOUBLE) AS target, n FROM y WHERE k = 1 UNION ALL SELECT t.k + 1, least(0.8, target + least(0.1, greatest(0.02, (0.8 - target) / (n - t.k)))), n FROM t WHERE t.k < n)
SELECT year, round(target, 9) AS target, round(share - target, 9) AS ahead FROM y JOIN t USING (k)""")
def renewable_targets(spark, d):
    """The share of renewables against targets that rise within bounds; a row a year."""
    y = b.generation_by_tech(spark, d).groupBy("year").agg((F.sum(F.when(F.col("renewable"), F.col("mw")).otherwise(0.0)) / F.sum("mw")).alias("share"))
    years = sorted(x["year"] for x in y.select("year").collect())  # a few years
    targets = spark.createDataFrame(list(zip(years, pl.re_targets(0.3, 0.8, len(years), 0.02, 0.1), strict=True)), "year int, target double")
    return y.join(targets, "year").select("year", r("target", 9).alias("target"), r(F.col("share") - F.col("target"), 9).alias("ahead"))


@query(f"""WITH {SERIES}, s AS (SELECT entity, hour, max(value) AS soc, sum(value) / 3 AS ch, min(value) AS di FROM series GROUP BY 1, 2), x AS (SELECT *, lag(soc) OVER (PARTITION BY entity ORDER BY hour) + 0.9 * ch - di / 0.95 AS expected FROM s)
SELECT entity, hour, round(expected, 6) AS expected FROM x WHERE soc > 90 + 1e-9 OR abs(soc - expected) > 1e-6""")
def storage_violations(spark, d):
    """Steps whose charge leaves its bounds or does not follow from the step before."""
    s = b.series(spark, d).groupBy("entity", "hour").agg(F.max("value").alias("soc"), (F.sum("value") / 3).alias("ch"), F.min("value").alias("di")).withColumn("capacity", F.lit(90.0))
    return ck.storage_violations(s, ["entity"], "hour", "soc", "ch", "di", "capacity", 0.9, 0.95).select("entity", "hour", r("expected", 6).alias("expected"))


# Networks.


@query(f"WITH {UNITS} SELECT unit, CAST(k AS INTEGER) AS bus, round(CASE WHEN k = 1 THEN -0.3 - unit % 5 / 20.0 ELSE -0.2 - rated_mw / 100000 END, 6) AS p, true AS converged FROM units, range(1, 3) x(k)")
def ac_power_flow(spark, d):
    """Newton's method on three buses of each unit: what flows into the load buses is their load."""
    lines = [(0, 1, 0.02, 0.1, 0.02), (1, 2, 0.03, 0.12, 0.01), (0, 2, 0.01, 0.08, 0.02)]
    u = b.units(spark, d)
    load = F.when(F.col("bus") == 1, -0.3 - F.col("unit") % 5 / 20.0).when(F.col("bus") == 2, -0.2 - F.col("rated_mw") / 100000).otherwise(0.0)
    buses = u.withColumn("bus", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select("unit", "bus", F.when(F.col("bus") == 0, 0).otherwise(2).alias("kind"), load.alias("p"), (load / 3).alias("q"), F.lit(1.0).alias("v"))
    v = pf.power_flow(buses, lines, "unit")
    ends = spark.createDataFrame([(a, c, *((1 / complex(rr, x)).real for _ in (0,)), (1 / complex(rr, x)).imag) for a, c, rr, x, _ in [*lines, *((c, a, rr, x, s) for a, c, rr, x, s in lines)]], "bus int, other int, g double, bs double")
    far = v.select("unit", F.col("bus").alias("other"), F.col("v").alias("w"), F.col("angle").alias("beta"))
    x = v.join(F.broadcast(ends), "bus").join(far, ["unit", "other"])
    diff = F.col("angle") - F.col("beta")
    sent = F.col("v") * F.col("v") * F.col("g") - F.col("v") * F.col("w") * (F.col("g") * F.cos(diff) + F.col("bs") * F.sin(diff))
    # Loads have seven digits, so many lie half-way between two of six: the solver's error is taken off before they are rounded.
    exact = F.round(F.round(F.sum(sent), 10) * 1e6) / 1e6
    return x.groupBy("unit", "bus").agg(exact.alias("p"), F.min("converged").alias("converged")).where("bus > 0").select("unit", "bus", "p", "converged")


@query(f"WITH {MERGED}, n AS (SELECT a AS bus FROM mg UNION SELECT b FROM mg), i AS (SELECT bus, (bus - avg(bus) OVER ()) * 10 AS mw FROM n) SELECT line AS outage, bus, round(mw, 5) AS mw FROM mg, i")
def post_outage_balance(spark, d):
    """After the loss of any line, flows by its factors still bring every bus what is injected there."""
    m = merged(spark, d)
    n = m.select(F.explode(F.array("a", "b")).alias("bus")).distinct()
    inj = n.select(F.lit(1).alias("net"), "bus", ((F.col("bus") - F.avg("bus").over(Window.partitionBy())) * 10).alias("mw"))  # a bus a row
    flows = se.mesh_flows(m, inj, "net").select("line", "flow")
    post = net.outage_flows(flows, se.outage_factors(m, "net").select("line", "outage", "lodf")).join(m.select("line", "a", "b"), "line")
    ends = post.select("outage", F.explode(F.array(F.struct(F.col("a").alias("bus"), F.col("post").alias("v")), F.struct(F.col("b").alias("bus"), (-F.col("post")).alias("v")))).alias("s"))
    return ends.groupBy("outage", F.col("s.bus").alias("bus")).agg((F.round(F.sum("s.v"), 5) + 0.0).alias("mw"))


CUST = "e AS (SELECT DISTINCT c_custkey AS a, 10000000 + c_nationkey * 1000 + CAST(floor(c_acctbal / 1000) AS BIGINT) AS b FROM customer)"


@query(f"WITH RECURSIVE {CUST}, arc AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e), reach AS (SELECT u AS s, u AS node FROM arc UNION SELECT s, v FROM reach JOIN arc ON u = node), n AS (SELECT s, count(*) AS n FROM reach GROUP BY s) SELECT a, b FROM e JOIN n ON s = a WHERE n >= 4")
def connected_lines(spark, d):
    """Lines of components with at least four nodes: customers and the classes of balance in their nation."""
    e = b.table(spark, d, "customer").select(F.col("c_custkey").alias("a"), (10000000 + F.col("c_nationkey") * 1000 + F.floor(F.col("c_acctbal") / 1000)).cast("long").alias("b")).distinct()
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return net.drop_isolated(e, net.connected_components(e, nodes), 4)


@query("WITH l AS (SELECT l_suppkey AS unit, l_linenumber AS k, sum(l_quantity) AS cap FROM lineitem GROUP BY 1, 2), s AS (SELECT unit, sum(cap) FILTER (k % 2 = 0) AS a, sum(cap) FILTER (k % 2 = 1 AND k < 7) AS b, coalesce(sum(cap) FILTER (k = 7), 0) AS c FROM l GROUP BY unit) SELECT unit, round(least(coalesce(a, 0), coalesce(b, 0)) + c, 4) AS flow FROM s")
def greatest_flow(spark, d):
    """What each unit's lines can carry from bus 0 to bus 2: even lines lead to bus 1, odd ones on from there, the seventh directly."""
    x = b.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), F.col("l_linenumber").alias("k")).agg(F.sum("l_quantity").alias("cap"))
    even = F.col("k") % 2 == 0
    lines = x.select("unit", F.when(even | (F.col("k") == 7), 0).otherwise(1).alias("a"), F.when(even, 1).otherwise(2).alias("b"), "cap")

    def flow(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"unit": [p["unit"].iloc[0]], "flow": [net.max_flow(p, 0, 2)]})

    return lines.groupBy("unit").applyInPandas(flow, "unit long, flow double").select("unit", r("flow").alias("flow"))


@query(f"""WITH RECURSIVE {PTS}, pl AS (SELECT lat, lon, min(cust) AS rep FROM c GROUP BY 1, 2), e AS (SELECT b.rep AS a, c.rep AS o FROM pl c JOIN pl b ON b.lat BETWEEN c.lat - 0.1 AND c.lat + 0.1 WHERE {HAV} <= 3.5),
 reach AS (SELECT rep AS a, rep AS o FROM pl UNION SELECT reach.a, e.o FROM reach JOIN e ON e.a = reach.o), cl AS (SELECT a AS rep, min(o) AS cluster FROM reach GROUP BY a) SELECT cust AS bus, cluster FROM c JOIN pl USING (lat, lon) JOIN cl USING (rep)""")
def bus_clusters(spark, d):
    """Buses that stand together, by steps of at most 3.5 km."""
    c, _ = points(spark, d)
    return dem.density_clusters(c, "cust", "lat", "lon", 3.5).select(F.col("node").alias("bus"), F.col("component").alias("cluster"))


# Estimation.


@query(f"WITH {NODES} SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS folds FROM (SELECT node, row_number() OVER (ORDER BY node) - 1 AS k FROM nodes)")
def held_out_countries(spark, d):
    """Every country is held out once, in a fold of its own."""
    n = b.nodes(spark, d)
    x = est.leave_one_out(b.demand(spark, d).join(n, "node", "right"), "node_name", 1000)
    return x.agg(F.count_distinct("node_name").alias("n"), F.sum("fold").cast("long").alias("folds"))


@query(f"""WITH RECURSIVE {SERIES}, c AS (SELECT category, round(value, 2) AS x, count(*) AS n FROM series WHERE value > 0 GROUP BY 1, 2), l AS (SELECT category, list({{'x': x, 'n': n}}) AS s, sum(n * ln(x)) / sum(n) AS m, sum(n) AS z FROM c WHERE x > 0 GROUP BY category),
 k AS (SELECT category, 0 AS i, CAST(2 AS DOUBLE) AS k FROM l UNION ALL SELECT k.category, i + 1, 1 / (list_sum(list_transform(s, lambda v: v.n * pow(v.x, k) * ln(v.x))) / list_sum(list_transform(s, lambda v: v.n * pow(v.x, k))) - m) FROM k JOIN l ON l.category = k.category WHERE i < 60)
SELECT category, round(k, 5) AS shape, round(pow(list_sum(list_transform(s, lambda v: v.n * pow(v.x, k))) / z, 1 / k), 4) AS scale FROM k JOIN l USING (category) WHERE i = 60""")
def weibull_fit(spark, d):
    """Shape and scale of wind speeds by likelihood."""
    return dem.weibull_moments(b.series(spark, d), ["category"], "value").select("category", r("shape", 5).alias("shape"), r("scale", 4).alias("scale"))
