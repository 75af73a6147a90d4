"""Dispatch, planning, finance, joins, networks, risk and estimation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattspan import bindings as b
from wattspan.functions import finance as fin
from wattspan.functions import scalar as sc
from wattspan.operators import demand as dem
from wattspan.operators import dispatch as dp
from wattspan.operators import joins as jn
from wattspan.operators import network as net
from wattspan.operators import planning as pl
from wattspan.operators import risk as rk
from wattspan.operators import security as se
from wattspan.operators import temporal as t
from wattspan.queries import DEMAND, GEN, GT, NODES, UNITS, query, r

# Dispatch. Units of a node meet the node's demand of each day; a unit's cost is its number's remainder.
DISPATCH_SQL = f"""{UNITS}, {DEMAND}, q AS (SELECT node, day, sum(mw) / 100 AS load FROM demand GROUP BY node, day),
 u AS (SELECT unit, node, rated_mw AS cap, 10.0 + unit % 7 AS cost FROM units), j AS (SELECT q.node, day, load, unit, cap, cost, coalesce(sum(cap) OVER (PARTITION BY q.node, day ORDER BY cost, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q JOIN u ON q.node = u.node),
 disp AS (SELECT *, greatest(0, least(cap, load - before)) AS dispatch FROM j)"""


def dispatched(spark, d, steps="true", by_unit=False):
    """Merit order of every node and day, or of the steps that a condition names; dealt by step or by unit."""
    units = b.units(spark, d).select("unit", "node", F.col("rated_mw").alias("cap"), (10.0 + F.col("unit") % 7).alias("cost"))
    load = b.demand(spark, d).where(steps).groupBy("node", "day").agg((F.sum("mw") / 100).alias("load"))
    return dp.fleet_merit_order(units, load, ["node"], "day", "unit", "cap", "cost", "load", by_unit)


@query(f"WITH {DISPATCH_SQL} SELECT node, day, unit, round(dispatch, 4) AS dispatch FROM disp")
def merit_order_dispatch(spark, d):
    return dispatched(spark, d).select("node", "day", "unit", r("dispatch").alias("dispatch"))


@query(f"WITH {DISPATCH_SQL} SELECT node, day, round(max(load), 4) AS load, round(sum(dispatch), 4) AS served, round(greatest(0, max(load) - sum(dispatch)), 4) AS shed FROM disp GROUP BY node, day")
def load_shed(spark, d):
    return dp.load_shed(dispatched(spark, d), ["node", "day"], "load").select("node", "day", r("load").alias("load"), r("served").alias("served"), r("shed").alias("shed"))


@query(f"""WITH {DISPATCH_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY node, day ORDER BY CAST(dispatch < cap - 1e-6 AS INTEGER) DESC, cost DESC, unit DESC) AS rn FROM disp WHERE dispatch > 1e-6), s AS (SELECT node, day, max(load) - sum(dispatch) > 1e-6 AS shed FROM disp GROUP BY node, day)
SELECT s.node, s.day, unit AS marginal_unit, CASE WHEN shed THEN 10000.0 ELSE CAST(cost AS DOUBLE) END AS price FROM s LEFT JOIN k ON s.node = k.node AND s.day = k.day AND rn = 1""")
def marginal_unit(spark, d):
    return dp.marginal_unit(dispatched(spark, d), ["node", "day"], "unit", "cap", "cost", "load")


@query(f"WITH {DISPATCH_SQL}, x AS (SELECT node, day, sum(CASE WHEN unit % 3 > 0 THEN cap - dispatch ELSE 0 END) AS headroom, 0.1 * max(load) AS required FROM disp GROUP BY node, day) SELECT node, day, round(headroom, 6) AS headroom, round(required, 6) AS required, round(greatest(0, required - headroom), 6) AS short FROM x")
def static_reserve(spark, d):
    x = dispatched(spark, d).withColumn("ok", F.col("unit") % 3 > 0)
    return dp.static_reserve(x, ["node", "day"], "cap", "dispatch", "ok", 0.1, "load").select("node", "day", r("headroom", 6).alias("headroom"), r("required", 6).alias("required"), r("short", 6).alias("short"))


@query(f"WITH {DISPATCH_SQL}, x AS (SELECT node, day, sum(dispatch) - max(dispatch) AS secure, max(load) AS load FROM disp GROUP BY node, day) SELECT node, day, round(secure, 4) AS secure, round(load, 4) AS load, round(greatest(0, load - secure), 4) AS slack FROM x")
def preventive_security(spark, d):
    return dp.without_largest(dispatched(spark, d), ["node", "day"], "dispatch", "load").select("node", "day", r("secure").alias("secure"), r("load").alias("load"), r("slack").alias("slack"))


@query(f"WITH {DISPATCH_SQL}, x AS (SELECT node, day, sum(dispatch * (2 + unit % 5)) AS inertia FROM disp GROUP BY node, day) SELECT node, day, round(inertia, 4) AS inertia, round(greatest(0, 5000 - inertia), 4) AS short FROM x")
def inertia_check(spark, d):
    x = dispatched(spark, d).withColumn("h", (2 + F.col("unit") % 5).cast("double"))
    return dp.inertia(x, ["node", "day"], "dispatch", "h", 5000.0).select("node", "day", r("inertia").alias("inertia"), r("short").alias("short"))


@query(f"WITH {GEN}, {UNITS}, {DEMAND}, x AS (SELECT node, year, mw * 3000 AS v FROM gen JOIN units USING (unit) UNION ALL SELECT node, year, -mw FROM demand) SELECT node, year, round(sum(v), 2) AS residual FROM x GROUP BY node, year")
def balance_residual(spark, d):
    g = b.generation(spark, d).join(b.units(spark, d).select("unit", "node"), "unit").select("node", "year", (F.col("mw") * 3000).alias("mw"))
    return dp.balance_residual(g, b.demand(spark, d), ["node", "year"]).withColumn("residual", r("residual", 2))


@query(f"WITH {UNITS} SELECT unit AS line, CAST(s AS INTEGER) AS segment, round(rated_mw / 4, 6) AS width, round(0.01 * (2 * s - 1) * (rated_mw / 4) / 100, 8) AS slope FROM units, range(1, 5) x(s)")
def loss_segments(spark, d):
    u = b.units(spark, d).select(F.col("unit").alias("line"), F.lit(0.01).alias("r"), F.col("rated_mw").alias("cap"))
    return dp.loss_segments(u, "line", "r", "cap", 4).select("line", "segment", r("width", 6).alias("width"), r("slope", 8).alias("slope"))


@query(f"WITH {DISPATCH_SQL}, x AS (SELECT *, greatest(0, load - sum(dispatch) OVER (PARTITION BY node, day)) AS shed, sum(dispatch * cost) OVER (PARTITION BY node, day) AS paid FROM disp) SELECT node, day, unit, round(dispatch, 6) AS dispatch, round(shed, 6) AS shed, round(paid + 10000 * shed, 4) AS objective FROM x")
def simplex_dispatch(spark, d):
    """Every node and day by an exact linear program."""
    x = dispatched(spark, d).select("node", "day", "unit", "cap", "cost", "load")
    out = dp.lp_dispatch(x, ["node", "day"], "unit", "cap", "cost", "load")
    return out.select("node", "day", "unit", r("dispatch", 6).alias("dispatch"), r("shed", 6).alias("shed"), r("objective").alias("objective"))


# Planning.

VINTAGES = f"{GT}, vt AS (SELECT tech, year, sum(mw) AS mw FROM gt GROUP BY tech, year)"


def vintages(spark, d):
    return b.generation_by_tech(spark, d).groupBy("tech", "year").agg(F.sum("mw").alias("mw"))


@query(f"WITH {VINTAGES} SELECT tech, CAST(y AS INTEGER) AS year, round(sum(mw * pow(0.98, y - vt.year)), 4) AS capacity FROM vt, range(1995, 2006) x(y) WHERE vt.year <= y AND y < vt.year + 4 GROUP BY tech, y")
def cumulative_vintage_capacity(spark, d):
    return pl.cumulative_capacity(vintages(spark, d), ["tech"], "year", "mw", (1995, 2005), 4, 0.02).select("tech", "year", r("capacity").alias("capacity"))


@query(f"""WITH {VINTAGES}, {DEMAND}, c AS (SELECT tech, CAST(y AS INTEGER) AS year, sum(mw * pow(0.98, y - vt.year)) AS capacity FROM vt, range(1995, 2006) x(y) WHERE vt.year <= y AND y < vt.year + 4 GROUP BY tech, y), pk AS (SELECT max(mw) / 10 AS peak FROM demand)
SELECT year, round(sum(capacity * CASE WHEN tech IN ('ECONOMY', 'MEDIUM', 'SMALL') THEN 0.3 ELSE 0.9 END), 4) AS firm, round(any_value(peak) * pow(1.02, year - 1995) * 1.15, 4) AS required, sum(capacity * CASE WHEN tech IN ('ECONOMY', 'MEDIUM', 'SMALL') THEN 0.3 ELSE 0.9 END) >= any_value(peak) * pow(1.02, year - 1995) * 1.15 AS adequate FROM c, pk GROUP BY year""")
def capacity_adequacy(spark, d):
    c = pl.cumulative_capacity(vintages(spark, d), ["tech"], "year", "mw", (1995, 2005), 4, 0.02)
    peak = b.demand(spark, d).agg((F.max("mw") / 10).alias("peak"))
    credit = F.when(F.col("tech").isin(*b.RENEWABLE), 0.3).otherwise(0.9)
    out = pl.adequacy(c.join(F.broadcast(peak)), F.col("peak"), 1.02, 1.15, 1995, credit)
    return out.select("year", r("firm").alias("firm"), r("required").alias("required"), "adequate")


@query(f"WITH {VINTAGES} SELECT tech, round(sum(mw * 1200.0 / pow(1.07, year - 1995)), 2) AS npv FROM vt GROUP BY tech")
def investment_npv(spark, d):
    v = vintages(spark, d).withColumn("cost", F.lit(1200.0))
    return pl.investment_cost(v, ["tech"], "mw", "cost", "year", 1995, 0.07).withColumn("npv", r("npv", 2))


@query(f"WITH {GT}, a AS (SELECT brand, tech, sum(mw) AS v FROM gt GROUP BY brand, tech) SELECT tech, round(1 - 2 * avg(CAST(v > 800 AS DOUBLE)), 6) AS score FROM a GROUP BY tech")
def mga_scores(spark, d):
    a = b.generation_by_tech(spark, d).groupBy("brand", "tech").agg(F.sum("mw").alias("v"))
    return pl.mga_scores(a, ["tech"], "v", 800.0).withColumn("score", r("score", 6))


@query(f"WITH {GT}, a AS (SELECT brand, tech, sum(mw) AS v FROM gt GROUP BY brand, tech), x AS (SELECT *, max(CASE WHEN brand = 'Brand#1' THEN v END) OVER (PARTITION BY tech) AS b0, max(v) OVER (PARTITION BY tech) - min(v) OVER (PARTITION BY tech) AS span FROM a) SELECT brand, round(avg(CASE WHEN span > 0 THEN abs(v - b0) / span ELSE 0 END), 6) AS distance FROM x GROUP BY brand")
def mga_l1_distance(spark, d):
    a = b.generation_by_tech(spark, d).groupBy("brand", "tech").agg(F.sum("mw").alias("v"))
    return pl.l1_distance(a, "brand", ["tech"], "v", "Brand#1").select("brand", r("distance", 6).alias("distance"))


_MODEL = "sin(6.2832 * ({0} - 0.5)) + 7 * pow(sin(6.2832 * ({1} - 0.5)), 2) + 0.1 * pow(6.2832 * ({2} - 0.5), 4) * sin(6.2832 * ({0} - 0.5))"
_OUTPUTS = {"a": (1, 2, 3), "b": (4, 5, 6), "y0": (4, 2, 3), "y1": (1, 5, 3), "y2": (1, 2, 6)}
_EFFECTS = " UNION ALL ".join(f"SELECT {j} AS dim, round(avg(b * (y{j} - a)) / any_value(v), 6) AS s1, round(avg((a - y{j}) * (a - y{j})) / (2 * any_value(v)), 6) AS st FROM f, v" for j in range(3))


@query(f"""WITH f AS (SELECT {', '.join(f'{_MODEL.format(*(f"embedding[{i}]" for i in at))} AS {name}' for name, at in _OUTPUTS.items())} FROM embeddings),
 v AS (SELECT (sum(a * a) + sum(b * b)) / (2 * count(*)) - pow((sum(a) + sum(b)) / (2 * count(*)), 2) AS v FROM f) {_EFFECTS}""")
def sobol_indices(spark, d):
    """First-order and total effects of a function's three inputs: the decision vectors hold both samples, three values each."""
    at = lambda i: F.element_at("embedding", i)
    y = lambda i, j, k: F.sin(6.2832 * (at(i) - 0.5)) + 7 * F.pow(F.sin(6.2832 * (at(j) - 0.5)), 2) + 0.1 * F.pow(6.2832 * (at(k) - 0.5), 4) * F.sin(6.2832 * (at(i) - 0.5))
    blocks = F.array(*[F.struct(F.lit(n).alias("block"), y(*cols).alias("y")) for n, cols in zip((-2, -1, 0, 1, 2), _OUTPUTS.values(), strict=True)])
    rows = b.table(spark, d, "embeddings").select(F.col("vec_id").alias("base"), F.explode(blocks).alias("s")).select("base", "s.*")
    return pl.sobol_indices(rows, "base", "block", "y", 3).select("dim", r("s1", 6).alias("s1"), r("st", 6).alias("st"))


# Finance.


@query(f"WITH {GEN} SELECT unit, round(sum((revenue - cost) / pow(1.08, year - 1995)), 2) AS npv FROM gen GROUP BY unit")
def npv_cashflow(spark, d):
    return b.generation(spark, d).groupBy("unit").agg(r(fin.npv(F.col("revenue") - F.col("cost"), 0.08, F.col("year") - 1995), 2).alias("npv"))


@query("SELECT CAST(p_size AS INTEGER) AS years, round(CASE WHEN p_size > 25 THEN 1.0 / greatest(p_size, 1) ELSE 0.08 * pow(1.08, p_size) / (pow(1.08, p_size) - 1) END, 8) AS crf FROM (SELECT DISTINCT p_size FROM part)")
def crf_table(spark, d):
    s = b.table(spark, d, "part").select(F.col("p_size").alias("years")).distinct()
    rate = F.when(F.col("years") > 25, 0.0).otherwise(0.08)
    return s.select("years", r(fin.crf(rate, F.col("years")), 8).alias("crf"))


@query(f"WITH {GT}, y AS (SELECT tech, year, sum(revenue - cost) AS cf FROM gt GROUP BY 1, 2) SELECT tech, year, round(sum(cf / pow(1.08, year - 1995)) OVER (PARTITION BY tech ORDER BY year ROWS UNBOUNDED PRECEDING), 2) AS cumulative FROM y")
def cumulative_npv(spark, d):
    y = b.generation_by_tech(spark, d).groupBy("tech", "year").agg(F.sum(F.col("revenue") - F.col("cost")).alias("cf")).withColumn("cf", F.col("cf") * fin.discount(0.08, F.col("year") - 1995))
    return t.cumulative(y, ["tech"], ["year"], "cf").select("tech", "year", r("cumulative", 2).alias("cumulative"))


@query(f"WITH {VINTAGES}, s AS (SELECT * FROM (VALUES (0, 0.2), (1, 0.32), (2, 0.192), (3, 0.1152), (4, 0.1152), (5, 0.0576)) x(k, s)) SELECT tech, CAST(year + k AS INTEGER) AS year, round(sum(mw * 1000 * s), 2) AS amount FROM vt, s GROUP BY tech, year + k")
def vintage_depreciation(spark, d):
    return pl.vintage_schedule(vintages(spark, d), ["tech"], "year", F.col("mw") * 1000, fin.depreciation("macrs", 5)).withColumn("amount", r("amount", 2))


@query(f"WITH {GT}, y AS (SELECT tech, year, sum(revenue - cost) - CASE WHEN year = 1995 THEN 200000 ELSE 0 END AS cf FROM gt GROUP BY 1, 2), c AS (SELECT tech, year, sum(cf) OVER (PARTITION BY tech ORDER BY year ROWS UNBOUNDED PRECEDING) AS c FROM y) SELECT tech, min(CASE WHEN c >= 0 THEN year END) AS payback FROM c GROUP BY tech")
def payback_year(spark, d):
    y = b.generation_by_tech(spark, d).groupBy("tech", "year").agg((F.sum(F.col("revenue") - F.col("cost")) - F.when(F.col("year") == 1995, 200000).otherwise(0)).alias("cf"))
    return t.cumulative(y, ["tech"], ["year"], "cf").groupBy("tech").agg(fin.payback(F.col("year"), F.col("cumulative")).alias("payback"))


@query(f"WITH {GT}, y AS (SELECT tech, year, sum(revenue) AS rv, sum(cost) AS c FROM gt GROUP BY 1, 2) SELECT tech, year, round((rv - 0.4 * c) / (0.5 * c * 0.08 * pow(1.08, 10) / (pow(1.08, 10) - 1)), 6) AS dscr FROM y")
def debt_service_cover(spark, d):
    y = b.generation_by_tech(spark, d).groupBy("tech", "year").agg(F.sum("revenue").alias("rv"), F.sum("cost").alias("c"))
    service = fin.annuity(0.5 * F.col("c"), F.lit(0.08), F.lit(10))
    return y.select("tech", "year", r((F.col("rv") - 0.4 * F.col("c")) / service, 6).alias("dscr"))


@query(f"WITH {GT}, y AS (SELECT year, sum(revenue - cost) AS m, sum(cost) AS c FROM gt GROUP BY year), s AS (SELECT * FROM (VALUES ('price', -0.2), ('price', 0.2), ('cost', -0.2), ('cost', 0.2)) x(p, k)) SELECT p AS parameter, CAST(k AS DOUBLE) AS step, round(sum((m + CASE WHEN p = 'price' THEN k * (m + c) ELSE -k * c END) / pow(1.08, year - 1995)), 1) AS npv FROM y, s GROUP BY p, k")
def tornado(spark, d):
    y = b.generation_by_tech(spark, d).groupBy("year").agg(F.sum(F.col("revenue") - F.col("cost")).alias("m"), F.sum("cost").alias("c"))
    cases = F.array(*(F.struct(F.lit(p).alias("parameter"), F.lit(k).alias("step")) for p in ("price", "cost") for k in (-0.2, 0.2)))
    x = y.withColumn("e", F.explode(cases)).select("year", "m", "c", "e.*")
    moved = F.when(F.col("parameter") == "price", F.col("step") * (F.col("m") + F.col("c"))).otherwise(-F.col("step") * F.col("c"))
    return x.groupBy("parameter", "step").agg(r(fin.npv(F.col("m") + moved, 0.08, F.col("year") - 1995), 1).alias("npv"))


_VALUE = "list_sum(list_transform(c, lambda x, i: x / pow(1 + {}, i - 1)))"


@query(f"""WITH RECURSIVE {GEN}, {UNITS}, y AS (SELECT node, year, sum(revenue - cost) AS cf FROM gen JOIN units USING (unit) GROUP BY 1, 2), f AS (SELECT node, list_prepend(-100000.0, list(cf ORDER BY year)) AS c FROM y GROUP BY node),
 s AS (SELECT node, c, CAST(-0.5 AS DOUBLE) AS lo, CAST(5 AS DOUBLE) AS hi, CAST({_VALUE.format('-0.5')} AS DOUBLE) AS flo, 0 AS k FROM f
  UNION ALL SELECT node, c, CASE WHEN v * flo > 0 THEN mid ELSE lo END, CASE WHEN v * flo > 0 THEN hi ELSE mid END, CASE WHEN v * flo > 0 THEN v ELSE flo END, k + 1 FROM (SELECT *, (lo + hi) / 2 AS mid, {_VALUE.format('(lo + hi) / 2')} AS v FROM s WHERE (hi - lo) / 2 >= 1e-6 AND k < 200)),
 l AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY k DESC) AS rn FROM s)
SELECT node, round(CASE WHEN {_VALUE.format('-0.5')} * {_VALUE.format('5.0')} > 0 THEN -99 ELSE (lo + hi) / 2 END, 4) AS irr,
 round(pow(list_sum(list_transform(c, lambda x, i: greatest(x, 0) * pow(1.05, len(c) - i))) / -list_sum(list_transform(c, lambda x, i: least(x, 0) / pow(1.08, i - 1))), 1.0 / (len(c) - 1)) - 1, 6) AS mirr FROM l WHERE rn = 1""")
def irr_by_node(spark, d):
    """Internal rate of return of each node: an outlay, then yearly margins; -99 without a root in the bounds."""
    g = b.generation(spark, d).join(b.units(spark, d).select("unit", "node"), "unit")
    y = g.groupBy("node", "year").agg(F.sum(F.col("revenue") - F.col("cost")).alias("cf"))
    flows = y.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("year", "cf"))).alias("_y"))
    array = F.concat(F.array(F.lit(-100000.0)), F.transform("_y", lambda x: x["cf"]))
    return flows.select("node", r(F.nanvl(fin.irr(array), F.lit(-99.0)), 4).alias("irr"), r(fin.mirr(array, 0.08, 0.05), 6).alias("mirr"))


# Joins.

OUT = "el AS (SELECT s_suppkey AS element FROM supplier), ow AS (SELECT l_suppkey AS element, CAST(l_orderkey % 700 AS BIGINT) AS start, CAST(l_orderkey % 700 + 5 + l_linenumber * 7 AS BIGINT) AS \"end\", l_discount * 5 AS av FROM lineitem), per AS (SELECT element, CAST(k * 24 AS BIGINT) AS t FROM el, range(0, 31) x(k))"


@query(f"""WITH {OUT}, f AS (SELECT per.element, t, product((1 - (least("end", t + 24) - greatest(start, t)) / 24.0) + (least("end", t + 24) - greatest(start, t)) / 24.0 * av) AS factor FROM per JOIN ow ON per.element = ow.element AND t < "end" AND t + 24 > start GROUP BY 1, 2)
SELECT element, t, round(coalesce(factor, 1), 9) AS factor FROM per LEFT JOIN f USING (element, t)""")
def outage_overlap_factor(spark, d):
    el = b.units(spark, d).select(F.col("unit").alias("element"))
    per = el.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(720).cast("long"), F.lit(24).cast("long"))))
    x = b.table(spark, d, "lineitem")
    ow = x.select(F.col("l_suppkey").alias("element"), (F.col("l_orderkey") % 700).alias("start"), (F.col("l_orderkey") % 700 + 5 + F.col("l_linenumber") * 7).alias("end"), (F.col("l_discount") * 5).alias("av"))
    return jn.outage_factor(per, ow, "element", "start", "end", "av", "t", 24, 48).select("element", "t", r("factor", 9).alias("factor"))


PTS = "c AS (SELECT c_custkey AS cust, CAST(40 + (c_custkey * 37 % 1000) / 500.0 AS DOUBLE) AS lat, CAST(-4 + (c_custkey * 91 % 1000) / 500.0 AS DOUBLE) AS lon FROM customer), b AS (SELECT s_suppkey AS bus, CAST(40 + (s_suppkey * 53 % 100) / 50.0 AS DOUBLE) AS lat, CAST(-4 + (s_suppkey * 29 % 100) / 50.0 AS DOUBLE) AS lon FROM supplier)"
HAV = "2 * 6371 * asin(sqrt(least(1, pow(sin(radians(b.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - c.lon) / 2), 2))))"


def points(spark, d):
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("cust"), (40 + (F.col("c_custkey") * 37 % 1000) / 500.0).alias("lat"), (-4 + (F.col("c_custkey") * 91 % 1000) / 500.0).alias("lon"))
    s = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("bus"), (40 + (F.col("s_suppkey") * 53 % 100) / 50.0).alias("lat"), (-4 + (F.col("s_suppkey") * 29 % 100) / 50.0).alias("lon"))
    return c, s


@query(f"WITH {PTS}, j AS (SELECT cust, bus, {HAV} AS km, row_number() OVER (PARTITION BY cust ORDER BY {HAV}, bus) AS rn FROM c, b) SELECT cust, round(km, 4) AS km FROM j WHERE rn = 1")
def nearest_node(spark, d):
    c, s = points(spark, d)
    return jn.nearest(c, s, "cust", "bus", "lat", "lon", 1.0).select("cust", r("km").alias("km"))


@query(f"WITH {PTS} SELECT cust FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE {HAV} <= 10)")
def generator_gap_fill(spark, d):
    c, s = points(spark, d)
    return jn.gap_fill(s, c, "cust", "lat", "lon", 10.0).select("cust")


@query(f"WITH {UNITS}, {GEN}, m AS (SELECT unit, row_number() OVER (PARTITION BY node ORDER BY unit) = 1 AS f, node, rated_mw FROM units), s AS (SELECT node, sum(rated_mw) AS total FROM units GROUP BY node) SELECT unit AS bus, node, round(CASE WHEN f THEN total ELSE 0 END, 4) AS total FROM m JOIN s USING (node)")
def node_capacity_to_buses(spark, d):
    u = b.units(spark, d)
    mapping = u.select(F.col("unit").alias("bus"), "node")
    return jn.nodes_to_buses(u.groupBy("node").agg(F.sum("rated_mw").alias("total")), mapping, "node", "bus", "total", "capacity").select("bus", "node", r("total").alias("total"))


@query(f"WITH {GEN}, {UNITS} SELECT node, year, round(max(mw), 4) AS mw FROM gen JOIN units USING (unit) GROUP BY node, year")
def buses_to_nodes_max(spark, d):
    g = b.generation(spark, d).select(F.col("unit").alias("bus"), "year", "mw")
    mapping = b.units(spark, d).select(F.col("unit").alias("bus"), "node")
    return jn.buses_to_nodes(g, mapping, "bus", "node", ["year"], "mw", "max").withColumn("mw", r("mw"))


@query("WITH n AS (SELECT s_suppkey AS k, 'Investment ' || s_name || ' (' || (s_suppkey % 3) || ')' AS name FROM supplier) SELECT k, name, s_acctbal AS value FROM n JOIN supplier ON s_suppkey = k")
def tolerant_name_join(spark, d):
    s = b.table(spark, d, "supplier")
    u = s.select(F.col("s_suppkey").alias("k"), F.concat(F.lit("Investment "), "s_name", F.lit(" ("), (F.col("s_suppkey") % 3).cast("string"), F.lit(")")).alias("name"))
    return jn.by_tolerant_name(u, s.select(F.col("s_name").alias("n"), F.col("s_acctbal").alias("value")), "name", "n", "value")


@query(f"WITH {NODES} SELECT system, count(*) AS n FROM nodes WHERE node NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 4 = 0 AND s_nationkey % 2 = 0) GROUP BY system")
def dangling_references(spark, d):
    bad = b.table(spark, d, "supplier").where("s_suppkey % 4 = 0 AND s_nationkey % 2 = 0").select(F.col("s_nationkey").alias("node")).distinct()
    return b.nodes(spark, d).join(bad, "node", "left_anti").groupBy("system").agg(F.count("*").alias("n"))


@query("(SELECT c_nationkey AS node FROM customer EXCEPT SELECT s_nationkey + 3 FROM supplier) UNION ALL (SELECT s_nationkey + 3 FROM supplier EXCEPT SELECT c_nationkey FROM customer)")
def topology_difference(spark, d):
    a = b.table(spark, d, "customer").select(F.col("c_nationkey").alias("node"))
    s = b.table(spark, d, "supplier").select((F.col("s_nationkey") + 3).alias("node"))
    return a.subtract(s).unionByName(s.subtract(a))


# Networks: a line joins a customer's node with the nodes of those who supplied the order.

LINES = "ln AS (SELECT CAST(s_nationkey AS INTEGER) AS a, CAST(p_size % 25 AS INTEGER) AS b, 0.1 + l_discount AS x, 0.01 + l_tax AS r, l_quantity + 10 AS cap, l_orderkey, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE s_nationkey <> p_size % 25)"


def lines(spark, d):
    x = b.table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_discount", "l_tax", "l_quantity")
    s = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a"))
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 25).alias("b"))
    j = x.join(s, "l_suppkey").join(p, "l_partkey").where("a <> b")
    return j.select("a", "b", (0.1 + F.col("l_discount")).alias("x"), (0.01 + F.col("l_tax")).alias("r"), (F.col("l_quantity") + 10).alias("cap"))


@query(f"WITH {LINES}, s AS (SELECT least(a, b) AS from_node, greatest(a, b) AS to_node, x, r, cap, (1 / x) / sum(1 / x) OVER (PARTITION BY least(a, b), greatest(a, b)) AS s FROM ln) SELECT from_node, to_node, count(*) AS circuits, round(1 / sum(1 / x), 8) AS x, round(sum(r * s * s), 8) AS r, round(min(cap / s), 4) AS capacity FROM s GROUP BY 1, 2")
def parallel_line_merge(spark, d):
    m = net.merge_parallel(lines(spark, d), "a", "b", "x", "r", "cap")
    return m.select("from_node", "to_node", "circuits", r("x", 8).alias("x"), r("r", 8).alias("r"), r("capacity").alias("capacity"))


@query(f"WITH {LINES}, e AS (SELECT a AS node FROM ln UNION ALL SELECT b FROM ln) SELECT node, count(*) AS degree FROM e GROUP BY node")
def node_degrees(spark, d):
    return net.degrees(lines(spark, d))


@query("""WITH RECURSIVE o AS (SELECT DISTINCT o_custkey AS a, CAST(o_custkey * 7 % 100 + o_orderkey % 5 AS BIGINT) AS b FROM orders WHERE o_custkey <> o_custkey * 7 % 100 + o_orderkey % 5), e AS (SELECT a, b FROM o UNION SELECT b, a FROM o),
 reach AS (SELECT a AS node, a AS other FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.other) SELECT node, min(other) AS component FROM reach GROUP BY node""")
def components(spark, d):
    """Components of a graph of customers linked to their orders' neighbours."""
    o = b.table(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") * 7 % 100 + F.col("o_orderkey") % 5).alias("b")).where("a <> b").distinct()
    nodes = o.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return net.connected_components(o, nodes)


def merged(spark, d):
    """The whole network without parallel lines, as one network; a line's number is made of its ends."""
    m = net.merge_parallel(lines(spark, d), "a", "b", "x", "r", "cap")
    return m.select(F.lit(1).alias("net"), (F.col("from_node") * 100 + F.col("to_node")).cast("long").alias("line"), F.col("from_node").cast("long").alias("a"), F.col("to_node").cast("long").alias("b"), "x")


MERGED = f"{LINES}, mg AS (SELECT CAST(least(a, b) AS BIGINT) AS a, CAST(greatest(a, b) AS BIGINT) AS b, CAST(least(a, b) * 100 + greatest(a, b) AS BIGINT) AS line, 1 / sum(1 / x) AS x FROM ln GROUP BY 1, 2, 3)"


@query()
def ptdf_lodf(spark, d):
    """Outage factors of the whole merged network, solved in a task; ``lodf_balance`` and ``lodf_loops`` hold them against SQL."""
    return se.outage_factors(merged(spark, d), "net").select("line", "outage", "lodf")


@query(f"""WITH {MERGED}, n AS (SELECT a AS node FROM mg UNION SELECT b FROM mg) SELECT line AS outage, node, CAST(CASE WHEN node = a THEN 1 WHEN node = b THEN -1 ELSE 0 END AS DOUBLE) AS taken FROM mg, n""")
def lodf_balance(spark, d):
    """What the other lines carry away from each bus after a loss: one unit at the lost line's beginning, none between, one less at its end."""
    m = merged(spark, d)
    f = se.outage_factors(m, "net").where("line <> outage").join(m.select("line", "a", "b"), "line")
    ends = f.select("outage", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("lodf").alias("v")), F.struct(F.col("b").alias("node"), (-F.col("lodf")).alias("v")))).alias("s"))
    return ends.groupBy("outage", F.col("s.node").alias("node")).agg((F.round(F.sum("s.v"), 6) + 0.0).alias("taken"))


TRIANGLES = "t AS (SELECT p.a AS a, p.b AS b, q.b AS c, p.line AS l1, q.line AS l2, r.line AS l3 FROM mg p JOIN mg q ON q.a = p.b JOIN mg r ON r.a = p.a AND r.b = q.b)"


@query(f"WITH {MERGED}, {TRIANGLES} SELECT mg.line AS outage, count(*) AS loops, CAST(0 AS DOUBLE) AS worst FROM mg, t WHERE mg.line NOT IN (l1, l2, l3) GROUP BY 1")
def lodf_loops(spark, d):
    """Around every triangle that keeps its lines, the angles of what is moved cancel."""
    m = merged(spark, d)
    f = se.outage_factors(m, "net").join(m.select("line", "a", "b", "x"), "line").withColumn("v", F.col("lodf") * F.col("x"))
    side = lambda i, a, c: f.select("outage", F.col("a").alias(a), F.col("b").alias(c), F.col("v").alias(f"v{i}"), F.col("line").alias(f"l{i}"))
    loops = side(1, "p", "q").join(side(2, "q", "r"), ["outage", "q"]).join(side(3, "p", "r"), ["outage", "p", "r"]).where("outage NOT IN (l1, l2, l3)")
    return loops.groupBy("outage").agg(F.count("*").alias("loops"), F.round(F.max(F.abs(F.col("v1") + F.col("v2") - F.col("v3"))), 6).alias("worst"))


def numbered_meshes(spark, d):
    """A network for each line number of orders; a node's injection grows with its number."""
    x = b.table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_discount", F.col("l_linenumber").alias("net"))
    s = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a"))
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 25).alias("b"))
    j = x.join(s, "l_suppkey").join(p, "l_partkey").where("a <> b").select("net", F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"), (0.1 + F.col("l_discount")).alias("x"))
    lines_ = j.groupBy("net", "a", "b").agg((1 / F.sum(1 / F.col("x"))).alias("x")).withColumn("line", F.col("a") * 100 + F.col("b"))
    nodes_ = lines_.select("net", F.explode(F.array("a", "b")).alias("bus")).distinct()
    mean = nodes_.groupBy("net").agg(F.avg("bus").alias("_m"))
    return lines_, nodes_.join(mean, "net").select("net", "bus", ((F.col("bus") - F.col("_m")) * 10).alias("mw"))


MESHES = """ms AS (SELECT l_linenumber AS net, least(s_nationkey, p_size % 25) AS a, greatest(s_nationkey, p_size % 25) AS b, 1 / sum(1 / (0.1 + l_discount)) AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE s_nationkey <> p_size % 25 GROUP BY 1, 2, 3),
 nd AS (SELECT net, CAST(a AS BIGINT) AS bus FROM ms UNION SELECT net, CAST(b AS BIGINT) FROM ms)"""


@query(f"WITH {MESHES} SELECT net, bus, round((bus - avg(bus) OVER (PARTITION BY net)) * 10, 5) AS mw FROM nd")
def mesh_balance(spark, d):
    """What flows away from each bus of the meshes is what is injected there."""
    ln, inj = numbered_meshes(spark, d)
    f = se.mesh_flows(ln, inj, "net").join(ln.select("net", "line", "a", "b"), ["net", "line"])
    ends = f.select("net", F.explode(F.array(F.struct(F.col("a").alias("bus"), F.col("flow").alias("v")), F.struct(F.col("b").alias("bus"), (-F.col("flow")).alias("v")))).alias("s"))
    return ends.groupBy("net", F.col("s.bus").alias("bus")).agg((F.round(F.sum("s.v"), 5) + 0.0).alias("mw"))


@query(f"WITH {MESHES} SELECT p.net, count(*) AS loops, CAST(0 AS DOUBLE) AS worst FROM ms p JOIN ms q ON q.net = p.net AND q.a = p.b JOIN ms r ON r.net = p.net AND r.a = p.a AND r.b = q.b GROUP BY 1")
def mesh_loops(spark, d):
    """Around every triangle of the meshes the angles cancel."""
    ln, inj = numbered_meshes(spark, d)
    f = se.mesh_flows(ln, inj, "net").join(ln.select("net", "line", "a", "b", "x"), ["net", "line"]).withColumn("v", F.col("flow") * F.col("x"))
    side = lambda i, a, c: f.select("net", F.col("a").alias(a), F.col("b").alias(c), F.col("v").alias(f"v{i}"))
    loops = side(1, "p", "q").join(side(2, "q", "r"), ["net", "q"]).join(side(3, "p", "r"), ["net", "p", "r"])
    return loops.groupBy("net").agg(F.count("*").alias("loops"), F.round(F.max(F.abs(F.col("v1") + F.col("v2") - F.col("v3"))), 6).alias("worst"))


@query(f"WITH {UNITS}, x AS (SELECT unit, 50 + unit % 40 AS p, 400.0 + rated_mw / 10 AS h, 100.0 + unit % 7 AS dm FROM units) SELECT unit, round(p * 50.0 / (2 * h), 6) AS rocof, round(50 - p / (2 * sqrt(h * dm)), 6) AS nadir, round(50 - p / dm, 6) AS steady FROM x")
def frequency_response(spark, d):
    x = b.units(spark, d).select("unit", (50 + F.col("unit") % 40).alias("p"), (400.0 + F.col("rated_mw") / 10).alias("h"), (100.0 + F.col("unit") % 7).alias("dm"))
    return net.frequency_response(x, "p", "h", "dm").select("unit", r("rocof", 6).alias("rocof"), r("nadir", 6).alias("nadir"), r("steady", 6).alias("steady"))


@query(f"WITH {GEN}, x AS (SELECT unit, part % 50 AS outage, mw AS f FROM gen) SELECT outage AS contingency, round(sum(pow(f / 40.0, 2)), 6) AS pi FROM x GROUP BY outage HAVING sum(pow(f / 40.0, 2)) >= 1.0 ORDER BY sum(pow(f / 40.0, 2)) DESC, outage LIMIT 20")
def contingency_screen(spark, d):
    x = b.generation(spark, d).select((F.col("part") % 50).alias("contingency"), F.col("mw").alias("f"), F.lit(40.0).alias("cap"))
    return net.performance_index(x, "contingency", "f", "cap", 1.0, 20).withColumn("pi", r("pi", 6))


# Risk.


@query("WITH p AS (SELECT CAST(l_suppkey AS BIGINT) AS node, l_discount / 10 AS p FROM lineitem) SELECT node, round(1 - product(1 - p), 8) AS combined, round(avg(p), 8) AS mean, max(p) AS worst FROM p GROUP BY node")
def combine_hazards(spark, d):
    x = b.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), (F.col("l_discount") / 10).alias("p"))
    return rk.combine_independent(x, ["node"], "p").select("node", r("combined", 8).alias("combined"), r("mean", 8).alias("mean"), "worst")


@query(f"WITH {UNITS}, l AS (SELECT unit AS node, rp, rated_mw * rp / 100 AS loss FROM units, (VALUES (10.0), (50.0), (100.0), (475.0)) x(rp)), x AS (SELECT *, 1 / rp AS p, row_number() OVER w AS k, lead(1 / rp) OVER w AS nx, lag(1 / rp) OVER w AS pv FROM l WINDOW w AS (PARTITION BY node ORDER BY rp)) SELECT node, round(sum(loss * coalesce(CASE WHEN k = 1 THEN p - nx ELSE pv - p END, 0)), 4) AS eal FROM x GROUP BY node")
def eal_by_node(spark, d):
    u = b.units(spark, d).withColumn("rp", F.explode(F.array(*map(F.lit, (10.0, 50.0, 100.0, 475.0)))))
    x = u.select(F.col("unit").alias("node"), "rp", (F.col("rated_mw") * F.col("rp") / 100).alias("loss"))
    return rk.expected_annual_loss(x, ["node"], "rp", "loss").withColumn("eal", r("eal"))


@query(f"WITH {GT}, c AS (SELECT tech, year, sum(cost) AS c FROM gt GROUP BY 1, 2), x AS (SELECT *, c - min(c) OVER (PARTITION BY year) AS rg FROM c) SELECT tech, round(max(rg), 2) AS regret FROM x GROUP BY tech")
def minimax_regret(spark, d):
    c = b.generation_by_tech(spark, d).groupBy("tech", "year").agg(F.sum("cost").alias("c"))
    return rk.minimax_regret(c, "tech", "year", "c").withColumn("regret", r("regret", 2))


@query(f"WITH {UNITS}, s AS (SELECT node, rated_mw AS cap, 1.0 / count(*) OVER (PARTITION BY node) AS p FROM units) SELECT node, round(sum(CASE WHEN cap < 5000 THEN p ELSE 0 END), 6) AS lolp, round(sum(CASE WHEN cap < 5000 THEN p ELSE 0 END) * 8760, 4) AS lole, round(sum(p * greatest(0, 5000 - cap)) * 8760, 2) AS eens FROM s GROUP BY node")
def loss_of_load(spark, d):
    n = F.count("*").over(Window.partitionBy("node"))
    s = b.units(spark, d).select("node", F.col("rated_mw").alias("cap"), (1.0 / n).alias("p")).withColumn("q", F.lit(5000.0))
    return rk.loss_of_load(s, ["node"], "p", "cap", "q").select("node", r("lolp", 6).alias("lolp"), r("lole").alias("lole"), r("eens", 2).alias("eens"))


@query(f"WITH {DEMAND}, q AS (SELECT node, day, sum(mw) / 1e6 AS v, CAST(day - DATE '1995-01-01' AS INTEGER) AS t FROM demand GROUP BY node, day), x AS (SELECT node, (v + lag(v) OVER w) / 2 * (t - lag(t) OVER w) AS a, t - lag(t) OVER w AS dt FROM q WINDOW w AS (PARTITION BY node ORDER BY t)) SELECT node, round(CASE WHEN sum(dt) > 0 THEN sum(a) / sum(dt) ELSE 0 END, 6) AS resilience FROM x GROUP BY node")
def resilience_index(spark, d):
    q = b.demand(spark, d).groupBy("node", "day").agg((F.sum("mw") / 1e6).alias("v")).withColumn("t", F.datediff("day", F.lit("1995-01-01").cast("date")))
    return rk.resilience_index(q, ["node"], "t", "v").withColumn("resilience", r("resilience", 6))


@query(f"WITH {UNITS} SELECT unit, CASE WHEN rated_mw / 1e7 >= 1e-3 THEN 'unacceptable' WHEN rated_mw / 1e7 >= 1e-5 THEN 'tolerable' ELSE 'acceptable' END AS band FROM units")
def alarp_bands(spark, d):
    return b.units(spark, d).select("unit", rk.alarp(F.col("rated_mw") / 1e7).alias("band"))


@query(f"WITH {DEMAND}, a AS (SELECT node, year, max(mw) AS m FROM demand GROUP BY 1, 2) SELECT node, round(stddev_samp(m) * sqrt(6) / pi(), 2) AS scale, round(avg(m) - 0.5772156649015329 * stddev_samp(m) * sqrt(6) / pi(), 2) AS location FROM a GROUP BY node")
def gumbel_fit(spark, d):
    a = b.demand(spark, d).groupBy("node", "year").agg(F.max("mw").alias("m"))
    return rk.gumbel_moments(a, ["node"], "m").select("node", r("scale", 2).alias("scale"), r("location", 2).alias("location"))


# Estimation and text.


@query(f"WITH {GT}, a AS (SELECT brand, sum(mw) AS m, sum(cost) AS c FROM gt GROUP BY brand), s AS (SELECT m / sum(m) OVER () AS pm, c / sum(c) OVER () AS pc FROM a), e AS (SELECT 1 + sum(pm * ln(pm)) / ln(count(*)) AS dm, 1 + sum(pc * ln(pc)) / ln(count(*)) AS dc FROM s) SELECT 'm' AS criterion, round(dm / (dm + dc), 6) AS weight FROM e UNION ALL SELECT 'c', round(dc / (dm + dc), 6) FROM e")
def entropy_weights(spark, d):
    a = b.generation_by_tech(spark, d).groupBy("brand").agg(F.sum("mw").alias("m"), F.sum("cost").alias("c"))
    return dem.entropy_weights(a, ["m", "c"]).withColumn("weight", r("weight", 6))


@query("SELECT CAST(floor(((value + 11.25) % 360) / 22.5) AS INTEGER) AS sector, count(*) AS n, round(avg(value), 4) AS mean_speed, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS frequency FROM events GROUP BY 1")
def wind_rose(spark, d):
    return dem.wind_rose(b.series(spark, d), "value", "value").select("sector", "n", r("mean_speed").alias("mean_speed"), r("frequency", 6).alias("frequency"))


@query("SELECT event_id AS event, round(CASE WHEN v < 3 THEN 0 WHEN v <= 3 THEN 0 WHEN v <= 12 THEN (v - 3) / 9 WHEN v <= 25 THEN 1 ELSE 0 END, 6) AS cf FROM (SELECT event_id, value / 10 AS v FROM events)")
def wind_power_curve(spark, d):
    return b.series(spark, d).select("event", r(sc.wind_capacity_factor(F.col("value") / 10, [3, 12, 25], [0.0, 1.0, 1.0]), 6).alias("cf"))


@query("SELECT p_partkey AS part, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name, CASE WHEN p_size < 10 AND p_size % 3 + 1 <= 2 THEN 'residential' WHEN p_size * 40 < 1000 THEN 'commercial' WHEN p_size * 40 < 5000 THEN 'institutional' ELSE 'industrial' END AS class FROM (SELECT * FROM part)")
def building_classes(spark, d):
    p = b.table(spark, d, "part")
    area = F.when(F.col("p_size") < 10, F.lit(100)).otherwise(F.col("p_size") * 40)
    cls = dem.classify_building(area, F.when(F.col("p_size") < 10, F.col("p_size") % 3 + 1).otherwise(3))
    return p.select(F.col("p_partkey").alias("part"), sc.plain_name(F.col("p_name")).alias("name"), cls.alias("class"))


@query(f"WITH {DEMAND}, q AS (SELECT node, CAST(day - DATE '1995-01-01' AS INTEGER) AS t, sum(mw) AS o FROM demand GROUP BY 1, 2), s AS (SELECT node, z AS size, floor(t / z) AS k, avg(o) AS o, avg(o * 0.9 + 1000) AS f FROM q, (VALUES (1), (7), (30)) x(z) GROUP BY 1, 2, 3) SELECT node, CAST(size AS INTEGER) AS size, round(sqrt(avg((f - o) * (f - o))), 2) AS rmse, round(avg(abs(f - o)), 2) AS mae FROM s GROUP BY 1, 2")
def resolution_metrics(spark, d):
    q = b.demand(spark, d).groupBy("node", F.datediff("day", F.lit("1995-01-01").cast("date")).alias("t")).agg(F.sum("mw").alias("o")).withColumn("f", F.col("o") * 0.9 + 1000)
    return dem.resolution_metrics(q, ["node"], "t", "o", "f", [1, 7, 30]).select("node", "size", r("rmse", 2).alias("rmse"), r("mae", 2).alias("mae"))


@query()
def kmeans_medoids(spark, d):
    """Medoids of the decision vectors; rows only."""
    return dem.kmeans_medoids(b.table(spark, d, "embeddings"), "vec_id", "embedding", 8)


@query()
def tsam_day_clusters(spark, d):
    """Typical days of each category; rows only."""
    s = b.series(spark, d).groupBy("category", F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.sum("value").alias("v"))
    return dem.typical_days(s, ["category"], "day", "hour", "v", 5)
