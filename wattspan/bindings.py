"""Canonical energy tables over the available tables, fixed once.

=====================  ==========================================================================
energy concept         source
=====================  ==========================================================================
system, node           region, nation
unit                   supplier; node is its nation, capacity ``abs(s_acctbal) + 1``
technology             ``part.p_type``; ECONOMY, MEDIUM and SMALL are renewable
generation             lineitem: unit, shipping day, MW = quantity, price = extended price / quantity
demand                 orders of customers: the customer's nation, order day, MW = total price
hourly series          events: user, time, type, value
decision vectors       embeddings
=====================  ==========================================================================

Every table is a projection of a scan or one join, so filters and column pruning reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RENEWABLE = ("ECONOMY", "MEDIUM", "SMALL")
#: T CO2 per MWh and $ per MWh by technology.
CO2_FACTOR = {"LARGE": 0.9, "PROMO": 0.4, "STANDARD": 0.6}
FUEL_COST = {"ECONOMY": 0.0, "MEDIUM": 0.0, "SMALL": 0.0, "LARGE": 25.0, "PROMO": 45.0, "STANDARD": 35.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("node_name"), F.col("n_regionkey").alias("system"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("unit"), F.col("s_name").alias("unit_name"), F.col("s_nationkey").alias("node"), (F.abs("s_acctbal") + 1).alias("rated_mw"))


def generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, part, day, year, mw, price, cost, hour_key (a stable number of the row)."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_suppkey").alias("unit"),
        F.col("l_partkey").alias("part"),
        F.to_date("l_shipdate").alias("day"),
        F.year("l_shipdate").alias("year"),
        F.col("l_quantity").alias("mw"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_extendedprice").alias("revenue"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cost"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line"),
    )


def technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("part"), F.col("p_type").alias("tech"), F.col("p_brand").alias("brand"), F.col("p_type").isin(*RENEWABLE).alias("renewable"))


def generation_by_tech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation with technology. Sides are joined as Spark sees fit: a dimension is broadcast while it is small."""
    return generation(spark, sf_dir).join(technologies(spark, sf_dir), "part")


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, day, year, mw, order_key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("mw"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("node"))
    return o.join(c, "cust").select("node", "day", "year", "mw", "order_key")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, entity, category, ts (without time zone), hour (of the series), value."""
    e = table(spark, sf_dir, "events")
    hour = (F.dayofyear("ts") - 1) * 24 + F.hour("ts")
    return e.select(F.col("event_id").alias("event"), F.col("user_id").alias("entity"), F.col("event_type").alias("category"), "ts", hour.alias("hour"), "value")
