"""Queries over the bound tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Common table expressions of the SQL side, as the bindings define the tables.
GEN = "gen AS (SELECT l_suppkey AS unit, l_partkey AS part, CAST(l_shipdate AS DATE) AS day, CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity AS mw, l_extendedprice / l_quantity AS price, l_extendedprice AS revenue, l_extendedprice * (1 - l_discount) AS cost, l_orderkey AS order_key, l_linenumber AS line FROM lineitem)"
TECH = "tech AS (SELECT p_partkey AS part, p_type AS tech, p_brand AS brand, p_type IN ('ECONOMY', 'MEDIUM', 'SMALL') AS renewable FROM part)"
GT = f"{GEN}, {TECH}, gt AS (SELECT gen.*, tech, brand, renewable FROM gen JOIN tech USING (part))"
UNITS = "units AS (SELECT s_suppkey AS unit, s_name AS unit_name, s_nationkey AS node, abs(s_acctbal) + 1 AS rated_mw FROM supplier)"
DEMAND = "demand AS (SELECT c_nationkey AS node, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS mw, o_orderkey AS order_key FROM orders JOIN customer ON o_custkey = c_custkey)"
SERIES = "series AS (SELECT event_id AS event, user_id AS entity, event_type AS category, ts, CAST((dayofyear(ts) - 1) * 24 + hour(ts) AS INTEGER) AS hour, value FROM events)"
NODES = "nodes AS (SELECT n_nationkey AS node, n_name AS node_name, n_regionkey AS system FROM nation)"


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = fn
        if sql:
            ORACLE_SQL[key] = sql
        return fn

    return add


def r(x: Column | str, digits: int = 4) -> Column:
    """Rounded, so that the order of a sum does not show."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits)
