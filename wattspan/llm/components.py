"""Connected components of a graph too large for one machine: alternating large and small stars.

Edges lie in a table, larger end first. A large star hooks each larger neighbour to the least neighbour
of its other end, a small star hooks a node's smaller neighbours, and itself, to the least of them, until
nothing changes; every edge then leads to the least node of its component. Steps are partial minima and
equi-joins of stored tables: a hub with any number of edges is one row a task in the minimum, and Spark
splits it in the join. Lineage is cut by writing each step to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.llm.common import drop_path, materialise


def _least(edges: DataFrame) -> tuple[DataFrame, str]:
    return materialise(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")), "least")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root`` for every node that has a link and is not the least of its component.

    Nodes that are missing are their own roots. Null ends and self-links are ignored; direction and
    repeats do not matter.
    """
    ends = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).isNull().alias("na"), F.col(b).isNull().alias("nb"))
    edges, path = materialise(ends.where("NOT na AND NOT nb AND a <> b").select("a", "b").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        least, p1 = _least(edges)
        large = edges.join(least, edges["b"] == least["node"], "left").select("a", F.coalesce("least", "b").alias("b")).distinct()
        large, p2 = materialise(large, "edges")
        least, p3 = _least(large)
        joined = large.join(least, large["a"] == least["node"])
        pair = F.when(F.col("b") == F.col("least"), F.array(F.struct("a", F.col("least").alias("b")))).otherwise(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b"))))
        small, p4 = materialise(joined.select(F.explode(pair).alias("e")).select("e.a", "e.b").distinct(), "edges")
        drop_path(edges.sparkSession, path, p1, p2, p3)
        edges, path = small, p4
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
