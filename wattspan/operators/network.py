"""Networks: merging and pruning of lines, components, power-flow sensitivities, outage screening, frequency."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspan.operators.metrics import ratio
from wattspan.operators.stored import stored
from wattspan.operators.trees import hanging_edges


def _checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the folder that the session names."""
    return stored(df, "network")


def merge_parallel(lines: DataFrame, a: str, b: str, x: str, r: str, cap: str) -> DataFrame:
    """One line for all between the same ends: ``x = 1 / sum(1/x)``, resistance by squared shares of flow,
    capacity where the first line reaches its own."""
    ends = [F.least(a, b).alias("from_node"), F.greatest(a, b).alias("to_node")]
    w = Window.partitionBy("from_node", "to_node")
    shares = lines.select(*ends, F.col(x).alias("_x"), F.col(r).alias("_r"), F.col(cap).alias("_c")).withColumn("_s", (1 / F.col("_x")) / F.sum(1 / F.col("_x")).over(w))
    return shares.groupBy("from_node", "to_node").agg(F.count("*").alias("circuits"), (1 / F.sum(1 / F.col("_x"))).alias("x"), F.sum(F.col("_r") * F.col("_s") * F.col("_s")).alias("r"), F.min(F.col("_c") / F.col("_s")).alias("capacity"))


def degrees(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return edges.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def prune_leaves(edges: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Edges ``a, b`` without the trees that hang on the network; protected nodes (``node``) stay, and what leads to them.
    Parallel edges and loops are cycles. Rounds grow with the logarithm of the network, not with a feeder's length."""
    numbered = stored(edges.withColumn("_id", F.monotonically_increasing_id()), "pruned")
    hanging = hanging_edges(numbered.select(F.col("_id").alias("id"), "a", "b"), protected)
    return numbered.join(hanging.withColumnRenamed("id", "_id"), "_id", "left_anti").drop("_id")


def series_chains(edges: DataFrame, a: str, b: str, x: str, cap: str, protected: DataFrame | None = None) -> DataFrame:
    """Contract nodes of degree two: reactances add, the least capacity holds. A round contracts nodes whose
    neighbours are not contracted in the same round, those of least hash first, until nothing changes."""
    order = lambda c: F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("id"))
    e = _checkpointed(edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(x).alias("x"), F.col(cap).alias("cap")))
    while True:
        both = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "x", "cap"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "x", "cap"))).alias("s")).select("s.*")
        two = both.groupBy("node").agg(F.count("*").alias("n"), F.min("other").alias("p"), F.max("other").alias("q"), F.sum("x").alias("x"), F.min("cap").alias("cap")).where("n = 2 AND p <> q AND p <> node AND q <> node")
        if protected is not None:
            two = two.join(protected, "node", "left_anti")
        two = _checkpointed(two)
        near = both.join(two.select(F.col("node").alias("other"), F.lit(1).alias("hit")), "other").groupBy("node").agg(F.min(order("other")).alias("least"))
        chosen = _checkpointed(two.join(near, "node", "left").where(F.col("least").isNull() | (order("node") < F.col("least"))))
        if chosen.isEmpty():
            break
        gone = chosen.select("node")
        rest = e.join(gone, e["a"] == gone["node"], "left_anti").join(gone.withColumnRenamed("node", "n2"), F.col("b") == F.col("n2"), "left_anti")
        e = _checkpointed(rest.unionByName(chosen.select(F.col("p").alias("a"), F.col("q").alias("b"), "x", "cap")))
    return e


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, component`` (least node), by alternating large and small stars until nothing changes.

    A large star hooks each larger neighbour to the least neighbour of its other end, a small star hooks a
    node's smaller neighbours, and itself, to the least of them; every edge then leads to its component's
    least node. Rounds grow with the logarithm of a component's size, not with its diameter.
    """
    kind = dict(nodes.dtypes)["node"]
    known = nodes.select("node").distinct()
    ends = edges.select(F.greatest("a", "b").cast(kind).alias("a"), F.least("a", "b").cast(kind).alias("b")).where("a <> b").distinct()
    e = _checkpointed(ends.join(known.select(F.col("node").alias("a")), "a", "left_semi").join(known.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b"))
    before = None
    while True:
        least = _least_neighbour(e)
        large = _checkpointed(e.join(least, e["b"] == least["node"], "left").select("a", F.coalesce("least", "b").alias("b")).distinct())
        least = _least_neighbour(large)
        hooked = large.join(least, large["a"] == least["node"])
        pair = F.when(F.col("b") == F.col("least"), F.struct("a", F.col("least").alias("b"))).otherwise(F.struct(F.col("b").alias("a"), F.col("least").alias("b")))
        e = _checkpointed(hooked.select(pair.alias("e")).select("e.a", "e.b").distinct())
        after = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
    roots = e.select(F.col("a").alias("_a"), F.col("b").alias("_root"))
    return known.join(roots, known["node"] == roots["_a"], "left").select("node", F.coalesce("_root", "node").alias("component"))


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """The least smaller neighbour of each larger end."""
    return _checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")))


def drop_isolated(edges: DataFrame, components: DataFrame, least: int) -> DataFrame:
    """Edges of components with at least ``least`` nodes."""
    big = components.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    keep = components.join(big, "component").select("node")
    return edges.join(keep, edges["a"] == keep["node"], "left_semi")


def ptdf(nodes: list, lines: list[tuple], slack: int = 0) -> np.ndarray:
    """Flow on each line by injection at each node, taken out at the slack. Lines are (from, to, reactance)."""
    at = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(lines), len(nodes)))
    y = np.array([1.0 / x for _, _, x in lines])
    for k, (a, b, _) in enumerate(lines):
        m[k, at[a]], m[k, at[b]] = 1, -1
    keep = [i for i in range(len(nodes)) if i != slack]
    laplacian = (m.T * y) @ m
    out = np.zeros_like(m)
    out[:, keep] = (m[:, keep] * y[:, None]) @ np.linalg.inv(laplacian[np.ix_(keep, keep)])
    return out


def lodf(factors: np.ndarray, nodes: list, lines: list[tuple]) -> np.ndarray:
    """Share of line k's flow that line l takes when k is out; -1 on the diagonal, NaN for a cut."""
    at = {n: i for i, n in enumerate(nodes)}
    across = np.stack([factors[:, at[a]] - factors[:, at[b]] for a, b, _ in lines], axis=1)
    own = 1 - np.diag(across)
    out = np.full_like(across, np.nan)
    fine = np.abs(own) >= 1e-12
    out[:, fine] = across[:, fine] / own[fine]
    np.fill_diagonal(out, -1.0)
    return out


def outage_flows(flows: DataFrame, factors: DataFrame) -> DataFrame:
    """Flow on ``line`` after the loss of ``outage``: own flow plus factor times the lost line's flow."""
    lost = flows.select(F.col("line").alias("outage"), F.col("flow").alias("_lost"))
    return factors.join(flows, "line").join(lost, "outage").where("line <> outage").withColumn("post", F.col("flow") + F.col("lodf") * F.col("_lost"))


def performance_index(post: DataFrame, key: str, flow: str, cap: str, threshold: float, most: int) -> DataFrame:
    """Contingencies by the sum of squared loadings, those at or above the threshold, the worst first."""
    pi = post.groupBy(key).agg(F.sum(F.pow(F.col(flow) / F.col(cap), 2)).alias("pi"))
    return pi.where(F.col("pi") >= threshold).orderBy(F.desc("pi"), key).limit(most)


def redistribute_loss(gens: DataFrame, keys: list[str], unit: str, out: str, rated: str, lost_mw: str, weight: Column) -> DataFrame:
    """Output after a loss, dealt by weight and clamped to headroom; what remains goes in order of units,
    and what no headroom takes is shed."""
    w = Window.partitionBy(*keys)
    head = F.greatest(F.lit(0.0), F.col(rated) - F.col(out))
    g = gens.withColumn("_h", head).withColumn("_w", F.when(F.col("_h") > 0, weight).otherwise(0.0))
    first = F.least(F.col("_h"), ratio(F.col("_w"), F.sum("_w").over(w)) * F.least(F.col(lost_mw), F.sum("_h").over(w)))
    g = g.withColumn("_f", first).withColumn("_room", F.col("_h") - F.col("_f")).withColumn("_left", F.least(F.col(lost_mw), F.sum("_h").over(w)) - F.sum("_f").over(w))
    before = F.coalesce(F.sum("_room").over(w.orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    more = F.least(F.col("_room"), F.greatest(F.lit(0.0), F.col("_left") - before))
    shed = F.greatest(F.lit(0.0), F.col(lost_mw) - F.sum("_h").over(w))
    return g.withColumn("pickup", F.col("_f") + more).withColumn("shed", shed).drop("_h", "_w", "_f", "_room", "_left")


def frequency_response(df: DataFrame, loss: str, inertia: str, damping: str, nominal: float = 50.0) -> DataFrame:
    """Rate of change, nadir and settled frequency after a loss of power."""
    p, h, d = F.col(loss), F.col(inertia), F.col(damping)
    return df.withColumn("rocof", p * nominal / (2 * h)).withColumn("nadir", nominal - p / (2 * F.sqrt(h * d))).withColumn("steady", nominal - p / d)


def severity(overload_pct: Column, shed: Column, demand: Column, nadir: Column, nadir_limit: float, rocof: Column, rocof_limit: float, voltage: Column) -> Column:
    under = 20 * F.greatest(F.lit(0.0), nadir_limit - nadir)
    fast = F.when(F.abs(rocof) > rocof_limit, 10 * F.abs(F.abs(rocof) - rocof_limit)).otherwise(0.0)
    return overload_pct + 100 * ratio(shed, demand) + under + fast + 100 * voltage


def bridges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges whose loss parts their component; depth-first, one component a task."""

    def find(p: pd.DataFrame) -> pd.DataFrame:
        adj: dict = {}
        for k, (a, b) in enumerate(zip(p["a"], p["b"], strict=True)):
            adj.setdefault(a, []).append((b, k))
            adj.setdefault(b, []).append((a, k))
        order: dict = {}
        low: dict = {}
        found: list[int] = []
        for root in adj:
            if root in order:
                continue
            order[root] = low[root] = len(order)
            stack = [(root, -1, iter(adj[root]))]
            while stack:
                u, via, it = stack[-1]
                for v, k in it:
                    if k == via:
                        continue
                    if v in order:
                        low[u] = min(low[u], order[v])
                    else:
                        order[v] = low[v] = len(order)
                        stack.append((v, k, iter(adj[v])))
                        break
                else:
                    stack.pop()
                    if stack:
                        p0 = stack[-1][0]
                        low[p0] = min(low[p0], low[u])
                        if low[u] > order[p0]:
                            found.append(via)
        return p.iloc[found][["a", "b"]]

    labelled = edges.join(components, edges["a"] == components["node"]).select("a", "b", "component")
    kind = dict(edges.dtypes)["a"]
    return labelled.groupBy("component").applyInPandas(find, f"a {kind}, b {kind}")


def max_flow(p: pd.DataFrame, source, sink) -> float:
    """Greatest flow between two nodes of directed edges ``a, b, cap`` (shortest augmenting paths)."""
    cap: dict = {}
    adj: dict = {}
    for a, b, c in p[["a", "b", "cap"]].itertuples(index=False):
        cap[a, b] = cap.get((a, b), 0.0) + c
        cap.setdefault((b, a), 0.0)
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    total = 0.0
    while True:
        back = {source: None}
        queue = [source]
        for u in queue:
            for v in adj.get(u, ()):
                if v not in back and cap[u, v] > 1e-9:
                    back[v] = u
                    queue.append(v)
        if sink not in back:
            return total
        path, v = [], sink
        while back[v] is not None:
            path.append((back[v], v))
            v = back[v]
        push = min(cap[e] for e in path)
        for a, b in path:
            cap[a, b] -= push
            cap[b, a] += push
        total += push
