"""Outages: the list of what may fail, DC flows after one or two losses, and counts of what is secure.

Flows of a network are solved in one task, many networks or snapshots at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattspan.operators.quantiles import PLACE_BITS
from wattspan.operators.stored import stored


def contingency_list(generators: DataFrame, lines: DataFrame, batteries: DataFrame, least_flow_pct: float = 0.0) -> DataFrame:
    """kind, element, impact, rank: running generators (element, output, status), lines (element, flow, cap) with enough flow,
    batteries that give more than they take (element, discharge, charge); the greatest impact first."""
    gens = generators.where("status > 0 AND output > 0.1").select(F.lit("generator").alias("kind"), "element", F.col("output").alias("impact"))
    loaded = (F.col("cap") <= 0) | (F.abs("flow") / F.col("cap") * 100 >= least_flow_pct)
    wires = lines.where(loaded).select(F.lit("line").alias("kind"), "element", F.abs("flow").alias("impact"))
    net = F.col("discharge") - F.col("charge")
    cells = batteries.where(net > 0.1).select(F.lit("battery").alias("kind"), "element", net.alias("impact"))
    every = gens.unionByName(wires).unionByName(cells)
    # Ranks by ranges of impact, so that no task sorts all elements.
    order = [F.desc("impact"), F.col("kind"), F.col("element")]
    placed = stored(every.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "contingencies").withColumn("_part", F.shiftright("_at", PLACE_BITS))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return ranked.withColumn("rank", (F.col("_before") + F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1) + 1).cast("int")).drop("_at", "_part", "_before")


def dc_flows(ends: np.ndarray, x: np.ndarray, injection: np.ndarray) -> np.ndarray:
    """Flows of lines between numbered buses; NaN on islands whose injections do not balance."""
    n = len(injection)
    label = np.arange(n)
    while True:  # components by least labels
        low = np.minimum(label[ends[:, 0]], label[ends[:, 1]]) if len(ends) else np.zeros(0, int)
        new = label.copy()
        np.minimum.at(new, ends[:, 0], low)
        np.minimum.at(new, ends[:, 1], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    angle = np.zeros(n)
    for root in np.unique(label):
        own = np.flatnonzero(label == root)
        if abs(injection[own].sum()) > 1e-6 * max(1.0, np.abs(injection[own]).max()):
            angle[own] = np.nan
            continue
        if len(own) == 1:
            continue
        at = np.full(n, -1)
        at[own] = np.arange(len(own))
        inside = label[ends[:, 0]] == root
        a, b, y = at[ends[inside, 0]], at[ends[inside, 1]], 1 / x[inside]
        lap = np.zeros((len(own), len(own)))
        np.add.at(lap, (a, a), y)
        np.add.at(lap, (b, b), y)
        np.add.at(lap, (a, b), -y)
        np.add.at(lap, (b, a), -y)
        angle[own[1:]] = np.linalg.solve(lap[1:, 1:], injection[own[1:]])
    return (angle[ends[:, 0]] - angle[ends[:, 1]]) / x if len(ends) else np.zeros(0)


class Factored:
    """A network solved once: flows by its injections, and ``across[l, m]``, the flow on l by one unit sent along m's ends.

    Each island is factored by itself; where its injections do not balance, flows are NaN.
    """

    def __init__(self, ends: np.ndarray, x: np.ndarray, injection: np.ndarray):
        self.ends, self.x, self.injection = ends, x, injection
        self.flow = dc_flows(ends, x, injection)
        n, a, b, y = len(injection), ends[:, 0], ends[:, 1], 1 / x
        lap = np.zeros((n, n))
        for i, j, v in ((a, a, y), (b, b, y), (a, b, -y), (b, a, -y)):
            np.add.at(lap, (i, j), v)
        # One bus of each island is the reference: the least that a walk along the lines reaches.
        label = np.arange(n)
        while True:
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            new = new[new]
            if (new == label).all():
                break
            label = new
        inner = np.flatnonzero(label != np.arange(n))
        angle = np.zeros((n, n))
        angle[np.ix_(inner, inner)] = np.linalg.inv(lap[np.ix_(inner, inner)])
        sent = angle[:, a] - angle[:, b]
        self.across = (sent[a] - sent[b]) / x[:, None]

    def after(self, lost: list[int]) -> np.ndarray:
        """Flows without one or two lines, by an update of that rank; solved anew only where their loss parts an island."""
        keep = np.setdiff1d(np.arange(len(self.x)), lost)
        own = np.eye(len(lost)) - self.across[np.ix_(lost, lost)]
        if abs(np.linalg.det(own)) < 1e-9:
            return dc_flows(self.ends[keep], self.x[keep], self.injection)
        along = self.across[np.ix_(keep, lost)]
        moved = np.where(np.abs(along).max(axis=1) < 1e-12, 0.0, along @ np.linalg.solve(own, self.flow[lost]))
        return self.flow[keep] + moved


def mesh_flows(lines: DataFrame, injections: DataFrame, key: str) -> DataFrame:
    """``key, line, flow`` of many networks, one a task: ``lines`` (key, line, a, b, x) and ``injections`` (key, bus, mw)."""
    return _solved(lines, injections, key, "flow double", lambda net, names: pd.DataFrame({"line": names, "flow": net.flow}))


def outage_factors(lines: DataFrame, key: str) -> DataFrame:
    """``key, line, outage, lodf``: the share of the lost line's flow that each other line takes, -1 for itself and null where
    the loss parts an island. A network is factored once and is one task."""
    none = lines.select(key, F.col("a").alias("bus"), F.lit(0.0).alias("mw")).distinct()

    def factors(net: Factored, names: np.ndarray) -> pd.DataFrame:
        own = 1 - np.diag(net.across)
        with np.errstate(divide="ignore", invalid="ignore"):
            f = np.where(np.abs(own)[None, :] < 1e-9, np.nan, net.across / own[None, :])
        np.fill_diagonal(f, -1.0)
        n = len(names)
        return pd.DataFrame({"line": np.repeat(names, n), "outage": np.tile(names, n), "lodf": f.ravel()})

    out = _solved(lines, none, key, "outage long, lodf double", factors)
    return out.withColumn("lodf", F.nanvl("lodf", F.lit(None).cast("double")))


def _solved(lines: DataFrame, injections: DataFrame, key: str, columns: str, use) -> DataFrame:
    given = injections.groupBy(key).agg(F.collect_list(F.struct("bus", "mw")).alias("_mw"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("line", ignore_index=True)
        mw = {r["bus"]: r["mw"] for r in p["_mw"].iloc[0]}
        buses = sorted({*p["a"], *p["b"], *mw})
        at = {n: i for i, n in enumerate(buses)}
        ends = np.array([[at[a], at[b]] for a, b in zip(p["a"], p["b"], strict=True)])
        rows = use(Factored(ends, p["x"].to_numpy(float), np.array([float(mw.get(n, 0.0)) for n in buses])), p["line"].to_numpy())
        rows.insert(0, key, p[key].iloc[0])
        return rows

    return lines.join(given, key).groupBy(key).applyInPandas(run, f"{key} {dict(lines.dtypes)[key]}, line {dict(lines.dtypes)['line']}, {columns}")


def line_losses(lines: DataFrame, injections: DataFrame, key: str, double: bool = False, stressed_pct: float = 0.0) -> DataFrame:
    """key, outage, second, line, flow, overload_pct for the loss of each line and, if ``double``, of each further line that is loaded to
    ``stressed_pct`` after it. ``lines``: key, line, a, b, x, cap; ``injections``: key, bus, mw. Flow is null where an island does not
    balance; overload is 0 within the capacity.
    """
    kind = dict(lines.dtypes)[key]
    given = injections.groupBy(key).agg(F.collect_list(F.struct("bus", "mw")).alias("_mw"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("line", ignore_index=True)
        mw = {r["bus"]: r["mw"] for r in p["_mw"].iloc[0]}
        buses = sorted({*p["a"], *p["b"], *mw})
        at = {n: i for i, n in enumerate(buses)}
        inj = np.array([float(mw.get(n, 0.0)) for n in buses])
        ends = np.array([[at[a], at[b]] for a, b in zip(p["a"], p["b"], strict=True)])
        x, cap, names = p["x"].to_numpy(float), p["cap"].to_numpy(float), p["line"].to_numpy()
        out = []
        net = Factored(ends, x, inj)

        def after(lost: list[int], second) -> np.ndarray:
            keep = np.setdiff1d(np.arange(len(names)), lost)
            flow = net.after(lost)
            over = np.where((cap[keep] > 0) & (np.abs(flow) > cap[keep]), (np.abs(flow) / cap[keep] - 1) * 100, 0.0)
            out.append((names[lost[0]], second, names[keep], flow, over))
            whole = np.zeros(len(names))
            whole[keep] = np.abs(flow) / cap[keep] * 100
            return whole

        for k in range(len(names)):
            loading = after([k], None)
            if double:
                for j in np.flatnonzero(loading >= stressed_pct):
                    if j != k:
                        after([k, int(j)], names[j])
        sizes = [len(o[2]) for o in out]
        spread = lambda i, kind: pd.array(np.repeat(np.array([o[i] for o in out], dtype=object), sizes), dtype=kind)
        joined_ = lambda i: np.concatenate([o[i] for o in out])
        rows = pd.DataFrame({"outage": spread(0, "int64"), "second": spread(1, "Int64"), "line": joined_(2), "flow": joined_(3), "overload_pct": joined_(4)})
        if double:
            rows = rows[rows["second"].notna()]
        rows.insert(0, key, p[key].iloc[0])
        return rows

    joined = lines.join(given, key)
    out = joined.groupBy(key).applyInPandas(run, f"{key} {kind}, outage long, second long, line long, flow double, overload_pct double")
    return out.withColumn("flow", F.nanvl("flow", F.lit(None).cast("double"))).withColumn("overload_pct", F.nanvl("overload_pct", F.lit(None).cast("double")))


def worst_pairs(double: DataFrame, key: str, most: int) -> DataFrame:
    """Pairs of losses by the greatest overload that follows, the worst ``most`` of each network."""
    pairs = double.groupBy(key, "outage", "second").agg(F.max("overload_pct").alias("overload_pct"))
    w = Window.partitionBy(key).orderBy(F.desc("overload_pct"), "outage", "second")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def security_summary(assessed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of a table of assessments: element, thermal, frequency, voltage (booleans), score."""
    bad = F.col("thermal") | F.col("frequency") | F.col("voltage")
    count = lambda c: F.sum(c.cast("long"))
    return assessed.groupBy(*keys).agg(
        F.count("*").alias("contingencies"), count(~bad).alias("secure"), count(bad).alias("insecure"), count(F.col("thermal")).alias("thermal"),
        count(F.col("frequency")).alias("frequency"), count(F.col("voltage")).alias("voltage"),
        F.max_by("element", F.struct("score", -F.col("element"))).alias("worst"), F.max("score").alias("worst_score"),
    )
