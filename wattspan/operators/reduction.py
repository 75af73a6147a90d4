"""Reduction of networks that keeps flows and angles of what stays, and expansion of results.

A network is reduced in one task, many networks at once: parallel lines are merged, trees are cut, chains are
contracted and, if asked for, stars of three legs become triangles, over and over until nothing changes. What is
recorded on the way are the weights by which results on the reduced network give those on the original.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Network:
    """Edges by number: ends, reactance, capacity, and the original lines' shares of the edge's flow."""

    def __init__(self, lines: Iterator[tuple], protected: set):
        self.edges: dict[int, tuple] = {}
        self.at: dict = {}
        self.protected = protected
        self.removed: list[tuple] = []  # bus and weights of the buses that give its value
        self.next = 0
        for line, a, b, x, cap in lines:
            self.add(a, b, x, cap, {line: 1.0})

    def add(self, a, b, x: float, cap: float, shares: dict) -> None:
        """Edges run from the lesser end: a line that runs the other way has a negative share."""
        if a > b:
            a, b, shares = b, a, {k: -v for k, v in shares.items()}
        self.edges[self.next] = (a, b, x, cap, shares)
        for end in (a, b):
            self.at.setdefault(end, set()).add(self.next)
        self.next += 1

    def take(self, k: int) -> tuple:
        e = self.edges.pop(k)
        for end in e[:2]:
            self.at[end].discard(k)
        return e

    def merge_parallel(self) -> bool:
        groups: dict = {}
        for k, (a, b, *_) in self.edges.items():
            groups.setdefault((a, b), []).append(k)
        done = False
        for (a, b), ks in groups.items():
            if a == b:
                for k in ks:
                    self.take(k)
                done = True
            elif len(ks) > 1:
                old = [self.take(k) for k in ks]
                total = sum(1 / e[2] for e in old)
                parts = [(1 / e[2]) / total for e in old]
                shares: dict = {}
                for e, part in zip(old, parts, strict=True):
                    for line, v in e[4].items():
                        shares[line] = shares.get(line, 0.0) + v * part
                self.add(a, b, 1 / total, min(e[3] / part for e, part in zip(old, parts, strict=True)), shares)
                done = True
        return done

    def free(self, degree: int) -> list:
        return sorted(n for n, ks in self.at.items() if len(ks) == degree and n not in self.protected)

    def legs(self, n) -> list[tuple]:
        """Other end, edge, and 1 if the edge runs from ``n``."""
        return [(b if a == n else a, k, 1.0 if a == n else -1.0) for k in sorted(self.at[n]) for a, b in [self.edges[k][:2]]]

    def prune(self) -> bool:
        done, queue = False, self.free(1)
        while queue:
            n = queue.pop()
            if len(self.at[n]) != 1:
                continue
            (other, k, _), done = self.legs(n)[0], True
            self.take(k)
            self.removed.append((n, {other: 1.0}))
            if other not in self.protected and len(self.at[other]) == 1:
                queue.append(other)
        return done

    def contract(self) -> bool:
        done = False
        for n in self.free(2):
            if len(self.at[n]) != 2:
                continue
            (p, k, from_p), (q, j, to_q) = self.legs(n)
            if p == q:
                continue
            first, second = self.take(k), self.take(j)
            x = first[2] + second[2]
            shares = {line: -from_p * v for line, v in first[4].items()}
            for line, v in second[4].items():
                shares[line] = shares.get(line, 0.0) + to_q * v
            self.add(p, q, x, min(first[3], second[3]), shares)
            self.removed.append((n, {p: second[2] / x, q: first[2] / x}))
            done = True
        return done

    def star_to_mesh(self) -> bool:
        done = False
        for n in self.free(3):
            if len(self.at[n]) != 3:
                continue
            legs = self.legs(n)
            if len({o for o, _, _ in legs}) < 3:
                continue
            old = {o: (self.take(k), sign) for o, k, sign in legs}
            y = {o: 1 / e[2] for o, (e, _) in old.items()}
            total = sum(y.values())
            ends = sorted(old)
            for i, o in enumerate(ends):
                for u in ends[i + 1 :]:
                    shares: dict = {}
                    for end, toward in ((o, -1.0), (u, 1.0)):  # into the hub, then out of it
                        e, sign = old[end]
                        for line, v in e[4].items():
                            shares[line] = shares.get(line, 0.0) + toward * sign * v
                    self.add(o, u, total / (y[o] * y[u]), min(old[o][0][3], old[u][0][3]), shares)
            self.removed.append((n, {o: w / total for o, w in y.items()}))
            done = True
        return done

    def reduce(self, star: bool) -> None:
        while any([self.merge_parallel(), self.prune(), self.contract(), star and self.star_to_mesh()]):
            pass

    def bus_weights(self) -> dict:
        """Weights of the buses that stay, for every bus; what was removed last is known first."""
        known = {n: {n: 1.0} for n in self.at}
        for n, _ in self.removed:
            known.pop(n, None)
        for n, parts in reversed(self.removed):
            out: dict = {}
            for other, w in parts.items():
                for stays, v in known[other].items():
                    out[stays] = out.get(stays, 0.0) + w * v
            known[n] = out
        return known


ROWS = "kind string, a long, b long, line long, x double, cap double, weight double"


def reduce_networks(lines: DataFrame, key: str, protected: DataFrame, star: bool = False) -> DataFrame:
    """Rows of three kinds for each network: ``line`` (a < b, x, cap of the reduced one), ``line_map`` (the flow of ``line`` is
    the sum of weights times flows from a to b) and ``bus_map`` (the value of bus a is the sum of weights times those of buses b).

    ``lines`` has key, line, a, b, x, cap with ends and lines of type long; ``protected`` has key, bus. A network is one task's.
    """
    kind = dict(lines.dtypes)[key]
    stays = protected.groupBy(key).agg(F.collect_set("bus").alias("_stay"))
    rows = lines.join(stays, key, "left")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        stay = p["_stay"].iloc[0]
        edges = p.sort_values("line")[["line", "a", "b", "x", "cap"]].itertuples(index=False, name=None)
        net = _Network(edges, set() if stay is None else set(stay))
        net.reduce(star)
        out: list[tuple] = []
        carried = set()
        for a, b, x, cap, shares in net.edges.values():
            out.append(("line", a, b, None, x, cap, None))
            out += [("line_map", a, b, line, None, None, w) for line, w in shares.items()]
            carried.update(shares)
        out += [("line_map", None, None, line, None, None, 0.0) for line in p["line"] if line not in carried]
        out += [("bus_map", n, stays, None, None, None, w) for n, parts in net.bus_weights().items() for stays, w in parts.items()]
        frame = pd.DataFrame(out, columns=["kind", "a", "b", "line", "x", "cap", "weight"]).astype({"a": "Int64", "b": "Int64", "line": "Int64"})
        frame.insert(0, key, p[key].iloc[0])
        return frame

    return rows.groupBy(key).applyInPandas(run, f"{key} {kind}, {ROWS}")


def expand_buses(reduced: DataFrame, key: str, values: DataFrame, value: str) -> DataFrame:
    """A value of the buses that stay (key, bus, value), for all original buses."""
    m = reduced.where("kind = 'bus_map'").select(key, F.col("a").alias("original"), F.col("b").alias("bus"), "weight")
    return m.join(values, [key, "bus"]).groupBy(key, F.col("original").alias("bus")).agg(F.sum(F.col("weight") * F.col(value)).alias(value))


def expand_lines(reduced: DataFrame, key: str, flows: DataFrame) -> DataFrame:
    """Flows of reduced lines (key, a, b, flow; a < b), for all original lines; lines of trees carry nothing."""
    m = reduced.where("kind = 'line_map'").select(key, "line", "a", "b", "weight")
    return m.join(flows, [key, "a", "b"], "left").groupBy(key, "line").agg(F.sum(F.coalesce(F.col("weight") * F.col("flow"), F.lit(0.0))).alias("flow"))
