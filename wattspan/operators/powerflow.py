"""AC power flow of snapshots by Newton's method, one snapshot a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def newton_raphson(y: np.ndarray, p: np.ndarray, q: np.ndarray, kind: np.ndarray, v0: np.ndarray, steps: int = 30, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray, bool]:
    """Voltages and angles. ``kind`` is 0 for the slack, 1 for buses of fixed voltage, 2 for loads."""
    v, a = v0.astype(float).copy(), np.zeros(len(v0))
    pv, pq = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
    free = np.concatenate([pv, pq])
    for _ in range(steps):
        u = v * np.exp(1j * a)
        s = u * np.conj(y @ u)
        miss = np.concatenate([p[free] - s.real[free], q[pq] - s.imag[pq]])
        if not len(miss) or np.abs(miss).max() < tolerance:
            return v, a, True
        i = y @ u
        by_angle = 1j * np.diag(u) @ np.conj(np.diag(i) - y @ np.diag(u))
        by_size = np.diag(u) @ np.conj(y @ np.diag(u / v)) + np.conj(np.diag(i)) @ np.diag(u / v)
        jac = np.block([[by_angle.real[np.ix_(free, free)], by_size.real[np.ix_(free, pq)]], [by_angle.imag[np.ix_(pq, free)], by_size.imag[np.ix_(pq, pq)]]])
        step = np.linalg.solve(jac, miss)
        a[free] += step[: len(free)]
        v[pq] += step[len(free) :]
    return v, a, False


def power_flow(buses: DataFrame, lines: list[tuple], snapshot: str) -> DataFrame:
    """Voltage and angle of each bus of each snapshot.

    ``buses`` has the snapshot, ``bus``, ``kind``, ``p``, ``q`` and ``v`` (per unit); lines are
    (from, to, r, x, charging), the same for all snapshots.
    """

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("bus", ignore_index=True)
        at = {b: i for i, b in enumerate(f["bus"])}
        y = np.zeros((len(f), len(f)), complex)
        for a, b, r, x, c in lines:
            g = 1 / complex(r, x)
            i, j = at[a], at[b]
            y[i, i] += g + 1j * c / 2
            y[j, j] += g + 1j * c / 2
            y[i, j] -= g
            y[j, i] -= g
        v, a, ok = newton_raphson(y, f["p"].to_numpy(), f["q"].to_numpy(), f["kind"].to_numpy(), f["v"].to_numpy())
        return f[[snapshot, "bus"]].assign(v=v, angle=a, converged=ok)

    kinds = dict(buses.dtypes)
    return buses.groupBy(snapshot).applyInPandas(solve, f"{snapshot} {kinds[snapshot]}, bus {kinds['bus']}, v double, angle double, converged boolean")
