"""The linear program dispatches every node and day."""

import numpy as np
import pandas as pd
import pytest
from conftest import DATA

from wattspan import bindings as b
from wattspan import catalog
from wattspan.operators import dispatch
from wattspan.queries import planning


def test_simplex_takes_every_node_and_day(spark):
    got = catalog.QUERIES["simplex_dispatch"](spark, str(DATA)).toPandas()
    units = b.units(spark, str(DATA)).select("node", "unit")
    steps = b.demand(spark, str(DATA)).select("node", "day").distinct().join(units, "node").toPandas()
    assert set(zip(got.node, got.day, got.unit)) == set(zip(steps.node, steps.day, steps.unit)) and len(got) == len(steps)
    assert got.day.nunique() > 366
    plain = planning.dispatched(spark, str(DATA), "true").select("node", "day", "unit", "dispatch", "cost").toPandas()
    both = got.merge(plain, on=["node", "day", "unit"])
    # Units of equal cost may share a load otherwise: hold what each step pays, not each unit.
    for part in ("dispatch_x", "dispatch_y"):
        both[part + "_cost"] = both[part] * both["cost"]
    s = both.groupby(["node", "day"])[["dispatch_x", "dispatch_y", "dispatch_x_cost", "dispatch_y_cost"]].sum()
    pd.testing.assert_series_equal(s.dispatch_x, s.dispatch_y, check_names=False, atol=1e-6)
    pd.testing.assert_series_equal(s.dispatch_x_cost, s.dispatch_y_cost, check_names=False, atol=1e-6)


def test_a_start_in_merit_order_gives_the_same_program():
    rng = np.random.default_rng(7)
    for _ in range(400):
        n = int(rng.integers(1, 8))
        caps, costs = rng.choice([0.0, 3.0, 5.0, 8.5], n), np.sort(rng.choice([1.0, 2.0, 2.0, 7.0], n))
        want, budget = float(rng.choice([0.0, 4.0, 11.0, 30.0, caps.sum()])), rng.choice([None, 0.0, 3.0, 12.0, 99.0])
        c, a, b, upper = np.append(costs, 50.0), np.ones((1, n + 1)), np.array([want]), np.append(caps, np.inf)
        if budget is not None:
            a = np.vstack([np.append(a[0], 0.0), np.append(np.ones(n), [0.0, 1.0])])
            c, b, upper = np.append(c, 0.0), np.array([want, budget]), np.append(upper, np.inf)
        cold, z = dispatch.bounded_simplex(c, a, b, upper)
        warm, y = dispatch.bounded_simplex(c, a, b, upper, dispatch.merit_start(caps, want, budget))
        assert y == pytest.approx(z) and np.allclose(a @ warm, b) and (warm >= -1e-9).all() and (warm <= upper + 1e-9).all()
