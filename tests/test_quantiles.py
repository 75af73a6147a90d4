"""Exact quantiles against numpy."""

import math
import random

import numpy as np
import pytest

from wattspan.operators.quantiles import exact_quantiles, with_quantiles

PROBS = [0.0, 0.05, 0.33, 0.5, 0.95, 1.0]


def test_quantiles_of_groups(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, float("nan"), 1.0, 2.0, rng.gauss(0, 9)])) for k in ["a", "a", "a", "b", None] for _ in range(120)]
    rows += [("one", 7.0), ("none", None), ("same", 3.0), ("same", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r["k"]: r["quantiles"] for r in exact_quantiles(df, ["k"], "v", PROBS).collect()}
    groups = {k: [v for x, v in rows if x == k and v is not None and not math.isnan(v)] for k in {r[0] for r in rows}}
    assert set(got) == {k for k, v in groups.items() if v}
    for k in got:
        assert got[k] == pytest.approx(np.quantile(groups[k], PROBS).tolist())
    everything = [v for v in sum(groups.values(), [])]
    assert exact_quantiles(df, [], "v", PROBS).first()["quantiles"] == pytest.approx(np.quantile(everything, PROBS).tolist())
    wide = {r["k"]: r["m"] for r in with_quantiles(df, ["k"], "v", [0.5], ["m"]).collect()}
    assert wide["none"] is None and wide[None] == pytest.approx(np.median(groups[None]))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert exact_quantiles(df, ["k"], "v", [0.5]).count() == 0
    assert with_quantiles(df, [], "v", [0.5], ["m"]).columns == ["k", "v", "m"]
