"""Finance as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Five-year accelerated depreciation, half-year convention.
MACRS5 = (0.20, 0.32, 0.192, 0.1152, 0.1152, 0.0576)


def crf(rate: Column, years: Column) -> Column:
    """Capital recovery factor; ``1 / max(years, 1)`` without interest."""
    q = F.pow(1 + rate, years)
    return F.when(rate <= 0, 1.0 / F.greatest(years, F.lit(1))).otherwise(rate * q / (q - 1))


def discount(rate: Column | float, t: Column) -> Column:
    return 1.0 / F.pow(F.lit(1.0) + rate, t)


def npv(cash: Column, rate: Column | float, t: Column) -> Column:
    """Aggregate: present value of flows at the end of year ``t``."""
    return F.sum(cash * discount(rate, t))


def wacc(debt_share: Column, debt_rate: Column, tax: Column, equity_rate: Column) -> Column:
    return debt_share * debt_rate * (1 - tax) + (1 - debt_share) * equity_rate


def annuity(principal: Column, rate: Column, years: Column) -> Column:
    return principal * crf(rate, years)


def irr(flows: Column, low: float = -0.5, high: float = 5.0, steps: int = 200, tolerance: float = 1e-6) -> Column:
    """Internal rate of return of an array of flows (year 0 first) by bisection.

    0 for an empty or all-zero array; NaN without an outflow, or if the ends do not bracket a root.
    """
    value = lambda r: F.aggregate(F.transform(flows, lambda x, i: x / F.pow(1 + r, i)), F.lit(0.0), lambda a, x: a + x)

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        at = F.element_at(F.transform(F.array(mid), value), 1)
        done = (s["hi"] - s["lo"]) / 2 < tolerance
        lower = at * s["flo"] > 0
        return F.when(done, s).otherwise(F.struct(F.when(lower, mid).otherwise(s["lo"]).alias("lo"), F.when(lower, s["hi"]).otherwise(mid).alias("hi"), F.when(lower, at).otherwise(s["flo"]).alias("flo")))

    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"), value(F.lit(low)).alias("flo"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    bracketed = value(F.lit(low)) * value(F.lit(high)) <= 0
    some = F.exists(flows, lambda x: x != 0)
    return F.when(~F.coalesce(some, F.lit(False)), 0.0).when(~F.exists(flows, lambda x: x < 0), float("nan")).when(~bracketed, float("nan")).otherwise(found)


def mirr(flows: Column, finance_rate: float, reinvest_rate: float) -> Column:
    """Modified rate of return of an array of flows (year 0 first); NaN without both signs."""
    n = F.size(flows) - 1
    gains = F.aggregate(F.transform(flows, lambda x, i: F.greatest(x, F.lit(0.0)) * F.pow(F.lit(1 + reinvest_rate), n - i)), F.lit(0.0), lambda a, x: a + x)
    costs = F.aggregate(F.transform(flows, lambda x, i: F.least(x, F.lit(0.0)) / F.pow(F.lit(1 + finance_rate), i)), F.lit(0.0), lambda a, x: a + x)
    return F.when((gains > 0) & (costs < 0) & (n > 0), F.pow(gains / -costs, 1.0 / n) - 1).otherwise(float("nan"))


def depreciation(method: str, life: int) -> list[float]:
    """Shares of a value written off by year."""
    return list(MACRS5) if method == "macrs" else [1.0 / life] * life


def payback(years: Column, cumulative: Column) -> Column:
    """Aggregate over rows in order of years: the first year whose running sum is not negative."""
    return F.min(F.when(cumulative >= 0, years))
