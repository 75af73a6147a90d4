"""The engine's facade: named tables, hooks of plugins, constraints, metrics."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from importlib.metadata import entry_points

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.plans.query_spec import QuerySpec
from wattspan.plans.query_spec import run as run_query

HOOKS = ("pre_simulation", "post_demand_loaded", "pre_master_problem", "post_master_problem", "pre_year", "post_year", "post_simulation")


class Plugin:
    """Override any hook. ``post_demand_loaded`` may return a demand table; the last plugin's stands."""

    name = "plugin"

    def pre_simulation(self, engine: Engine) -> None: ...
    def post_demand_loaded(self, engine: Engine, demand: DataFrame) -> DataFrame | None: ...
    def pre_master_problem(self, engine: Engine) -> None: ...
    def post_master_problem(self, engine: Engine) -> None: ...
    def pre_year(self, engine: Engine, year: int) -> None: ...
    def post_year(self, engine: Engine, year: int) -> None: ...
    def post_simulation(self, engine: Engine) -> None: ...


class Engine:
    """Tables by name, plugins in order, user constraints and metrics."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.plugins: list[Plugin] = []
        self.metrics: dict[str, Callable[[Engine], DataFrame]] = {}
        self.constraints: list[tuple[str, dict[tuple[str, str], float], str, float]] = []

    def register(self, name: str, df: DataFrame) -> DataFrame:
        """Make a table known, also to SQL."""
        self.tables[name] = df
        df.createOrReplaceTempView(name)
        return df

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def query(self, facts: str, spec: QuerySpec) -> DataFrame:
        return run_query(self.tables[facts], spec)

    # Plugins.

    def use(self, plugin: Plugin | str) -> None:
        """A plugin, or ``module:Class`` of one."""
        if isinstance(plugin, str):
            module, _, cls = plugin.partition(":")
            plugin = getattr(importlib.import_module(module), cls)()
        self.plugins.append(plugin)

    def discover(self, group: str = "wattspan.plugins") -> list[str]:
        """Use all plugins that installed packages offer; their names."""
        found = [e for e in entry_points(group=group)]
        for e in found:
            self.use(e.load()())
        return [e.name for e in found]

    def fire(self, hook: str, *args: object) -> None:
        if hook not in HOOKS:
            raise ValueError(f"unknown hook {hook!r}")
        for p in self.plugins:
            getattr(p, hook)(self, *args)

    def load_demand(self, demand: DataFrame) -> DataFrame:
        for p in self.plugins:
            replaced = p.post_demand_loaded(self, demand)
            demand = demand if replaced is None else replaced
        return self.register("demand", demand)

    # Constraints and metrics.

    def constrain(self, name: str, terms: dict[tuple[str, str], float], sense: str, rhs: float) -> None:
        """A linear row over (variable, element) terms."""
        if sense not in ("<=", ">=", "="):
            raise ValueError(f"unknown sense {sense!r}")
        self.constraints.append((name, terms, sense, rhs))

    def constraint_rows(self, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Coefficients (row, col, val) and rows (row, sense, rhs); ``columns`` maps variable, element to col.
        A term that names nothing is an error."""
        terms = [(n, v, e, float(c)) for n, t, _, _ in self.constraints for (v, e), c in t.items()]
        rows = [(n, s, float(r)) for n, _, s, r in self.constraints]
        coef = self.spark.createDataFrame(terms, "row string, variable string, element string, val double").join(columns, ["variable", "element"], "left")
        lost = coef.where(F.col("col").isNull()).limit(1).collect()
        if lost:
            raise ValueError(f"constraint {lost[0]['row']}: no column for {lost[0]['variable']} of {lost[0]['element']}")
        return coef.select("row", "col", "val"), self.spark.createDataFrame(rows, "row string, sense string, rhs double")

    def metric(self, name: str, fn: Callable[[Engine], DataFrame]) -> None:
        self.metrics[name] = fn

    def measure(self, name: str) -> DataFrame:
        return self.metrics[name](self)
