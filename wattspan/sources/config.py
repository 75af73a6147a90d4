"""Configuration as small tables."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_yaml(path: str) -> dict[str, Any]:
    """A YAML file whose root is a mapping. Needs a YAML library."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML") from e
    root = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(root, dict):
        raise ValueError(f"{path}: the root must be a mapping")
    return root


def resolve_under(root: str, candidate: str) -> Path:
    """The path of ``candidate`` below ``root``; ValueError if it leads out of it."""
    base = Path(root).resolve()
    path = (base / candidate).resolve()
    if not path.is_relative_to(base):
        raise ValueError(f"{candidate} is outside {root}")
    return path


UNIT_LISTS = ("rated_power", "fuel_cost", "fixed_cost", "maintenance_cost", "ramp_up", "life_time", "initial_age", "degradation_rate")


def unit_rows(spark: SparkSession, units: list[dict[str, Any]]) -> DataFrame:
    """Units with a list by node for each parameter, as one row a unit and node; a single number is for all nodes."""
    for u in units:
        lengths = {len(u[k]) for k in UNIT_LISTS if isinstance(u.get(k), list)}
        if len(lengths) > 1:
            raise ValueError(f"{u.get('name')}: lists of different lengths")
    rows = []
    for u in units:
        n = max((len(u[k]) for k in UNIT_LISTS if isinstance(u.get(k), list)), default=1)
        lists = [[None if x is None else float(x) for x in (u[k] if isinstance(u.get(k), list) else [u.get(k)] * n)] for k in UNIT_LISTS]
        rows.append((u["name"], u.get("type"), u.get("fuel"), *lists))
    wide = spark.createDataFrame(rows, "unit string, type string, fuel string, " + ", ".join(f"{k} array<double>" for k in UNIT_LISTS))
    return wide.select("unit", "type", "fuel", F.posexplode(F.arrays_zip(*UNIT_LISTS)).alias("node", "_p")).select("unit", "type", "fuel", "node", "_p.*")
