"""A session with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Set where unset: UTC for all time arithmetic, adaptive execution for partition sizes and skewed joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "wattspan", master: str | None = None, **conf: str) -> SparkSession:
    """A session; ``conf`` takes precedence. The master is the launcher's unless given."""
    builder = SparkSession.builder.appName(app).config(map={**SETTINGS, **conf})
    return (builder.master(master) if master else builder).getOrCreate()
