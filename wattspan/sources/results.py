"""Results of runs as partitioned tables: begin, append by year, finish, read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ResultStore:
    """``<root>/<table>/run_id=.../year=...`` and a metadata table with one row an event."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.root, self.run_id = spark, root.rstrip("/"), run_id

    def _event(self, what: str, detail: str = "") -> None:
        row = self.spark.createDataFrame([(self.run_id, what, detail)], "run_id string, event string, detail string")
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/_run_metadata_")

    def begin(self, **settings: object) -> None:
        self._event("begin", str(sorted(settings.items())))

    def append(self, table: str, df: DataFrame, year: int) -> None:
        """One year's rows. A year written again replaces itself, so a retried append leaves no repeats."""
        rows = df.withColumn("run_id", F.lit(self.run_id)).withColumn("year", F.lit(year))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "year").parquet(f"{self.root}/{table}")

    def finish(self) -> None:
        self._event("complete")

    def complete(self) -> bool:
        return not self.spark.read.parquet(f"{self.root}/_run_metadata_/").where((F.col("run_id") == self.run_id) & (F.col("event") == "complete")).isEmpty()

    def read(self, table: str, *years: int) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{table}").where(F.col("run_id") == self.run_id)
        return df.where(F.col("year").isin(*years)) if years else df
