"""Tables written in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; a local one only where none is named and all runs on one machine."""
    root = spark.conf.get(SHARED, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{SHARED} must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="wattspan-")
        spark.conf.set(SHARED, root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/wattspan/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a Parquet table of the shared folder. Written once, where a checkpoint computes its rows twice."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt over tasks of about so many rows (by ``keys``, if given), where each row is about to become many."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)
