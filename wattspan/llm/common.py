"""Helpers shared by the training-data operators: scratch tables, sampling, chunked Arrow work."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the session names in ``spark.checkpoint.dir``.

    Only where it is unset and all runs on one machine (tests) a temporary folder is made and set.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="wattspan-")
        spark.conf.set(CHECKPOINT_CONF, named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/wattspan/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner true sizes, so that it
    broadcasts a side only where its files are below the session's threshold.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later action reads."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that no model learns from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def bounded_sample(df: DataFrame, keys: str | list[str], rows: int, text_col: str | None = None, chars: int | None = None) -> DataFrame:
    """At least about ``rows`` rows picked by the hash of ``keys`` from all of ``df``, never above twice that.

    The share is set by a count, so the sample is spread over the whole table and bounded at every size. With
    ``chars``, of the picked rows so many are taken, in the order of their hashes, that their texts together
    have no more characters. ``keys`` should tell rows apart: rows of equal keys are picked or left together.
    """
    n = df.count()
    share = max(1, n // max(1, rows))
    hashed = F.xxhash64(*([keys] if isinstance(keys, str) else keys), F.lit(17))
    picked = df.where(F.pmod(hashed, F.lit(share)) == 0).limit(2 * rows)
    if chars is None:
        return picked
    # Of a bounded number of rows: a window without partitions is no bottleneck here.
    so_far = Window.orderBy("_picked", text_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = picked.withColumn("_picked", hashed).withColumn("_chars", F.sum(F.length(text_col)).over(so_far))
    return summed.where(F.col("_chars") <= chars).drop("_picked", "_chars")


def by_bytes(batch: pa.RecordBatch, column: int, size: int, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows whose texts together have ``size`` bytes at most; a longer text is alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > begin and (total + n > size or i - begin >= rows):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if batch.num_rows > begin:
        yield batch.slice(begin)


def utf8(column: pa.Array, i: int) -> np.ndarray:
    """The bytes of one text of an Arrow column, where they are."""
    return np.frombuffer(column[i].cast(pa.binary()).as_buffer(), np.uint8)


def pieces_at(data: np.ndarray, marks: bytes, size: int) -> Iterator[bytes]:
    """Text in pieces of about ``size`` bytes, each but the last ending after one of ``marks``."""
    mark, view, begin = re.compile(b"[" + re.escape(marks) + b"]"), memoryview(data), 0
    while begin < len(view):
        hit = mark.search(view, begin + size) if begin + size < len(view) else None
        end = hit.end() if hit else len(view)
        yield bytes(view[begin:end])
        begin = end
