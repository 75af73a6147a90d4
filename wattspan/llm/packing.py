"""Best-fit packing of documents into sequences by the sum-of-squares rule.

Every document is encoded, an end id is appended, and only documents longer than a sequence are cut. A
piece goes where the sum, over residual gaps, of the squared number of open sequences with that gap
becomes smallest; a sequence is opened only where no open one has room. Pieces are dealt at random, by a hash, to shards
of a bounded number of pieces, each packed by one task: a shard holds lengths only, never tokens, so its
memory does not depend on the texts, and what is lost against one packing of everything is at most a few
open sequences a shard. Within a shard longer pieces come first.

A null text is empty and gives the end id alone. Repeated rows and repeated ids are packed as separate
pieces. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.llm.common import materialise
from wattspan.llm.token_cache import encode_column, encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Pieces a shard holds on average. More pack closer, fewer spread over more tasks.
SHARD_PIECES = 32768


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, pattern: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: its document, number, place in the document, length, crc32 and, if asked for, ids."""
    schema = PIECES + (", ids binary" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, pattern)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, encoded in encode_column(enc, batch.column(1)):
                rows: list[tuple] = []
                for doc_id, ids in zip(doc_ids[at : at + len(encoded)], encoded, strict=True):
                    whole = ids + end
                    for k in range(0, len(whole), width):
                        part = whole[k : k + width]
                        rows.append((doc_id, k // width, k // 4, len(part) // 4, zlib.crc32(part), part))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], kinds[:n], strict=True)], names=names[:n])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given.

    For a piece of length ``s``, taking an open bin of gap ``g`` changes the sum of squares by
    ``2 * (count[g - s] - count[g]) + 2``, or by ``1 - 2 * count[s]`` if it fills the bin, as full bins are
    not counted. The least change wins, ties go to the smallest gap. As bins should be few, a bin is opened
    only where no open one has room.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[s:capacity])
        if len(gaps):
            change = 2 * (count[gaps] - count[gaps + s]) + 2 - (gaps == 0)
            gap = int(gaps[np.argmin(change)]) + s
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            b, gap = made, capacity
            made += 1
        bins[i], offsets[i] = b, capacity - gap
        left = gap - s
        if left:
            open_bins[left].append(b)
            count[left] += 1
    return bins, offsets


def pack(cut: DataFrame, capacity: int, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``cut`` (a stored table of pieces) with ``sequence_id`` and ``offset``."""
    shards = max(1, math.ceil(cut.count() / shard_pieces))
    schema = cut.schema.add("sequence_id", "long").add("offset", "long")

    def run(table: pa.Table) -> pa.Table:
        keys = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]
        table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))
        bins, offsets = sum_of_squares(table.column("length").to_numpy(), capacity)
        number = table.column("_shard").to_numpy().astype(np.int64) << 40
        return table.drop_columns(["_shard"]).append_column("sequence_id", pa.array(number + bins)).append_column("offset", pa.array(offsets))

    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    return cut.withColumn("_shard", shard).groupBy("_shard").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Placement of every piece of every document. Pieces are stored once: encoding is not repeated."""
    cut, _ = materialise(pieces(docs, tokenizer_path, capacity, end_id, with_ids=with_ids), "pieces")
    return pack(cut, capacity)
