"""Token-id archives: bit- or byte-plane shuffled blocks, zstandard planes, and a chunk index.

An archive is a Parquet-carried series of chunks, so that any Hadoop file system holds it and the commit
protocol survives lost executors. A chunk is a self-contained binary: a header (magic, plane kind, block
size, number of ids, number of planes), the chunk index (for each block and plane its compressed length
and crc32), then the planes. A block is a fixed number of ids; its ids are transposed, so that plane ``k``
holds bit (or byte) ``k`` of every id, and each plane is compressed alone. The last block of a chunk may
be shorter. Beside the chunks stands an index table with one row a document: chunk, place in the chunk,
and number of ids, in ascending document order.

Chunks never outgrow ``CHUNK_IDS`` unless a single document does. Null texts are empty and give the end
id alone; rows with equal ids are kept apart, in the order of their text digests. Null ids come first. An
empty table gives an empty archive.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattspan.llm.common import materialise, scratch_path
from wattspan.llm.token_cache import encode_column, encoder

MAGIC = b"WBPS"
BLOCK_IDS = 4096
CHUNK_IDS = 262_144
_HEAD = struct.Struct("<4sBBHIQ")  # magic, version, planes kind (1 bit, 8 byte), planes, block ids, ids
_ENTRY = struct.Struct("<II")  # compressed length, crc32 of the compressed plane


def encode_chunk(ids: np.ndarray, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3) -> bytes:
    """One chunk. ``kind`` is ``byte`` (4 planes a block) or ``bit`` (32 planes a block)."""
    packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
    planes = 4 if kind == "byte" else 32
    index, body = [], []
    for at in range(0, len(ids), block_ids):
        raw = np.ascontiguousarray(ids[at : at + block_ids], "<u4").view(np.uint8).reshape(-1, 4)
        if kind == "byte":
            rows = raw.T
        else:
            rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
        for row in rows:
            packed = packer.compress(np.ascontiguousarray(row).tobytes())
            index.append(_ENTRY.pack(len(packed), zlib.crc32(packed)))
            body.append(packed)
    return b"".join([_HEAD.pack(MAGIC, 1, 8 if kind == "byte" else 1, planes, block_ids, len(ids)), *index, *body])


def decode_chunk(chunk: bytes) -> np.ndarray:
    """The ids of a chunk; raises ValueError where its magic or a plane's crc32 is wrong."""
    magic, version, kind, planes, block_ids, n = _HEAD.unpack_from(chunk)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token-id chunk")
    blocks = -(-n // block_ids)
    entries = [_ENTRY.unpack_from(chunk, _HEAD.size + _ENTRY.size * i) for i in range(blocks * planes)]
    at = _HEAD.size + _ENTRY.size * len(entries)
    unpacker = zstandard.ZstdDecompressor()
    out = []
    for b in range(blocks):
        size = min(block_ids, n - b * block_ids)
        rows = []
        for length, crc in entries[b * planes : (b + 1) * planes]:
            packed = chunk[at : at + length]
            if zlib.crc32(packed) != crc:
                raise ValueError("damaged plane")
            rows.append(np.frombuffer(unpacker.decompress(packed), np.uint8))
            at += length
        if kind == 8:
            raw = np.stack(rows, axis=1)
        else:
            bits = np.stack([np.unpackbits(r, count=size, bitorder="little") for r in rows], axis=1)
            raw = np.packbits(bits, axis=1, bitorder="little")
        out.append(np.ascontiguousarray(raw).view("<u4").ravel())
    return np.concatenate(out) if out else np.zeros(0, "<u4")


CHUNKS = "part int, chunk int, first_row bigint, n_docs int, n_ids bigint, payload binary, doc_ids array<bigint>, lengths array<bigint>"


def write_archive(docs: DataFrame, path: str, tokenizer_path: str, pattern: str, end_id: int, kind: str = "byte", chunk_ids: int = CHUNK_IDS) -> None:
    """Encode every text and write chunks in ascending order of ``doc_id`` to ``path``.

    Rows are range-partitioned by id, so part and chunk numbers follow the order of ids. Tokens are made
    after that exchange: what is shuffled is the text, once.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer_path, pattern)
        part = TaskContext.get().partitionId()
        held: list[bytes] = []
        names: list[int | None] = []
        total = chunk = row = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, names, total, chunk, row
            data = encode_chunk(np.frombuffer(b"".join(held), "<u4"), kind)
            lengths = [len(x) // 4 for x in held]
            made = [[part], [chunk], [row], [len(held)], [sum(lengths)], [data], [names], [lengths]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, types, strict=True)], names=["part", "chunk", "first_row", "n_docs", "n_ids", "payload", "doc_ids", "lengths"])
            row += len(held)
            chunk += 1
            held, names, total = [], [], 0
            return batch

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, encoded in encode_column(enc, batch.column(1)):
                for doc_id, ids in zip(doc_ids[at : at + len(encoded)], encoded, strict=True):
                    if held and total + len(ids) // 4 + 1 > chunk_ids:
                        yield flush()
                    held.append(ids + end)
                    names.append(doc_id)
                    total += len(ids) // 4 + 1
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # One id, or null, may have any number of rows, and they may be copies: the place in the input parts them.
    ranges = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = rows.repartitionByRange(*ranges).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, CHUNKS).write.option("compression", "none").parquet(path)


def read_archive(spark, path: str, with_ids: bool = True) -> DataFrame:
    """One row a document from the archive: doc_id, start, n_tokens, crc32 of the ids, and the ids as bytes.

    ``start`` adds the ids of earlier chunks, from the chunk index, to the place in the chunk. The index has
    one small row a chunk; its running sum goes by part first, so no task reads the whole index.
    """
    chunks = spark.read.schema(CHUNKS).parquet(path)
    sizes = chunks.select("part", "chunk", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before_part = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("_before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk")) - F.col("n_ids")
    base = sizes.withColumn("_inside", inside).join(before_part, "part").select("part", "chunk", (F.col("_inside") + F.col("_before")).alias("base"))
    base, _ = materialise(base, "chunk-index")

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = decode_chunk(batch.column(0)[i].as_py()).astype("<u4", copy=False).tobytes()
                names, lengths, start = batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                at, rows = 0, []
                for doc_id, n in zip(names, lengths, strict=True):
                    ids = data[4 * at : 4 * (at + n)]
                    rows.append((doc_id, start + at, n, zlib.crc32(ids), ids))
                    at += n
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.binary()]
                keys = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
                n = 5 if with_ids else 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], kinds[:n], strict=True)], names=keys[:n])

    return chunks.join(base, ["part", "chunk"]).select("payload", "doc_ids", "lengths", "base").mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, kind: str = "byte") -> DataFrame:
    """Write the archive to the shared folder and read it back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-ids")
    write_archive(docs, path, tokenizer_path, pattern, end_id, kind)
    return read_archive(spark, path, with_ids=False)

