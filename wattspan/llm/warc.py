"""WARC archives: write, read, and resolve revisits.

Every record is a gzip member of its own, so a reader can seek to any, and every file is a plain WARC/1.1 file,
on any Hadoop file system, committed once even if executors are lost: Spark's text writer writes rows that
are a file's bytes each. A file holds ``FILE_BYTES`` and at most one record more. Files are read a member, or a
piece of ``READ_BYTES``, at a time, and records are given on in batches bounded by bytes.

Revisit resolution shuffles headers only by payload digest: a partial maximum elects the response of each
group of equal payloads, so a group of any size arrives as one row a task. Only elected groups with more
than one record are kept; records are joined to them by digest. Payloads move in that join only where the
elected groups are too large to broadcast, and Spark then splits a hot digest. A revisit names its response by
``WARC-Refers-To``, ``-Target-URI`` and ``-Date``.

Payloads below ``min_bytes`` are never resolved. Null payloads are empty. Rows with equal ids are separate
records, with ids of their own; of those that tie for the largest id one is elected, by its place in the
archive. A null id never wins against another. Null addresses give no target header. Records of other kinds
(``warcinfo``, ``request``, ...), and revisits of payloads that no elected group has, pass through unchanged; a response
whose header has no digest gets one. Empty tables give empty archives.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.llm.common import materialise, scratch_path

CRLF = "\r\n"
END = b"\r\n\r\n"
#: A file is closed when it holds so many bytes, after compression.
FILE_BYTES = 16_000_000
#: Bytes that are inflated, and bytes of payloads that are given on, together.
READ_BYTES = 1 << 16
BATCH_BYTES = 8_000_000
BATCH_RECORDS = 2000
#: WARC-Date of records; a parameter, so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 5

HEADS = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, place string, date string"
BODIES = "http binary, payload binary, raw binary"
WRITTEN = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "date", "record_id", "refers_to_id", "refers_to_url", "refers_to_date", "http", "payload", "raw"]


def urn(*parts: Column) -> Column:
    """A record id from what tells the record apart."""
    return F.regexp_replace(F.md5(F.concat_ws("|", *parts).cast("binary")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "<urn:uuid:$1-$2-$3-$4-$5>")


def pages_to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Every page as a response record with payload, its length and its SHA-1."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    none = lambda kind: F.lit(None).cast(kind)
    out = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    out = out.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload"), "record_type": F.lit("response"), "date": F.lit(date)})
    record_id = urn(F.lit("page"), F.col("page_id"), F.col("url"), F.col("payload_digest"), F.monotonically_increasing_id())
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF)).cast("binary")
    more = {"refers_to": none("long"), "refers_to_id": none("string"), "refers_to_url": none("string"), "refers_to_date": none("string"), "raw": none("binary")}
    return out.withColumns({"record_id": record_id, "http": http, **more}).select(*WRITTEN)


def record_bytes(r: dict) -> bytes:
    """One record with its end. ``raw`` is a whole record as it was read."""
    if r["raw"] is not None:
        return r["raw"] + END
    revisit = r["record_type"] == "revisit"
    body = r["http"] + (b"" if revisit else r["payload"])
    url = lambda x: "".join("%20" if c <= " " else c for c in x) if x else None
    head = [
        ("WARC-Type", r["record_type"]),
        ("WARC-Record-ID", r["record_id"]),
        ("WARC-Date", r["date"]),
        ("WARC-Target-URI", url(r["url"])),
        ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", r["refers_to_id"]),
        ("WARC-Refers-To-Target-URI", url(r["refers_to_url"])),
        ("WARC-Refers-To-Date", r["refers_to_date"]),
        ("Page-ID", r["page_id"]),
        ("Refers-To-Page-ID", r["refers_to"]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(body)),
    ]
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head if v is not None)]
    return (CRLF.join(lines) + CRLF + CRLF).encode("utf-8", "surrogatepass") + body + END


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(records: DataFrame, path: str, compression: str = "gzip", file_bytes: int = FILE_BYTES) -> None:
    """Write records (columns ``WRITTEN``) as WARC files below ``path``; ``compression`` is ``gzip`` or ``none``."""
    packed = compression == "gzip"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    data = record_bytes(r)
                    held.append(_member(data) if packed else data)
                    size += len(held[-1])
                    if size >= file_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    files = records.select(*WRITTEN).mapInArrow(run, "value binary")
    if not packed:  # the writer adds a row's end itself
        files = files.select(F.substring("value", F.lit(1), F.octet_length("value") - len(END)).alias("value"))
    # After a row of members the writer adds an empty member, byte for byte.
    end = _member(b"").decode("latin-1") if packed else END.decode()
    out = files.select(F.col("value").cast("string").alias("value")).write.option("lineSep", end).option("encoding", "ISO-8859-1")
    out.option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def inflated(data: bytes) -> Iterator[bytes]:
    """An archive's bytes in pieces: of gzip members one after another, or as they are."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(view), READ_BYTES):
            yield bytes(view[at : at + READ_BYTES])
        return
    while at < len(view):
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof and at < len(view):
            piece = view[at : at + READ_BYTES]
            yield unpacker.decompress(piece)
            at += len(piece) - len(unpacker.unused_data)


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes, int]]:
    """Header (names in lower case), block, whole record without its end, and offset of each record. A record is
    held whole, no more of the archive."""
    held, base, need, done = bytearray(), 0, 0, False
    pieces = iter(pieces)
    while True:
        while len(held) < need or (need == 0 and held.find(END) < 0):
            piece = next(pieces, None)
            if piece is None:
                done = True
                break
            held += piece
        if done and (not held.strip() or held.find(END) < 0):
            if held.strip():
                raise ValueError(f"a record at {base} is cut short")
            return
        if need == 0:
            blank = len(held) - len(held.lstrip(b"\r\n"))
            if blank:  # readers take any number of empty lines between records
                del held[:blank]
                base += blank
                continue
            if not held.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at {base}")
            stop = held.find(END)
            lines = held[:stop].decode("utf-8", "replace").split(CRLF)
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            start = stop + len(END)
            need = start + int(head["content-length"])
            continue
        if len(held) < need:
            raise ValueError(f"a record at {base} is cut short")
        raw = bytes(held[:need])
        yield head, raw[start:], raw, base
        del held[:need]
        base += need
        need = 0


def checked_digest(head: dict[str, str], payload: bytes, where: str) -> str:
    """SHA-1 of a payload; ValueError if the header names another, in hexadecimal or in base 32."""
    own = hashlib.sha1(payload)
    kind, _, named = head.get("warc-payload-digest", "").partition(":")
    if kind.lower() == "sha1":
        known = base64.b32decode(named.upper()).hex() if len(named) == 32 else named.lower()
        if known != own.hexdigest():
            raise ValueError(f"damaged record in {where}")
    return own.hexdigest()


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _row(head: dict[str, str], block: bytes, raw: bytes, place: str) -> tuple:
    kind = head.get("warc-type", "")
    same = (_number(head.get("page-id")), head.get("warc-target-uri"), kind)
    if kind == "response" and head.get("content-type", "").startswith("application/http"):
        at = block.find(END)
        http, payload = (block, b"") if at < 0 else (block[: at + 4], block[at + 4 :])
        return (*same, len(payload), checked_digest(head, payload, place), None, place, head.get("warc-date"), http, payload, None)
    digest = head.get("warc-payload-digest", "")
    size = None
    if kind == "revisit":
        fields = (x.partition(b":") for x in block.split(b"\r\n"))
        size = next((int(v) for k, _, v in fields if k.strip().lower() == b"content-length" and v.strip().isdigit()), None)
    return (*same, size, digest.removeprefix("sha1:") or None, _number(head.get("refers-to-page-id")), place, head.get("warc-date"), block if kind == "revisit" else b"", b"", raw)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row a record, with ``http``, ``payload`` and (of records that are no responses) ``raw`` if asked for. The
    digest of a response is computed anew and must equal its header's."""
    schema = HEADS + (f", {BODIES}" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        n = len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], kinds[:n], strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                name = name.as_py().rsplit("/", 1)[-1]
                rows, size = [], 0
                for head, block, raw, at in parse(inflated(content.as_py())):
                    row = _row(head, block, raw, f"{name}:{at:012d}")
                    rows.append(row if with_payload else row[: len(names)])
                    size += len(raw)
                    if size >= BATCH_BYTES or len(rows) >= BATCH_RECORDS:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def elect(headers: DataFrame, min_bytes: int) -> DataFrame:
    """For every payload that more than one record has: its digest and the response that the others refer to."""
    best = F.max(F.when(F.col("record_type") == "response", F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("rank"), "place", "page_id", "url", "date")))
    groups = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.count("*").alias("records"), best.alias("best"))
    chosen = [F.col(f"best.{k}").alias(f"response_{k}") for k in ("page_id", "place", "url", "date")]
    return groups.where("records > 1 AND best IS NOT NULL").select(F.col("payload_digest").alias("digest"), *chosen)


def fresh_id(place: Column) -> Column:
    """The id of a record in the deduplicated archive, from its place in the source."""
    return urn(F.lit("resolved"), place)


def resolve(records: DataFrame, elected: DataFrame, min_bytes: int) -> DataFrame:
    """Records with fresh types and headers: those that are not the elected response of their payload become revisits."""
    large = F.col("record_type").isin("response", "revisit") & (F.col("payload_bytes") >= min_bytes)
    key = F.when(large, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), "place"))
    joined = records.withColumn("digest", key).join(elected, "digest", "left")
    revisit = F.col("response_place").isNotNull() & (F.col("response_place") != F.col("place"))
    named = lambda c: F.when(revisit, c)
    return joined.select(
        "page_id", "url", F.when(revisit, "revisit").otherwise(F.col("record_type")).alias("record_type"), "payload_bytes", "payload_digest",
        F.when(revisit, F.col("response_page_id")).otherwise(F.col("refers_to")).alias("refers_to"),
        "date", fresh_id(F.col("place")).alias("record_id"),
        named(fresh_id(F.col("response_place"))).alias("refers_to_id"), named(F.col("response_url")).alias("refers_to_url"), named(F.col("response_date")).alias("refers_to_date"),
        "http", F.when(~revisit, F.col("payload")).alias("payload"), F.when(~revisit, F.col("raw")).alias("raw"),
    )


def deduplicate_archives(spark: SparkSession, source: str, target: str, min_bytes: int = 1000, compression: str = "gzip") -> None:
    """Read the archives below ``source`` and write them to ``target`` with revisits in place of repeats."""
    elected, _ = materialise(elect(read_archives(spark, source, with_payload=False), min_bytes), "elected")
    write_archives(resolve(read_archives(spark, source), elected, min_bytes), target, compression)


def archive_pages(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Pages to archives, archives to deduplicated archives, and those read back."""
    spark = pages.sparkSession
    raw, clean = scratch_path(spark, "warc"), scratch_path(spark, "warc-resolved")
    write_archives(pages_to_records(pages), raw)
    deduplicate_archives(spark, raw, clean, min_bytes)
    return read_archives(spark, clean, with_payload=False)
