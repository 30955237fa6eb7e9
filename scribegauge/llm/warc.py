"""WARC archives: writing, and reading back with segment reassembly.

Writing: one record per row. A payload goes into an HTTP response with chunked transfer framing; a block longer than
segment_bytes is cut into a first record and continuation records. Equal payloads are stored once, the others revisit
it. Files are written by Spark's text writer with the record separator as line separator, so they land in any store.

Reading: files are parsed by their content lengths, never by searching for separators. Continuation records are grouped
by their origin identifier, ordered by segment number, and joined to their first record; the total length is verified,
then the HTTP head is cut off and the chunked framing decoded. Only segmented records shuffle. A group is one record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need, scratch_path, without, written

SEGMENT_BYTES, CHUNK_BYTES = 16_384, 4096
SEPARATOR = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
_PAGES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

RECORD_SCHEMA = "record_id string, record_type string, page_id long, target_uri string, refers_to_id string, payload_digest string, segment int, origin_id string, total_length long, truncated boolean, block binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload under chunked transfer framing (extensions and trailers are skipped); None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block


def _one_line(value: str | None) -> str:
    return "".join(" " if c in "\r\n" else c for c in value or "")


def records_of(page_id: int | None, url: str | None, payload: bytes, sha1: str, first: bool, stored: bool, segment_bytes: int) -> Iterator[bytes]:
    """The records of one row: a response with its continuations, or a revisit."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    shared = f"<urn:uuid:{uuid.uuid5(_PAGES, sha1)}>"
    own = [("WARC-Page-ID", str(page_id))] if page_id is not None else []
    about = [*own, ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if not first:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        yield _record("revisit", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", shared), *about], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    record_id = shared if stored else f"<urn:uuid:{uuid.uuid4()}>"
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record("response", [("WARC-Record-ID", record_id), *([("WARC-Segment-Number", "1")] if len(parts) > 1 else []), *about], parts[0])
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        yield _record("continuation", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", str(n)), *last, ("WARC-Target-URI", _one_line(url))], part)


def write_warc(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, compress: bool = True) -> None:
    """Write pages as WARC files under path.

    Of equal payloads of least_bytes or more the one with the smallest id is stored (a null id is above all others; of
    rows that repeat the id one is) and the others are revisits; smaller ones are all stored. A null payload is empty.
    An empty table writes files without records. Other columns are not archived.
    """
    need(pages, id_column, url_column, payload_column)
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_column).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = written(rows.withColumns({"sha1": F.sha1("payload"), "row": F.monotonically_increasing_id(), "stored": F.octet_length("payload") >= least_bytes}), "warc-rows")
    firsts = rows.where("stored").groupBy("sha1").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("least"))
    # adaptive execution can split a payload that very many rows share: both sides are dealt by this join alone
    firsts = firsts.select(F.reverse("sha1").alias("other"), F.col("least.row").alias("first"))
    marked = rows.join(firsts, F.when(F.col("stored"), F.reverse("sha1")).otherwise(F.concat(F.lit("-"), F.col("row").cast("string"))) == F.col("other"), "left")
    marked = marked.select("page_id", "url", "payload", "sha1", (~F.col("stored") | (F.col("row") == F.col("first"))).alias("is_first"), "stored")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                for record in records_of(*row, segment_bytes):
                    held.append(record)
                    size += len(record)
                if size >= 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    lines = marked.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", SEPARATOR.decode()).option("compression", "gzip" if compress else "none").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(lower-cased header fields, block, whether the block was cut short) of each record of a WARC file, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        if at < 0:
            return
        head = data.find(SEPARATOR, at)
        if head < 0:
            return
        fields: dict[str, str] = {}
        name = ""
        for line in data[at:head].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and name:
                fields[name] += " " + line.strip()
            else:
                name, _, value = line.partition(":")
                name = name.strip().lower()
                fields[name] = value.strip()
        length = int(fields.get("content-length", "0") or 0) if fields.get("content-length", "0").isdigit() else 0
        start = head + len(SEPARATOR)
        yield fields, data[start : start + length], start + length > len(data)
        at = start + length


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files under path, as RECORD_SCHEMA."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, block, cut in parse_warc(content.as_py()):
                    number = lambda k: int(f[k]) if f.get(k, "").lstrip("-").isdigit() else None  # noqa: B023, E731
                    rows.append((f.get("warc-record-id"), f.get("warc-type"), number("warc-page-id"), f.get("warc-target-uri"), f.get("warc-refers-to"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, number("warc-segment-number"), f.get("warc-segment-origin-id"), number("warc-segment-total-length"), cut, block))
                    size += len(block)
                    if size >= 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW_TYPES, strict=True)], names=ARROW_NAMES)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW_TYPES, strict=True)], names=ARROW_NAMES)

    return files.mapInArrow(parsed, RECORD_SCHEMA)


ARROW_NAMES = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
ARROW_TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in RECORD_SCHEMA.split(", ")]


def payload_of(block: bytes) -> bytes | None:
    """The HTTP payload in a response's block; None if the head or the chunked framing is broken."""
    head, found, body = block.partition(SEPARATOR)
    if not found:
        return None
    names = head.lower().split(b"\r\n")
    return dechunked(body) if any(x.startswith(b"transfer-encoding:") and b"chunked" in x for x in names) else body


def reassemble(records: DataFrame) -> DataFrame:
    """Responses and revisits with whole blocks: the records' columns plus whole boolean.

    Segments are grouped by their origin and ordered by number. whole is false where numbers have gaps or repeat, the last
    record states no total length, or the parts don't add up to it; the block then holds what there is. Continuations
    without their first record are left out.
    """
    single = records.where("record_type != 'continuation' and segment is null").withColumn("whole", ~F.col("truncated"))
    parts = records.where("record_type = 'continuation' or segment is not null")
    key = F.coalesce("origin_id", "record_id")

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("segment", kind="stable")
        first = group[group["record_type"] != "continuation"]
        if not len(first):
            return group.iloc[:0].assign(whole=pd.Series([], dtype=bool))
        block = b"".join(group["block"])
        total = group["total_length"].iloc[-1]
        out = first.iloc[:1].copy()
        out["whole"] = list(group["segment"]) == list(range(1, len(group) + 1)) and not pd.isna(total) and int(total) == len(block) and not group["truncated"].any()
        out["block"] = [block]
        out["page_id"] = out["page_id"].astype("Int64")
        out["total_length"] = pd.array([pd.NA], dtype="Int64")
        return out

    many = parts.withColumn("__sg_origin", key).groupBy("__sg_origin").applyInPandas(lambda g: joined(g.drop(columns="__sg_origin")), RECORD_SCHEMA + ", whole boolean")
    return single.unionByName(many)


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """(page_id, target_uri, record_type, payload_bytes, payload_digest, refers_to, payload, verified) of the archives.

    A revisit has its response's payload_bytes and payload_digest and no payload of its own; refers_to is the response's
    page_id. keep_payload: false leaves payloads null once they are decoded and digested. verified: the record was whole, decoded, and has the stated digest (of a revisit: its response does, and both
    state the same). Broken records stay, with null payload and verified false; a revisit without its response likewise.
    """
    whole = reassemble(read_records(spark, path).where("record_type in ('response', 'continuation', 'revisit')"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, blocks, fine, stated = (batch.column(n).to_pylist() for n in ("record_type", "block", "whole", "payload_digest"))
            payloads = [payload_of(b) if k == "response" and w else None for k, b, w in zip(kinds, blocks, fine, strict=True)]
            digests = [None if p is None else payload_digest(p) for p in payloads]
            columns = [batch.column(n) for n in ("page_id", "target_uri", "record_type", "record_id", "refers_to_id", "payload_digest")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([None if p is None else len(p) for p in payloads], pa.int64()), pa.array(digests, pa.string()), pa.array([d is not None and d == s for d, s in zip(digests, stated, strict=True)]), pa.array(payloads if keep_payload else [None] * len(payloads), pa.binary())],
                names=["page_id", "target_uri", "record_type", "record_id", "refers_to_id", "stated", "payload_bytes", "payload_digest", "verified", "payload"],
            )

    schema = "page_id long, target_uri string, record_type string, record_id string, refers_to_id string, stated string, payload_bytes long, payload_digest string, verified boolean, payload binary"
    records = written(whole.mapInArrow(decoded, schema), "warc-read")
    responses = records.where("record_type = 'response'")
    heads = responses.groupBy("record_id").agg(F.min(F.struct("page_id", "payload_bytes", "payload_digest", "verified")).alias("of"))
    heads = heads.select(F.reverse("record_id").alias("other"), "of")
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest", "verified", "payload").join(heads, F.reverse("refers_to_id") == F.col("other"), "left")
    names = ["page_id", "target_uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "verified"]
    revisits = revisits.select("page_id", "target_uri", "record_type", "of.payload_bytes", "of.payload_digest", F.col("of.page_id").alias("refers_to"), F.lit(None).cast("binary").alias("payload"), F.coalesce(F.col("of.verified") & (F.col("of.payload_digest") == F.col("stated")), F.lit(False)).alias("verified"))
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*names).unionByName(revisits)


def round_trip(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least_bytes: int = 0, keep_payload: bool = True) -> DataFrame:
    """Write pages as WARC files into the shared folder and read them back: read_warc()'s columns, a row for each of pages.

    A null payload is an empty one, a null url an empty target. Of equal payloads of at least least_bytes that of the
    smallest id is the response (a null id is above all others; of rows that repeat the id exactly one is), the others
    revisit it. Very long payloads are cut into segments and come back whole. An empty table gives no rows. Other columns
    of pages are left out.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(without(pages), path, id_column, url_column, payload_column, least_bytes)
    return read_warc(spark, path, keep_payload)
