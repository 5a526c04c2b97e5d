"""WARC archives: writing pages as records with revisits and segments, and reading them back whole.

A record whose block is longer than a segment is written as a first segment and continuation
records, which name their origin and number; the last has the total length. Response payloads are
in chunked transfer framing. The reader groups continuation records by origin, orders them by
number, verifies numbering and total length, undoes the framing and verifies the payload digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
REVISIT_FROM = 1000
VERSION = b"WARC/1.1\r\n"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


SIZE, LENGTH = re.compile(rb"[0-9A-Fa-f]{1,16}"), re.compile(r"[0-9]{1,18}")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i:i + size]), payload[i:i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken. Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line not ended")
        size = body[at:end].split(b";")[0].strip()
        if not SIZE.fullmatch(size):
            raise ValueError("chunk size unreadable")
        n = int(size, 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n:at + n + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(body[at:at + n])
        at += n + 2


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-coded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its last line end, which the line writer adds."""
    head = "".join(f"{k}: {_clean(str(v))}\r\n" for k, v in headers if v is not None)
    return VERSION + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n"


def _records(segment_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        out: list[bytes] = []
        for r in range(batch.num_rows):
            key, url, payload, kind, to_key, to_url = (batch.column(c)[r].as_py() for c in range(6))
            payload = payload or b""
            name = f"<urn:record:{task}-{row}>"
            row += 1
            digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
            about = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", url),
                     ("WARC-Payload-Digest", digest), ("X-Key", key), ("X-Payload-Length", len(payload)),
                     ("Content-Type", "application/http;msgtype=response")]
            if kind == "revisit":
                about += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", to_url),
                          ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Key", to_key)]
                out.append(_record(about, HTTP))
                continue
            block = HTTP + chunked(payload)
            if len(block) <= segment_bytes:
                out.append(_record(about, block))
                continue
            out.append(_record([*about, ("WARC-Segment-Number", 1)], block[:segment_bytes]))
            last = -(-len(block) // segment_bytes)
            for n in range(2, last + 1):
                out.append(_record(
                    [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{n}>"), ("WARC-Date", DATE),
                     ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n),
                     ("WARC-Segment-Total-Length", len(block) if n == last else None)],
                    block[(n - 1) * segment_bytes:n * segment_bytes]))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_archives(rows: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES,
                   records_per_file: int = 50_000) -> None:
    """Write ``rows`` (key, url, payload; strings and binary, all may be null) as gzipped WARC files below ``path``.

    Of rows with equal payloads of at least 1000 bytes the one with the largest key is a response and
    the others revisit it; shorter ones are all responses. Keys are compared as they are given (as
    numbers if numeric); rows repeating that key and payload are all responses; where all keys are
    null, all are. A null payload is empty. Only digests are grouped; the payload moves once, to its
    digest's decision.
    """
    payload = F.coalesce(F.col("payload"), F.lit(b""))
    rows = rows.select("key", "url", payload.alias("payload")).withColumn(
        "_sha", F.when(F.octet_length("payload") >= REVISIT_FROM, F.sha1("payload")))
    first = (rows.filter("_sha is not null").groupBy("_sha")
             .agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("key", "url")).alias("_to"))
             .filter("_n > 1").select("_sha", "_to"))
    revisit = F.col("_to.key").isNotNull() & ~F.col("key").eqNullSafe(F.col("_to.key"))
    told = rows.join(first, "_sha", "left").select(
        F.col("key").cast("string"), "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("_to.key").cast("string")).alias("to_key"), F.when(revisit, F.col("_to.url")).alias("to_url"))
    lines = told.mapInArrow(lambda it: _records(segment_bytes, it), "value binary")
    (lines.select(F.col("value").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


RECORDS = ("record_id string, kind string, target_uri string, key string, refers_to_key string, digest string, "
           "length long, segment int, origin string, total long, block binary")
_RECORDS = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("target_uri", pa.string()),
                      ("key", pa.string()), ("refers_to_key", pa.string()), ("digest", pa.string()),
                      ("length", pa.int64()), ("segment", pa.int32()), ("origin", pa.string()), ("total", pa.int64()),
                      ("block", pa.binary())])


#: Kind of what an archive holds that is no whole record.
DAMAGED = "damaged"


def parse_archive(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of an uncompressed WARC stream; header names in lower case.

    What is no record, has no readable length or is cut short comes as a record of type ``damaged`` without a
    block, with the headers that could be read; reading goes on at the next line that starts a record.
    """
    line = b""
    lost = False  # inside what is no record
    try:
        while True:
            line = line or stream.readline()
            if not line:
                return
            start, line = line, b""
            if not start.strip():
                continue
            if not start.startswith(b"WARC/"):
                if not lost:
                    yield {"warc-type": DAMAGED}, b""
                lost = True
                continue
            headers, lost = {}, False
            while (line := stream.readline()).strip() and not line.startswith(b"WARC/"):
                k, _, v = line.partition(b":")
                headers[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
            ended, length = not line.startswith(b"WARC/"), headers.get("content-length", "")
            if not ended or not LENGTH.fullmatch(length):
                yield headers | {"warc-type": DAMAGED}, b""
                lost = ended
                line = b"" if ended else line
                continue
            line = b""
            block = stream.read(int(length))
            if len(block) != int(length):
                yield headers | {"warc-type": DAMAGED}, b""
                return
            yield headers, block
    except (EOFError, OSError, zlib.error):  # the compressed stream itself is damaged: its rest can't be read
        yield {"warc-type": DAMAGED}, b""


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    whole = lambda v: int(v) if v is not None and LENGTH.fullmatch(v) else None
    for batch in batches:
        for i in range(batch.num_rows):
            content = batch.column(0)[i].as_py()
            stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
            rows, held = [], 0
            for h, block in parse_archive(io.BufferedReader(stream, 1 << 16)):
                segment = whole(h.get("warc-segment-number")) if h.get("warc-type") != DAMAGED else None
                if h.get("warc-type") == "continuation" and not segment:
                    h["warc-type"] = DAMAGED  # it belongs nowhere
                rows.append({"record_id": h.get("warc-record-id"), "kind": h.get("warc-type"),
                             "target_uri": h.get("warc-target-uri"), "key": h.get("x-key"),
                             "refers_to_key": h.get("x-refers-to-key"), "digest": h.get("warc-payload-digest"),
                             "length": whole(h.get("x-payload-length")), "segment": segment if segment is None or segment < 1 << 31 else (1 << 31) - 1,
                             "origin": h.get("warc-segment-origin-id"), "total": whole(h.get("warc-segment-total-length")),
                             "block": block})
                held += len(block)
                if held >= 8 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


PAGES = ("record_id string, kind string, target_uri string, key string, refers_to_key string, payload binary, "
         "payload_bytes long, payload_digest string, status string")
_PAGES = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("target_uri", pa.string()),
                    ("key", pa.string()), ("refers_to_key", pa.string()), ("payload", pa.binary()),
                    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("status", pa.string())])


def sha1_of(digest: str | None) -> str | None:
    """The lower-case hex of a SHA-1 digest header in base 32 or hex; None if it has another form."""
    value = (digest or "").rpartition(":")[2].strip()
    if re.fullmatch("[0-9A-Fa-f]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", value) else None


def _open_record(row: dict, keep_payload: bool) -> dict:
    out = {c: row[c] for c in ("record_id", "kind", "target_uri", "key", "refers_to_key")}
    said = sha1_of(row["digest"])
    unread = row["digest"] is not None and said is None
    bad = {"payload": None, "payload_bytes": None, "payload_digest": None}
    if row["kind"] == DAMAGED:
        return out | bad | {"status": "record damaged"}
    if row["kind"] == "revisit":  # the payload is that of the record it refers to
        return out | {"payload": None, "payload_bytes": row["length"], "payload_digest": said,
                      "status": "digest unreadable" if unread else "ok"}
    numbers, block = row["numbers"], b"".join(row["parts"])
    if numbers and numbers != list(range(1, len(numbers) + 1)):
        return out | bad | {"status": "segment missing"}
    if numbers and row["total"] != len(block):
        return out | bad | {"status": "total length differs"}
    head, _, body = block.partition(b"\r\n\r\n")
    try:
        payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError:
        return out | bad | {"status": "transfer framing broken"}
    digest = hashlib.sha1(payload).hexdigest()
    return out | {"payload": payload if keep_payload else None, "payload_bytes": len(payload), "payload_digest": digest,
                  "status": "digest unreadable" if unread else "ok" if said in (None, digest) else "digest differs"}


def _reassemble(keep_payload: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held = [], 0
        for i in range(batch.num_rows):
            rows.append(_open_record({c: batch.column(c)[i].as_py() for c in batch.schema.names}, keep_payload))
            held += rows[-1]["payload_bytes"] or 0 if keep_payload else 100
            if held >= 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=_PAGES)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_PAGES)


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The response and revisit records of the WARC files below ``path``, reassembled, decoded and verified.

    One row per record: key, target_uri, kind, refers_to_key, payload (null for revisits, which carry
    the digest and length of the payload they refer to), payload_bytes, payload_digest (hex SHA-1) and
    status: ok, segment missing, total length differs, transfer framing broken, digest differs, digest unreadable
    (neither base 32 nor hex) or record damaged (kind damaged: no record, no length, or cut short; no row fails the job).
    An archive is read by one task, record by record; only segmented records are shuffled.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    records = files.mapInArrow(_parse, RECORDS)
    kept = ["record_id", "kind", "target_uri", "key", "refers_to_key", "digest", "length"]
    single = records.filter(f"segment is null and kind in ('response', 'revisit', '{DAMAGED}')").select(
        *kept, F.lit(None).cast("long").alias("total"), F.array("block").alias("parts"),
        F.lit(None).cast("array<int>").alias("numbers"))
    parts = records.filter("segment is not null").withColumn("_origin", F.coalesce("origin", "record_id"))
    ordered = F.array_sort(F.collect_list(F.struct("segment", "block")))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c)))
    joined = (parts.groupBy("_origin").agg(*[first(c).alias(f"_{c}") for c in kept], F.max("total").alias("total"),
                                           ordered.alias("_parts"))
              .select(F.col("_origin").alias("record_id"), F.coalesce("_kind", F.lit("response")).alias("kind"),
                      *[F.col(f"_{c}").alias(c) for c in kept[2:]], "total", F.col("_parts.block").alias("parts"),
                      F.col("_parts.segment").alias("numbers")))
    return single.unionByName(joined).mapInArrow(lambda it: _reassemble(keep_payload, it), PAGES)
