"""WARC archives: writing with segmented records, reading with segment reassembly.

``write_archives`` makes one WARC/1.1 record per row.  A response carries an HTTP message
whose body is in chunked transfer framing; a record block longer than ``SEGMENT`` bytes is
cut into a first record and continuation records (WARC-Segment-Number, WARC-Segment-Origin-ID
and, in the last, WARC-Segment-Total-Length).  ``read_archives`` groups the continuations by
their origin, orders them by number, verifies the total length and undoes the framing.

Archives are gzip files of at most ``FILE_RECORDS`` records in the shared folder, written and
read by Spark alone, so any file system that Spark knows will do.  Writing uses DataFrame
functions only.  Records that need no reassembly are not shuffled.

A null payload is an empty one; a null id has no header and reads back as null; rows tied on
the smallest id of equal payloads are all responses; line breaks in urls are removed.  Each row
gives one row, repeated rows too; an empty table gives none; other columns are ignored.  Memory
follows the longest payload, and the records of a file.

Nothing that stands in an archive ends a job.  A record of which segments are missing or have
the wrong length, whose framing is broken or whose digest does not agree reads back with
``complete`` false and no payload.  So does one whose header or length is damaged, or that ends
with its file too early; reading goes on at the next record that begins after an empty line.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import new_path

SEGMENT = 16 << 10
CHUNK = 8 << 10
FILE_RECORDS = 2000
#: Smaller payloads are never revisits.
REVISIT_BYTES = 100
CRLF = "\r\n"
_END = b"\r\n\r\n"


def _pieces(value: str, size: int) -> str:
    """SQL for the array of a binary value's pieces; empty for an empty value."""
    return f"transform(if(octet_length({value}) = 0, array(), sequence(0L, (octet_length({value}) - 1) div {size})), i -> substring({value}, cast(i * {size} + 1 as int), {size}))"


def mark_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """The rows with payload (binary), payload_bytes, payload_digest, record_type and refers_to."""
    rows = pages.drop(*({"payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "first_id", "n"} - {id_col, payload_col}))
    rows = rows.withColumn("payload", F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b"")))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    # only digests that occur again, so that the side to join is small
    seen = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min(id_col).alias("first_id"), F.count("*").alias("n"))
    seen = seen.where("n > 1").drop("n")
    again = F.col("first_id").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("first_id"))
    rows = rows.join(seen, "payload_digest", "left")
    return rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first_id"))).drop("first_id")


def write_archives(rows: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", date: str = "2020-01-01T00:00:00Z") -> None:
    """Write rows as ``mark_revisits`` gives them."""
    header = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))).otherwise("")
    url = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]", "")
    is_response = F.col("record_type") == "response"
    http = F.when(is_response, F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}"))
    http = http.otherwise(F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF)))
    framed = "transform(chunks, c -> concat(encode(lower(hex(octet_length(c))), 'UTF-8'), encode('\\r\\n', 'UTF-8'), c, encode('\\r\\n', 'UTF-8')))"
    out = rows.select(F.col(id_col).alias("id"), url.alias("url"), "record_type", "refers_to", "payload_digest", "payload", F.encode(http, "UTF-8").alias("http"), F.uuid().alias("uuid"))
    out = out.withColumn("chunks", F.expr(_pieces("payload", CHUNK))).withColumn("body", F.when(is_response, F.concat(F.expr(f"array_join(transform({framed}, x -> hex(x)), '')"), F.lit("300D0A0D0A"))).otherwise(""))
    out = out.select("id", "url", "record_type", "refers_to", "payload_digest", "uuid", F.concat("http", F.unhex("body")).alias("block"))
    out = out.withColumn("total", F.octet_length("block")).withColumn("parts", F.expr(_pieces("block", SEGMENT)))
    out = out.select("*", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("k", "part")).drop("parts", "block")
    first, cut = F.col("k") == 0, F.col("n_parts") > 1
    named = lambda s: F.concat(F.lit("<urn:uuid:"), s, F.lit(">"))
    text = F.concat(
        F.lit("WARC/1.1" + CRLF),
        header("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        header("WARC-Record-ID", F.when(first, named(F.col("uuid"))).otherwise(named(F.concat_ws("-", "uuid", "k")))),
        F.lit(f"WARC-Date: {date}{CRLF}"),
        header("WARC-Target-URI", F.col("url")),
        header("WARC-Page-ID", F.when(first, F.col("id"))),
        header("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha256:"), F.col("payload_digest")))),
        header("WARC-Refers-To-Page", F.when(first, F.col("refers_to"))),
        header("WARC-Profile", F.when(first & ~is_response, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        header("WARC-Segment-Number", F.when(cut, F.col("k") + 1)),
        header("WARC-Segment-Origin-ID", F.when(~first, named(F.col("uuid")))),
        header("WARC-Segment-Total-Length", F.when(cut & (F.col("k") == F.col("n_parts") - 1), F.col("total"))),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF),
        header("Content-Length", F.octet_length("part")),
        F.lit(CRLF),
    )
    record = F.concat(F.encode(text, "UTF-8"), F.col("part")).cast("string")
    # a record ends with two line breaks: the line separator of the text writer
    out.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _number(value: str | bytes | None, least: int = -1) -> int:
    """A plain whole number; least where it is none."""
    value = value.encode() if isinstance(value, str) else value or b""
    return int(value) if re.fullmatch(rb"[0-9]{1,18}", value) else least


def parse_records(data: bytes):
    """(headers by lower-case name, block) of each record of an archive; the block is None where the record is damaged."""
    at = 0
    while at < len(data):
        stop, headers = data.find(_END, at), {}
        if stop >= 0 and data.startswith(b"WARC/", at):
            for line in data[at:stop].split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        begin, length = stop + 4, _number(headers.get("content-length"))
        if length >= 0 and data[begin + length : begin + length + 4] == _END:
            yield headers, data[begin : begin + length]
            at = begin + length + 4
        else:
            yield headers, None
            again = data.find(_END + b"WARC/", at + 1)
            at = again + 4 if again >= 0 else len(data)


def unpacked(data: bytes) -> bytes:
    """The content of a gzip file of any number of members, as far as it can be read; other data as they are."""
    out = [] if data[:2] == b"\x1f\x8b" else [data]
    while data[:2] == b"\x1f\x8b" and not (out and out[-1] is data):
        member, at = zlib.decompressobj(31), 0
        try:
            while at < len(data) and not member.eof:
                out.append(member.decompress(data[at : at + (1 << 16)]))
                at += 1 << 16
        except zlib.error:
            break
        data = member.unused_data + data[at:]
    return b"".join(out)


def unchunk(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while (stop := body.find(b"\r\n", at)) >= 0:
        size = re.fullmatch(rb"([0-9A-Fa-f]{1,15})[ \t]*", body[at:stop].split(b";")[0])
        if not size:
            return None
        if not (size := int(size[1], 16)):
            return b"".join(out)
        at = stop + 2 + size
        if body[at : at + 2] != b"\r\n":
            return None
        out.append(body[stop + 2 : at])
        at += 2
    return None


def _decoded(block: bytes) -> tuple[bytes | None, int | None]:
    """Payload (None if broken) and stated length of an HTTP message."""
    head, _, body = block.partition(_END)
    headers = {n.strip().lower(): v.strip() for n, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    if headers.get(b"transfer-encoding", b"").lower() == b"chunked":
        return unchunk(body), None
    return body, _number(headers.get(b"content-length"), len(body))


_FIELDS = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary, complete boolean"


def _row(headers: dict, block: bytes | None) -> tuple:
    kind = headers.get("warc-type")
    payload, stated = (None, None) if block is None else _decoded(block)
    digest = headers.get("warc-payload-digest", "").rpartition(":")[2]
    if kind == "revisit":
        return headers.get("warc-page-id"), headers.get("warc-target-uri"), kind, headers.get("warc-refers-to-page"), digest, stated, None, block is not None
    whole = payload is not None and hashlib.sha256(payload).hexdigest() == digest
    return headers.get("warc-page-id"), headers.get("warc-target-uri"), kind, None, digest, len(payload) if whole else None, payload if whole else None, whole


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(),) * 5 + (pa.int64(), pa.binary(), pa.bool_())
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id and refers_to (strings), url, record_type, payload_digest, payload_bytes, payload (null for revisits), complete."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def archives(batches):
        for batch in batches:
            for content in batch.column(0):
                yield unpacked(content.as_py())

    def whole(batches):
        for data in archives(batches):
            rows = []
            for headers, block in parse_records(data):
                if "warc-segment-number" not in headers:
                    rows.append(_row(headers, block))
                    if len(rows) == 500:
                        yield _table(rows)
                        rows = []
            yield _table(rows)

    def segments(batches):
        for data in archives(batches):
            found = [(h.get("warc-segment-origin-id") or h.get("warc-record-id") or uuid.uuid4().hex, min(_number(h["warc-segment-number"]), 1 << 30), h, b) for h, b in parse_records(data) if "warc-segment-number" in h]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()), pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.string())), pa.array([f[3] for f in found], pa.binary())],
                names=["origin", "number", "headers", "part"],
            )

    def joined(batches):
        for batch in batches:
            rows = []
            for parts in batch.column(0).to_pylist():
                parts.sort(key=lambda p: p["number"])
                headers, last = dict(parts[0]["headers"]), dict(parts[-1]["headers"])
                block = b"".join(p["part"] or b"" for p in parts)
                numbers = [p["number"] for p in parts]
                ok = numbers == list(range(1, len(parts) + 1)) and all(p["part"] is not None for p in parts) and _number(last.get("warc-segment-total-length")) == len(block)
                rows.append(_row(headers, block if ok else None))
            yield _table(rows)

    # a group holds the segments of one record and no more
    cut = files.mapInArrow(segments, "origin string, number int, headers map<string, string>, part binary")
    cut = cut.groupBy("origin").agg(F.collect_list(F.struct("number", "headers", "part")).alias("parts")).select("parts")
    return files.mapInArrow(whole, _FIELDS).unionByName(cut.mapInArrow(joined, _FIELDS))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the pages, read them back: ``read_archives`` with ids of their own type."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(mark_revisits(pages.select(id_col, url_col, payload_col), id_col, payload_col), path, id_col, url_col)
    kind = pages.schema[id_col].dataType
    return read_archives(spark, path).withColumn("refers_to", F.col("refers_to").cast(kind)).withColumn("page_id", F.col("page_id").cast(kind)).withColumnRenamed("page_id", id_col)
