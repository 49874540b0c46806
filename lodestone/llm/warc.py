"""WARC archives: writing with segments, revisits and chunked transfer framing, and reading back with reassembly.

Archives are written with Spark's text writer (a record's end mark is the line separator) and read with its binary
source, so any store that Spark knows will do. Only records in several segments are shuffled, by origin.
"""

from __future__ import annotations

import hashlib
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import spread_join, stored
from lodestone.storage import scratch

#: Bytes of a record's block; longer blocks continue in further records.
SEGMENT = 16_384
#: Bytes of a chunk of the transfer framing.
CHUNK = 4_096
#: Payloads from this length on are written once.
DEDUP_BYTES = 1000
#: Records in a file: with SEGMENT, a bound of a file's size in a reader's memory.
FILE_RECORDS = 1_000

_PARSED = "kind string, id string, origin string, number int, total long, refers_to string, digest string, block binary, payload_bytes long, payload_digest string, complete boolean"


def _pieces(data: Column, size: int) -> Column:
    """Slices of ``size`` bytes of a binary column, as (number from 0, slice)."""
    n = F.greatest(F.ceil(F.octet_length(data) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.substring(data, i * size + 1, F.lit(size)).alias("part")))


def _chunked(payload: Column) -> Column:
    """The payload in chunked transfer framing, as a string of raw bytes."""
    framed = F.transform(F.filter(_pieces(payload, CHUNK), lambda p: F.octet_length(p["part"]) > 0), lambda p: F.concat(F.lower(F.hex(F.octet_length(p["part"]))), F.lit("\r\n"), p["part"].cast("string"), F.lit("\r\n")))
    return F.concat(F.array_join(framed, ""), F.lit("0\r\n\r\n"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) under ``path``, in gzip files.

    Of equal payloads of at least DEDUP_BYTES, that of the largest page_id is the response and the others revisit it.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(
        "page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"), html.alias("payload"), F.sha1(html).alias("digest"),
    )
    rows = rows.withColumn("id", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.lower(F.hex(F.xxhash64("url", "payload"))), F.lit(">")))
    long = rows.where(F.octet_length("payload") >= DEDUP_BYTES)
    kept = long.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "id")).alias("top")).where(F.col("n") > 1)
    kept = stored(kept.select(F.col("digest").alias("digest_long"), F.col("top.page_id").alias("top"), F.col("top.id").alias("top_id")), "kept")
    rows = rows.withColumn("digest_long", F.when(F.octet_length("payload") >= DEDUP_BYTES, F.col("digest")))
    rows = spread_join(rows, kept, "digest_long", ["id"])
    again = F.coalesce(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.lit(False))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n")
    block = F.when(again, http).otherwise(F.concat(http, _chunked(F.col("payload")))).cast("binary")
    rows = rows.select("id", "url", "digest", "top_id", again.alias("again"), block.alias("block"))
    rows = rows.select("id", "url", "digest", "top_id", "again", F.octet_length("block").alias("total"), F.explode(_pieces(F.col("block"), SEGMENT)).alias("p"))
    number, split = F.col("p.i") + 1, F.col("total") > SEGMENT
    line = lambda name, value, on=F.lit(True): F.when(on, F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")
    first, last = number == 1, (F.col("p.i") + 1) * SEGMENT >= F.col("total")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(~first, "continuation").when(F.col("again"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.when(first, F.col("id")).otherwise(F.concat(F.rtrim(F.col("id"), F.lit(">")), F.lit("#"), number.cast("string"), F.lit(">")))),
        line("WARC-Date", F.lit(datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))),
        line("WARC-Target-URI", F.col("url")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")), first),
        line("WARC-Refers-To", F.col("top_id"), F.col("again")),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.col("again")),
        line("WARC-Segment-Number", number, split),
        line("WARC-Segment-Origin-ID", F.col("id"), ~first),
        line("WARC-Segment-Total-Length", F.col("total"), split & last),
        line("Content-Length", F.octet_length("p.part")), F.lit("\r\n"),
    )
    record = F.concat(head, F.col("p.part").cast("string")).alias("value")
    rows.select(record).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def unpacked(data: bytes) -> tuple[bytes, bool]:
    """Of an archive in gzip members, or none, what can be read, and whether that is all."""
    if data[:2] != b"\x1f\x8b":
        return data, True
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data) + member.flush())
        except zlib.error:
            return b"".join(out), False
        if not member.eof:
            return b"".join(out), False
        data = member.unused_data
    return b"".join(out), not data.strip(b"\0")


def records(data: bytes):
    """Headers (names in lower case) and block of each record of an archive, and whether it was well-formed.

    What stands between records, a header that breaks off and a block without a usable length are records without
    headers or with those that are there, and not well-formed; reading goes on at the next line that begins a record.
    """
    at = 0
    while at < len(data):
        mark = data.find(b"\r\nWARC/", at)
        beyond = len(data) if mark < 0 else mark + 2
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            if data[at:beyond].strip():
                yield {}, data[at:beyond], False
            at = beyond
            continue
        lines = [x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]]
        head = {name.strip().lower(): value.strip() for name, colon, value in lines if colon}
        size = head.get("content-length", "")
        if size.isascii() and size.isdigit():
            block = data[end + 4 : end + 4 + int(size)]
            yield head, block, len(block) == int(size) and "warc-type" in head and "warc-record-id" in head
            at = end + 4 + int(size)
            while data.startswith(b"\r\n", at):
                at += 2
        else:
            mark = data.find(b"\r\nWARC/", end)
            at = len(data) if mark < 0 else mark + 2
            yield head, data[end + 4 : at], False


def payload(block: bytes) -> tuple[bytes, bool]:
    """The body of an HTTP block, its transfer framing undone, and whether it was whole."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body, bool(mark)
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        digits = body[at:end].split(b";")[0].strip()
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            break
        size = int(digits, 16)
        if not size:
            return b"".join(out), True
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out), False


def _decoded(block: bytes, whole: bool = True) -> tuple[int, str, bool]:
    body, ok = payload(block)
    return len(body), hashlib.sha1(body).hexdigest(), ok and whole


def _batch(rows: list[dict], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema(list(fields.items())))


_FIELDS = {"kind": pa.string(), "id": pa.string(), "origin": pa.string(), "number": pa.int32(), "total": pa.int64(), "refers_to": pa.string(), "digest": pa.string(), "block": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "complete": pa.bool_()}


def _number(text: str | None) -> int | None:
    """A count of a header; null if there is none, or no number."""
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 10 else None


def _parse(batches):
    for b in batches:
        for data in b.column("content"):
            rows = []
            archive, whole = unpacked(data.as_py())
            for head, block, good in records(archive):
                kind, id_ = head.get("warc-type"), head.get("warc-record-id")
                number = _number(head.get("warc-segment-number"))
                row = {
                    "kind": kind if kind in ("response", "revisit", "continuation") or kind and good else "broken", "id": id_, "origin": head.get("warc-segment-origin-id", id_), "number": number or 0,
                    "total": _number(head.get("warc-segment-total-length")), "refers_to": head.get("warc-refers-to"), "digest": head.get("warc-payload-digest", "").removeprefix("sha1:"),
                }
                if number and good:
                    row["block"] = block
                elif row["kind"] != "revisit":
                    row["payload_bytes"], row["payload_digest"], row["complete"] = _decoded(block, good)
                rows.append(row)
            if not whole:
                rows.append({"kind": "broken", "number": 0, "digest": "", "payload_bytes": 0, "payload_digest": hashlib.sha1(b"").hexdigest(), "complete": False})
            if rows:
                yield _batch(rows, _FIELDS)


def _join_segments(batches):
    names = ("origin", "copies", "digest", "payload_bytes", "payload_digest", "complete")
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_())
    for b in batches:
        rows = []
        for r in b.to_pylist():
            parts = {s["number"]: s["block"] for s in r["segments"]}
            block = b"".join(parts[k] for k in sorted(parts))
            whole = sorted(parts) == list(range(1, len(parts) + 1)) and len(block) == r["total"]
            rows.append(dict(zip(names, (r["origin"], r["copies"], r["digest"], *_decoded(block, whole)), strict=True)))
        yield _batch(rows, dict(zip(names, types, strict=True)))


def read_archives(docs_path: str, spark) -> DataFrame:
    """A row for each response or revisit under the path: id, kind, refers_to, payload_bytes, payload_digest, complete.

    Continuation records are grouped by origin, ordered by segment number, checked against the total length and
    decoded. ``complete`` is false where segments miss, the length differs, framing breaks off or the digest differs.
    A revisit has the payload of the record that it refers to. What can't be read as a record, and the rest of an
    archive that breaks off, is a row of kind ``broken``, its id null if there is none. Records of other types
    (warcinfo, request, metadata and so on) are passed over. A file is read whole, by one task.
    """
    files = spark.read.format("binaryFile").load(docs_path).select("content")
    parsed = stored(files.mapInArrow(_parse, _PARSED), "records")
    segments = parsed.where(F.col("block").isNotNull()).groupBy("origin").agg(
        F.max("total").alias("total"), F.sum((F.col("number") == 1).cast("long")).alias("copies"), F.max("digest").alias("digest"),
        F.collect_set(F.struct("number", "block")).alias("segments"),
    )
    joined = segments.mapInArrow(_join_segments, "origin string, copies long, digest string, payload_bytes long, payload_digest string, complete boolean")
    joined = joined.select("*", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)).cast("int"))))
    columns = ["id", "digest", "payload_bytes", "payload_digest", "complete"]
    whole = parsed.where((F.col("kind") == "response") & F.col("block").isNull()).select(*columns)
    broken = parsed.where(F.col("kind").isin("broken", "continuation") & F.col("block").isNull())
    responses = stored(whole.unionByName(joined.withColumnRenamed("origin", "id").select(*columns)), "responses")
    responses = responses.withColumn("complete", F.col("complete") & (F.col("digest") == F.col("payload_digest")))
    again = parsed.where(F.col("kind") == "revisit").select("id", "refers_to")
    of = responses.dropDuplicates(["id"]).select(F.col("id").alias("refers_to"), "payload_bytes", "payload_digest", "complete")
    of = stored(of.join(again.select("refers_to").distinct(), "refers_to", "left_semi"), "referred")
    again = spread_join(again, of, "refers_to", ["id"]).withColumn("complete", F.coalesce("complete", F.lit(False)))
    out = responses.select("id", F.lit("response").alias("kind"), F.lit(None).cast("string").alias("refers_to"), "payload_bytes", "payload_digest", "complete")
    broken = broken.select("id", F.lit("broken").alias("kind"), F.lit(None).cast("string").alias("refers_to"), "payload_bytes", "payload_digest", F.lit(False).alias("complete"))
    return out.unionByName(again.select("id", F.lit("revisit").alias("kind"), "refers_to", "payload_bytes", "payload_digest", "complete")).unionByName(broken)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder and read them back.

    For each row: page_id, payload_bytes, payload_digest, record_type, refers_to, complete. A null payload counts as
    empty. Repeated rows keep their rows; a row without id revisits like any other, and rows of equal payload of which
    none has an id are all responses. Other columns are not read.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*):", 1), F.lit("")).cast("long")
    found = read_archives(path, spark)
    return found.select(number("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), number("refers_to").alias("refers_to"), "complete")
