"""WARC archives: writing segmented records and reassembling them.

Writing: a payload becomes an HTTP response with chunked transfer framing; a
record over the segment size is cut into a first record and continuation
records with the origin's id and their segment number.  Equal payloads of a
least size are written once, the others refer to the record with the least id.
Archives are written by Spark's text sink: a record is a row and the sink's
line separator is the blank line that ends a record.

Pages are numbered in a written table first: the numbers tell repeated pages
apart in record ids, and a revisit names the id of a record that is written.

Reading: archives are bounded in records, and records in size, so a file fits a
task.  Continuation records are grouped by origin id, ordered by segment
number, checked against the stated total length and for gaps, and the chunked
framing is decoded.

Edge cases: a null payload is empty; repeated rows with the same id and payload
are records of their own, all of them responses or all revisits; null ids are
revisits where another page has their payload; null addresses are empty; a record whose segments don't add up is
returned with ``complete`` false and what there is; an empty table writes an
empty archive; further columns are not read.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, map_rows, written

END = "\r\n\r\n"
SEGMENT_BYTES = 128 << 10
FILE_RECORDS = 512
CHUNK_BYTES = 16 << 10
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_rows(pages: DataFrame, page_id: str, payload: str, uri: str, least: int = 100, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row for each WARC record: ``record`` (binary, without its last blank line)."""
    raw = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{uri}`").alias("uri"), raw.alias("payload"), F.sha2(raw, 256).alias("digest"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "numbered-pages")
    large = F.octet_length("payload") >= least
    first = rows.filter(large).groupBy("digest").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = written(first.select("digest", F.col("f.id").alias("first"), F.col("f.row").alias("first_row"), "n"), "repeated-digests")
    none = [F.lit(None).cast(k).alias(c) for c, k in (("first", rows.schema["id"].dataType), ("first_row", "bigint"))]
    rows = join_hot(rows.filter(large), first, ["digest"], "n", rows.count(), "left").unionByName(rows.filter(~large).select("*", *none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, u, p, d, f, f_row, n in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                out += records(i, u, p, d, None if f_row is None or f == i else record_id(f, f_row), n, segment_bytes)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return rows.select("id", "uri", "payload", "digest", "first", "first_row", "row").mapInArrow(run, "record binary")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    for k in range(0, len(payload), size):
        part = payload[k : k + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload, or None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + n]
        if len(part) < n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        out.append(part)
        at = end + 4 + n


def record_id(page: int | None, *more: int) -> str:
    """A record's name: the page with the row's and the segment's number."""
    return f"<urn:page:{':'.join(map(str, ['null' if page is None else page, *more]))}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def records(page: int | None, uri: str | None, payload: bytes, digest: str, refers_to: str | None, row: int = 0, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The WARC records of one page, the first one first.

    ``row`` tells repeated pages apart in record ids; ``refers_to`` is the id
    of the record with the payload.
    """
    fields = [
        ("WARC-Record-ID", record_id(page, row)),
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\r\n]", " ", uri or "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        return [_record([*fields, ("WARC-Refers-To", refers_to), ("WARC-Profile", _PROFILE)], http)]
    block = http + chunked(payload)
    if len(block) <= segment_bytes:
        return [_record(fields, block)]
    out = [_record([*fields, ("WARC-Segment-Number", "1")], block[:segment_bytes])]
    starts = range(segment_bytes, len(block), segment_bytes)
    for n, k in enumerate(starts, 2):
        more = [("WARC-Record-ID", record_id(page, row, n)), ("WARC-Type", "continuation"), ("WARC-Date", "2024-01-01T00:00:00Z")]
        more += [("WARC-Segment-Number", str(n)), ("WARC-Segment-Origin-ID", record_id(page, row))]
        if n == len(starts) + 1:
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(more, block[k : k + segment_bytes]))
    return out


def write(pages: DataFrame, path: str, page_id: str = "page_id", payload: str = "html", uri: str = "url", least: int = 100, compression: str = "gzip") -> None:
    """Write archives with at most FILE_RECORDS records each into ``path``."""
    rows = record_rows(pages, page_id, payload, uri, least)
    (
        rows.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", END)
        .option("maxRecordsPerFile", FILE_RECORDS)
        .option("compression", compression)
        .text(path)
    )


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of an archive, gzip or plain."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, view = 0, memoryview(data)
    while True:
        at = data.find(b"WARC/1.", at)
        if at < 0:
            return
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = dict(x.split(": ", 1) for x in lines if ": " in x)
        n = int(head.get("Content-Length", 0))
        yield head, bytes(view[end + 4 : end + 4 + n])
        at = end + 4 + n


_SEGMENT = "origin string, segment int, total long, type string, uri string, digest string, n_bytes long, refers_to string, block binary"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record or segment in the archives of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in _SEGMENT.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in parse(content.as_py()):
                    total = head.get("WARC-Segment-Total-Length")
                    size = head.get("WARC-Payload-Length")
                    number = head.get("WARC-Segment-Number")
                    rows.append(
                        (
                            head.get("WARC-Segment-Origin-ID", head.get("WARC-Record-ID")),
                            int(number) if number else None,
                            int(total) if total else None,
                            head.get("WARC-Type"),
                            head.get("WARC-Target-URI"),
                            head.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None,
                            int(size) if size else None,
                            head.get("WARC-Refers-To"),
                            block,
                        )
                    )
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return files.mapInArrow(run, _SEGMENT)


_PAYLOAD = "payload binary, complete boolean"


def decode(blocks: DataFrame) -> DataFrame:
    """Replace ``block`` by ``payload``, its HTTP body with the framing undone."""
    keep = [c for c in blocks.columns if c != "block"]

    def make():
        def work(kinds, parts):
            for kind, b in zip(kinds, parts, strict=True):
                if b is None:
                    yield None, False
                    continue
                head, _, body = b.partition(b"\r\n\r\n")
                if kind == b"revisit":
                    yield None, True
                    continue
                framed = b"transfer-encoding: chunked" in head.lower()
                out = unchunked(body) if framed else body
                yield (body, False) if out is None else (out, True)

        return work

    return map_rows(blocks, ["type", "block"], _PAYLOAD, make, keep=keep)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each logical record: origin, type, uri, digest, n_bytes, refers_to, payload, complete.

    ``complete`` is false if segments are missing, lengths differ from the
    stated ones, the framing is broken or the payload's digest is another.
    Whole records never leave their task; only segments are shuffled.
    """
    rows = read_segments(spark, path)
    whole = rows.filter(F.col("segment").isNull()).withColumn("fits", F.lit(True))
    cut = rows.filter(F.col("segment").isNotNull())
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    parts = F.sort_array(F.collect_list(F.struct("segment", "block")))
    joined = cut.groupBy("origin").agg(
        F.max(F.when(F.col("type") != "continuation", F.col("type"))).alias("type"),
        *[first(c) for c in ("uri", "digest", "n_bytes", "refers_to", "total")],
        parts.alias("parts"),
    )
    block = F.concat_ws("", F.transform("parts", lambda p: p["block"].cast("string"))).cast("binary")
    joined = joined.withColumn("block", block)
    dense = F.size("parts") == F.element_at("parts", -1)["segment"]
    joined = joined.withColumn("fits", dense & (F.octet_length("block") == F.col("total")) & F.col("type").isNotNull())
    names = ["origin", "type", "uri", "digest", "n_bytes", "refers_to", "fits", "block"]
    done = decode(whole.select(names).unionByName(joined.select(names)))
    same = F.col("type") == "revisit"
    right = same | ((F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("n_bytes")))
    return done.select(
        "origin", "type", "uri", "digest", "n_bytes", "refers_to", "payload", (F.col("complete") & F.coalesce("fits", F.lit(False)) & F.coalesce(right, F.lit(False))).alias("complete")
    )


def resolved(records: DataFrame) -> DataFrame:
    """One row per record without payloads: origin, type, refers_to, payload_bytes, payload_digest, complete.

    Size and digest are of the payload read, for a revisit that of the record
    it refers to.  A revisit is complete if that record is there, complete and
    has the digest which the revisit states.  Incomplete records have neither.
    """
    size, digest = F.octet_length("payload").cast("bigint"), F.sha2("payload", 256)
    small = written(records.select("origin", "type", "refers_to", F.col("digest").alias("stated"), size.alias("payload_bytes"), digest.alias("payload_digest"), "complete"), "records")
    revisits = small.filter("type = 'revisit'").drop("payload_bytes", "payload_digest", "complete")
    wanted = revisits.groupBy("refers_to").agg(F.count(F.lit(1)).alias("n"))
    there = small.filter("type <> 'revisit'").select(F.col("origin").alias("refers_to"), "payload_bytes", "payload_digest", "complete")
    targets = written(there.dropDuplicates(["refers_to"]).join(wanted, "refers_to"), "referred-records")
    followed = join_hot(revisits, targets, ["refers_to"], "n", small.count(), "left")
    followed = followed.withColumn("complete", F.coalesce(F.col("complete") & (F.col("payload_digest") == F.col("stated")), F.lit(False)))
    out = small.filter("type <> 'revisit' or type is null").unionByName(followed)
    known = lambda c: F.when(F.col("complete"), F.col(c)).alias(c)
    return out.select("origin", "type", "refers_to", known("payload_bytes"), known("payload_digest"), "complete")


def page_of(record: Column) -> Column:
    return F.regexp_extract(record, r"^<urn:page:(-?\d+|null)(?::\d+)*>$", 1)
