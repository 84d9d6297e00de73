"""WARC archives: records written by Spark's text writer, read back by a salvage reader.

Every page becomes one record. Of pages with equal payloads of at least ``REVISIT_BYTES``
the one of the largest id is a ``response`` with the payload; the others are ``revisit``
records that refer to it and carry digest and length of the full payload. A record ends in an
empty line, whose last line feed is the writer's own line separator, so the part files are
plain WARC/1.1 files.

The reader walks through plain records and gzip members. Where a record's lines, its length,
its end or the digest of its payload fail, it searches for the next version line or gzip
member that does hold, goes on from there, and reports the bytes between as a gap.

Cases: a null html is an empty payload; a null id or URL leaves its field out, and comes back
as null; line breaks in a URL are taken out of its header; repeated pages are records of their
own (rows with the same largest id are all responses); payloads may hold anything, version
lines too; an empty table writes no record; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from topicloom.scratch import materialize, new_path

REVISIT_BYTES = 1000
#: Uncompressed bytes of a file (expected), so that a reader's row stays small.
FILE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "kind string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, start long, length long"


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """page_id, record: one record per page, as text without its last line feed."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("_payload")).withColumn(
        "_digest", F.sha1(F.col("_payload").cast("binary"))
    )
    size = F.octet_length("_payload")
    copies = (
        rows.filter(size >= REVISIT_BYTES).groupBy("_digest")
        .agg(F.max("page_id").alias("_response"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    )
    copies = materialize(copies, "warc-copies")
    joined = rows.join(copies, "_digest", "left")
    revisit = F.coalesce(
        F.col("_response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_response")), F.lit(False)
    )
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("_payload")))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", F.coalesce(_urn(F.col("page_id")), F.lit("<urn:page:>"))),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        _field("WARC-Refers-To", F.when(revisit, _urn(F.col("_response")))),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _field("X-Payload-Length", F.when(revisit, size.cast("string"))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF), block, F.lit(f"{CRLF}\r"),
    )
    return joined.select("page_id", record.alias("record"))


def write(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write the archives below ``path``, in files of about ``file_bytes``."""
    # Files are bounded by a number of records of average size, which needs no shuffle.
    mean = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)) + 600)).first()[0] or 600
    records(pages).select("record").write.option("lineSep", "\n").option(
        "maxRecordsPerFile", max(1, int(file_bytes // mean))
    ).text(path)


def _headers(data: bytes, start: int) -> tuple[dict[str, str], int] | None:
    end = data.find(b"\r\n\r\n", start)
    if end < 0:
        return None
    first, *lines = data[start:end].split(b"\r\n")
    if not first.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields, end + 4


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.removeprefix("-").isdigit() else None


def _record(data: bytes, start: int) -> tuple[dict, int] | None:
    """The record at ``start`` and where it ends, or None where a check fails."""
    found = _headers(data, start)
    if found is None:
        return None
    fields, at = found
    length = fields.get("content-length", "")
    if not length.isdigit():
        return None
    end = at + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    head = data.find(b"\r\n\r\n", at, end)
    if head < 0:
        return None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields.get("warc-type")
    if kind == "response":
        payload = data[head + 4 : end]
        if hashlib.sha1(payload).hexdigest() != digest:
            return None
        size = len(payload)
    elif kind == "revisit" and fields.get("x-payload-length", "").isdigit():
        size = int(fields["x-payload-length"])
    else:
        return None
    return {
        "kind": "record", "page_id": _page(fields.get("warc-record-id")), "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")),
    }, end + 4


def _member(data: bytes, start: int) -> tuple[bytes, int] | None:
    """A whole gzip member and where it ends, or None where its checks fail."""
    unzip = zlib.decompressobj(31)
    try:
        out = unzip.decompress(memoryview(data)[start:])
    except zlib.error:
        return None
    return (out, len(data) - len(unzip.unused_data)) if unzip.eof else None


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive, in order, with start and length in its bytes."""
    at, bad = 0, None

    def gap(start: int, end: int) -> dict:
        return {"kind": "gap", "start": start, "length": end - start}

    while at < len(data):
        good = None
        if data.startswith(b"WARC/1.", at):
            if (found := _record(data, at)) is not None:
                good = [found[0]], found[1]
        elif data.startswith(b"\x1f\x8b", at) and (member := _member(data, at)) is not None:
            inner = [x for x in salvage(member[0]) if x["kind"] == "record"]
            if inner:
                good = inner, member[1]
        if good:
            if bad is not None:
                yield gap(bad, at)
                bad = None
            for x in good[0]:
                yield x | {"start": at, "length": good[1] - at}
            at = good[1]
            continue
        bad = at if bad is None else bad
        after = [x for x in (data.find(b"WARC/1.", at + 1), data.find(b"\x1f\x8b\x08", at + 1)) if x >= 0]
        at = min(after, default=len(data))
    if bad is not None:
        yield gap(bad, len(data))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records and gaps of the archives below ``path``; see ``RECORD``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string() if x.split()[1] == "string" else pa.int64() for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file = batch.column(0)[i].as_py()
                rows = [x | {"file": file} for x in salvage(batch.column(1)[i].as_py())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names=names
                )

    return files.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archive the pages and return what the reader finds in the archives."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(pages, path)
    return read(spark, path).filter("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
