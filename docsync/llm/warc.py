"""WARC archives: write captures, read records back, assemble transactions.

A capture is three records: request, response (or revisit) and metadata. Request and metadata
name the response in WARC-Concurrent-To. Records of one capture may lie anywhere in an archive,
so reading yields records, and a join on the identifiers assembles them to a row per capture.

Archives are written by Spark's text writer, one record per line of the writer, ended by the
blank lines that end a record; so any file system that Spark knows will do. Files are kept
small, because a file is read as one value; records are told apart by Content-Length alone, so
a payload may hold anything.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync.session import fresh_dir, materialize

RECORD_END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
SALTS = 32
# Aim for the size of an archive file, by the mean payload.
FILE_BYTES = 64 << 20
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """SHA-1 in base 32, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def payload_digest(payload: Column) -> Column:
    """:func:`digest` of a text: five hexadecimal digits make four of base 32."""
    sha1 = F.sha1(F.coalesce(payload, F.lit("")).cast("binary"))
    parts = [F.lpad(F.conv(F.substring(sha1, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(kind: str, capture) -> str:
    """The same identifier each time a task writes the record."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind}:{capture}')}>"


def capture_name(page: Column, own_digest: Column, number: Column, repeated: Column) -> Column:
    """What record ids are made of: the page_id, if that repeats also the digest and a number among equals."""
    page = F.coalesce(page.cast("string"), F.lit("None"))
    return F.when(repeated, F.concat_ws(":", page, own_digest, number.cast("string"))).otherwise(page)


def one_line(text: str | None) -> str:
    """A header value: no line ends."""
    return " ".join((text or "").split())


def build_record(kind: str, headers: list[tuple[str, str]], block: str) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``(page_id, digest, bytes, repeated, refers_to, refers_repeated)``: of equal payloads all but the largest page_id refer to it.

    ``repeated`` tells whether the page_id comes more than once, ``refers_repeated`` the same of
    ``refers_to``. A null page_id is never referred to. The winner of each digest is a grouped
    maximum. A digest may hold a large part of all rows, so the winners of repeated digests are
    copied to ``SALTS`` salts and joined on both.
    """
    html = F.col("html").cast("string")
    digests = materialize(
        pages.select(
            F.col("page_id").cast("long").alias("page_id"), payload_digest(html).alias("digest"),
            F.coalesce(F.octet_length(html), F.lit(0)).cast("long").alias("bytes"),
        ),
        "digests",
    )
    many = digests.groupBy(F.col("page_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    many = many.withColumn("found", F.lit(True))
    digests = digests.join(many, F.col("page_id").eqNullSafe(F.col("id")), "left").select(
        "page_id", "digest", "bytes", F.coalesce("found", F.lit(False)).alias("repeated")
    )
    again = (
        digests.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes")
        .agg(F.max(F.struct("page_id", "repeated")).alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("digest", "bytes", "winner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = digests.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    refers = ~F.col("winner.page_id").eqNullSafe(F.col("page_id"))
    return salted.join(again, ["digest", "bytes", "salt"], "left").select(
        "page_id", "digest", "bytes", "repeated", F.when(refers, F.col("winner.page_id")).alias("refers_to"),
        F.when(refers, F.col("winner.repeated")).alias("refers_repeated"),
    )


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page, name, url, html, own_digest, refers_to, refers_name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            html, uri = html or "", one_line(url)
            base = [("WARC-Target-URI", uri), ("WARC-Date", DATE)]
            number = [] if page is None else [("X-Page-Id", str(page))]
            mine = [("WARC-Concurrent-To", record_id("response", name)), *number]
            out.append(build_record(
                "request",
                [("WARC-Record-ID", record_id("request", name)), *base, *mine, ("Content-Type", "application/http; msgtype=request")],
                f"GET {uri} HTTP/1.1\r\n\r\n",
            ))
            own = [
                ("WARC-Record-ID", record_id("response", name)), *base, *number,
                ("WARC-Payload-Digest", f"sha1:{own_digest}"), ("Content-Type", "application/http; msgtype=response"),
            ]
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html.encode())}\r\n\r\n"
            if refers_to is None:
                out.append(build_record("response", own, head + html))
            else:
                own += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("response", refers_name)), ("X-Refers-To-Page", str(refers_to))]
                out.append(build_record("revisit", own, head))
            out.append(build_record(
                "metadata",
                [("WARC-Record-ID", record_id("metadata", name)), *base, *mine, ("Content-Type", "application/warc-fields")],
                f"via: corpus\r\npayload-bytes: {len(html.encode())}\r\n",
            ))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archive ``pages(page_id, url, html)`` under ``path``, gzipped: three records per row.

    A null html is an empty payload, a null url an empty one. Of equal payloads of at least
    ``least_bytes`` bytes the largest page_id is a response and the others revisit it. Rows that
    repeat a page_id are captures of their own, with ids of their own; of equal payloads under the
    largest page_id each is a response, and one of them is the one revisited. A null page_id
    has no header; it refers to others, but is not referred to.
    """
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    known = revisits(pages, least_bytes)
    known = materialize(known.groupBy(*known.columns).agg(F.count(F.lit(1)).alias("equal")), "revisits")
    mean = known.agg(F.sum(F.col("bytes") * F.col("equal")) / F.sum("equal")).first()[0] or 0
    per_file = 3 * max(1, int(FILE_BYTES // (mean + 2000)))
    # One key, never null: the payloads are shuffled once, at every size, and numbered where they lie.
    def key(own_digest: Column) -> Column:
        return F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("None")), own_digest)

    sought = known.select(key(F.col("digest")).alias("key"), "refers_to", "repeated", "refers_repeated")
    own = pages.withColumn("digest", payload_digest(F.col("html"))).withColumn("key", key(F.col("digest")))
    rows = own.join(sought.hint("merge"), "key").withColumn(
        "number", F.expr("row_number() OVER (PARTITION BY key ORDER BY key)")
    )
    name = capture_name(F.col("page_id"), F.col("digest"), F.col("number"), F.col("repeated"))
    refers_name = capture_name(F.col("refers_to"), F.col("digest"), F.lit(1), F.col("refers_repeated"))
    rows = rows.select(
        "page_id", name.alias("name"), "url", "html", "digest", "refers_to", refers_name.alias("refers_name")
    )
    rows.mapInArrow(_records, "value string").write.option(
        "lineSep", RECORD_END
    ).option("compression", "gzip").option("maxRecordsPerFile", str(per_file)).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; gzip members are unpacked.

    A record that is cut short or has no usable length ends the file: what follows cannot be
    told apart.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        end = data.find(b"\r\n\r\n", at)
        if at < 0 or end < 0:
            return
        headers = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        length = headers.get("content-length", "")
        if not length.isdigit() or end + 4 + int(length) > len(data):
            return
        yield headers, data[end + 4 : end + 4 + int(length)]
        at = end + 4 + int(length)


RECORD = (
    "kind string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_digest string, headers map<string,string>, payload_bytes long, payload_sha1 string, payload binary"
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        *((n, pa.string()) for n in ("kind", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest")),
        ("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()),
        ("payload", pa.binary()),
    ])
    keys = ("warc-type", "warc-record-id", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest")
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for headers, block in parse_records(content.as_py() or b""):
                if headers.get("content-type", "").startswith("application/http"):
                    _, _, block = block.partition(b"\r\n\r\n")
                rows.append([*(headers.get(k) for k in keys), list(headers.items()), len(block), digest(block), block])
                size += len(block)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives below ``path``; http headers are cut off the payload.

    ``payload_bytes`` and ``payload_sha1`` are measured on what was read.
    A file is one value while it is parsed and must stay below 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("content").mapInArrow(_read, RECORD)


PARTS = ("record_id", "target_uri", "date", "payload_digest", "refers_to", "headers", "payload_bytes", "payload_sha1", "payload")


def captures(records: DataFrame, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """One row per capture: ``response``, ``request`` and ``metadata`` as nested columns.

    ``parts`` are the columns of the response to keep; without its payload little is shuffled.

    A capture is a response or revisit record; requests and metadata join it by their
    concurrent-to identifier, grouped to arrays (usually of one). Records that name no capture
    present in the archives are left out; of records with one identifier one counts.
    """
    cast = lambda kinds: records.where(F.col("kind").isin(*kinds))
    main = cast(["response", "revisit"]).select("record_id", "kind", F.struct(*parts).alias("response"))
    main = main.dropDuplicates(["record_id"])
    side = cast(["request", "metadata"]).where("concurrent_to IS NOT NULL").groupBy(F.col("concurrent_to").alias("record_id")).agg(
        *[
            F.collect_list(F.when(F.col("kind") == k, F.struct("record_id", "headers", "payload"))).alias(k)
            for k in ("request", "metadata")
        ]
    )
    return main.join(side, "record_id", "left")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives, read them back, assemble, and digest what was read."""
    spark = pages.sparkSession
    path = fresh_dir(spark, "warc")
    write_warc(pages, path)
    rows = captures(read_warc(spark, path), tuple(c for c in PARTS if c != "payload"))

    def number(header: str) -> Column:
        return F.col("response.headers")[header].try_cast("long")

    metadata = F.decode(F.col("metadata")[0]["payload"], "UTF-8")
    return rows.select(
        number("x-page-id").alias("page_id"),
        F.when(F.col("kind") == "response", F.col("response.payload_bytes"))
        .otherwise(F.regexp_extract(metadata, r"payload-bytes: (\d+)", 1)).cast("long").alias("payload_bytes"),
        F.when(F.col("kind") == "response", F.col("response.payload_sha1"))
        .otherwise(F.regexp_replace("response.payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        number("x-refers-to-page").alias("refers_to"),
        F.size("request").alias("n_requests"),
    )
