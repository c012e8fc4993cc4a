"""WARC archives: writing captures and assembling transactions from what is read back.

A capture is written as three records: the response (or a revisit of an equal payload), and a request and
a metadata record that name it in ``WARC-Concurrent-To``.  Reading parses archives record by record, in
any order and from any file, and brings the records of a capture together by that identifier: one nested
row per capture.

Archives are gzip files of whole records, written by Spark's text sink with the record separator as line
separator, so they go to any file system that Spark knows.  ``records_per_file`` bounds a file, as a file
is what one task reads at once.  Payloads are shuffled once, to meet the first page with their digest (a
hot digest is split by the adaptive join); assembling shuffles headers only, unless ``payload`` is asked
for.

Defined cases: a null html is an empty payload; payloads under 100 bytes are never revisits; rows that
share the smallest page_id of a digest are all responses; a null page_id is never the smallest; repeated
rows are captures of their own; line breaks in a URL are percent-encoded, a null URL is empty; payloads
may hold any text, record separators included, as records are cut by length; an empty table writes and
reads no record; only page_id, url and html are read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import bound_batches, scratch_root

MIN_REVISIT = 100
RECORD = (
    "record_id string, record_type string, concurrent_to string, target_uri string, warc_date string, "
    "payload_digest string, payload_bytes long, payload binary, fields map<string,string>"
)


def _uuid(*parts: Column) -> Column:
    return F.regexp_replace(F.md5(F.concat_ws("|", *parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _record(headers: dict[str, Column], block: Column) -> Column:
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in headers.items()]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("\r\n", *lines, length), F.lit("\r\n\r\n"), block)


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes, and the first page of an equal payload, if there are several."""
    own = pages.select(pages["page_id"].alias("page_id"), F.coalesce(pages["url"], F.lit("")).alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    own = own.withColumns({"payload_digest": F.sha2("html", 256), "payload_bytes": F.octet_length("html").cast("long")})
    firsts = own.filter(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return own.join(firsts.filter("n > 1").drop("n"), "payload_digest", "left")


def write_archives(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", records_per_file: int = 30_000) -> None:
    rows = with_first(pages).withColumn("number", F.monotonically_increasing_id().cast("string"))
    revisit = F.col("first_id").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    ids = {k: _uuid(F.lit(k), F.col("payload_digest"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("number")) for k in ("capture", "request", "metadata")}
    shared = {"WARC-Date": F.lit(date), "WARC-Target-URI": uri}
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    capture = _record(
        {
            "WARC-Type": F.when(revisit, "revisit").otherwise("response"),
            "WARC-Record-ID": ids["capture"],
            **shared,
            "WARC-Profile": F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            "WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.col("payload_digest")),
            "Content-Type": F.lit("application/http;msgtype=response"),
        },
        F.concat(http, F.when(revisit, "").otherwise(F.col("html"))),
    )
    beside = {"WARC-Concurrent-To": ids["capture"], **shared}
    request = _record(
        {"WARC-Type": F.lit("request"), "WARC-Record-ID": ids["request"], **beside, "Content-Type": F.lit("application/http;msgtype=request")},
        F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\n\r\n")),
    )
    metadata = _record(
        {"WARC-Type": F.lit("metadata"), "WARC-Record-ID": ids["metadata"], **beside, "Content-Type": F.lit("application/warc-fields")},
        F.concat_ws("\r\n", F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.when(revisit, F.concat(F.lit("refers-to-page-id: "), F.col("first_id").cast("string"))), F.lit("")),
    )
    # One row per capture: the separator between records ends each but the last, which the sink ends.
    text = rows.select(F.concat_ws("\r\n\r\n", request, capture, metadata).alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, records_per_file // 3)).text(path)


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, with lower-case names, and block of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers.get("content-length", 0)))


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in lines.decode("utf-8", "replace").splitlines() if ":" in x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _described(headers: dict[str, str], block: bytes, payload: bool) -> dict:
    kind = headers.get("warc-type")
    out = {
        "record_id": headers.get("warc-record-id"), "record_type": kind, "concurrent_to": headers.get("warc-concurrent-to"),
        "target_uri": headers.get("warc-target-uri"), "warc_date": headers.get("warc-date"),
        "payload_digest": None, "payload_bytes": None, "payload": None, "fields": None,
    }
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            out |= {"payload_digest": hashlib.sha256(body).hexdigest(), "payload_bytes": len(body), "payload": body if payload else None}
        else:
            size = _fields(head).get("content-length")
            out |= {"payload_digest": headers.get("warc-payload-digest", "").partition(":")[2] or None, "payload_bytes": int(size) if size else None}
    elif kind == "metadata":
        out["fields"] = _fields(block)
    return out


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every record of the archives under ``path``, plain or gzip, as RECORD."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                raw = io.BytesIO(content)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
                rows, size = [], 0
                for headers, block in parse_records(stream):
                    rows.append(_described(headers, block, payload))
                    size += len(block)
                    if size > 4_000_000 or len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=columns).astype({"payload_bytes": "Int64"})
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype({"payload_bytes": "Int64"})

    bound_batches(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parsed, RECORD)


def assemble(records: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row per capture: capture_id, capture, requests, metadata (absent records: null, empty)."""
    kind = F.col("record_type")
    main = kind.isin("response", "revisit")
    own = F.struct("record_type", "target_uri", "warc_date", "payload_digest", "payload_bytes", *(["payload"] if payload else []))
    key = F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    return (
        records.groupBy(key.alias("capture_id"))
        .agg(
            F.max(F.when(main, own)).alias("capture"),
            F.collect_list(F.when(kind == "request", F.struct("record_id", "target_uri", "warc_date"))).alias("requests"),
            F.collect_list(F.when(kind == "metadata", F.struct("record_id", "fields"))).alias("metadata"),
        )
        .select("capture_id", "capture", "requests", "metadata")
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back and describe each capture."""
    spark = pages.sparkSession
    path = f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    captures = assemble(read_records(spark, path, payload=False), payload=False)
    noted = F.get("metadata", F.lit(0))["fields"]
    return captures.select(
        noted["page-id"].cast("long").alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"),
        noted["refers-to-page-id"].cast("long").alias("refers_to"),
    )


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest AS g, min(page_id) AS m FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN m IS NOT NULL AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m IS NOT NULL AND page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM d LEFT JOIN f ON payload_digest = g
"""
