import gzip
import io

from pyspark.sql import functions as F

from panelloom.llm import warc

PAGES = "page_id long, url string, html string"


def test_round_trip_of_awkward_payloads(spark):
    odd = "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 5
    rows = [
        (5, "http://a/\r\nb", odd), (3, None, odd), (9, "http://c", odd), (1, "http://d", "tiny"), (2, "http://e", "tiny"),
        (4, "http://f", None), (6, "http://g", ""), (7, "http://h", "é" * 60), (8, "http://i", "é" * 60), (8, "http://i", "é" * 60), (None, "u", odd),
    ]
    pages = spark.createDataFrame(rows, PAGES).withColumn("payload_digest", F.lit("clash"))
    got = sorted(((r.page_id or -1), r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    n = len(odd.encode())
    assert got == [
        (-1, n, "revisit", 3), (1, 4, "response", None), (2, 4, "response", None), (3, n, "response", None), (4, 0, "response", None),
        (5, n, "revisit", 3), (6, 0, "response", None), (7, 120, "response", None), (8, 120, "revisit", 7), (8, 120, "revisit", 7), (9, n, "revisit", 3),
    ]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_captures_are_nested_and_files_bounded(spark, tmp_path):
    rows = [(k, f"http://site/{k}", f"<p>{k}</p>" * 30) for k in range(20)]
    path = str(tmp_path / "out")
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), path, records_per_file=15)
    files = sorted((tmp_path / "out").glob("*.gz"))
    assert len(files) >= 4
    records = [h["warc-type"] for f in files for h, _ in warc.parse_records(io.BytesIO(gzip.decompress(f.read_bytes())))]
    assert sorted(set(records)) == ["metadata", "request", "response"] and len(records) == 60
    one = {r.capture.target_uri: r for r in warc.assemble(warc.read_records(spark, path)).collect()}
    assert len(one) == 20
    r = one["http://site/7"]
    assert bytes(r.capture.payload).decode() == rows[7][2] and len(r.requests) == len(r.metadata) == 1
    assert r.metadata[0].fields["page-id"] == "7"


def test_assembly_of_foreign_and_partial_captures(spark):
    kinds = [("a", "response", None), ("q1", "request", "a"), ("q2", "request", "a"), ("m", "metadata", "gone"), ("i", "warcinfo", None)]
    rows = [(i, k, c, "u", None, None, None, None, None) for i, k, c in kinds]
    got = {r.capture_id: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert len(got["a"].requests) == 2 and got["gone"].capture is None and len(got["gone"].metadata) == 1 and got["i"].capture is None
