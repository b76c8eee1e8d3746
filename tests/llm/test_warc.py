import hashlib

import pytest
from pyspark.sql import functions as F

from themeloom.llm import warc

PAGES = "page_id BIGINT, url STRING, html STRING"
LONG = "<p>" + "x" * 120


def captured(spark, scratch, rows, name="archives"):
    path = f"{scratch.root}/{name}"
    warc.write_archives(spark.createDataFrame(rows, PAGES), path, scratch)
    return warc.assemble(warc.read_records(spark, path)).collect()


def test_captures_come_back(spark, scratch):
    odd = ["a\r\n\r\nb", "\r\n\r\n", "\r\n", "tail\r\n", "tail\r\n\r\n", "\n", "WARC/1.1\r\nx\r\n\r\n", "é\u0000ß", "", None]
    rows = [(i, f"http://h/{i}", html) for i, html in enumerate(odd)]
    rows += [(20, "http://h/20\r\nX: y", LONG), (10, None, LONG), (30, "u", LONG), (40, "u", "short"), (50, "u", "short")]
    found = {r.metadata.page_id: r for r in captured(spark, scratch, rows)}
    assert set(found) == {r[0] for r in rows}
    for page, url, html in rows:
        data = (html or "").encode()
        got = found[page].response
        assert (got.payload_bytes, got.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        again = page in (20, 30)
        assert got.type == ("revisit" if again else "response")
        assert got.refers_to == (10 if again else None)
        assert got.payload == (None if again else data)
        assert found[page].request.concurrent_to == got.record_id == found[page].metadata.concurrent_to
        assert got.target_uri == (url and url.replace("\r\n", " "))


def test_repeats_missing_ids_and_empty_tables(spark, scratch):
    rows = [(1, "u", LONG)] * 2 + [(2, "u", LONG)] + [(None, "u", LONG)] * 2
    found = captured(spark, scratch, rows)
    kinds = sorted((r.metadata.page_id or 0, r.response.type, r.response.refers_to) for r in found)
    assert kinds == [(0, "response", None)] * 2 + [(1, "response", None)] * 2 + [(2, "revisit", 1)]
    assert captured(spark, scratch, [], "none") == []


def test_one_payload_in_a_third_of_the_pages(spark, scratch):
    rows = [(i, "u", LONG if i % 3 == 0 else f"{LONG}{i}") for i in range(300, 0, -1)]
    found = captured(spark, scratch, rows)
    revisits = {r.metadata.page_id for r in found if r.response.type == "revisit"}
    assert revisits == set(range(6, 301, 3))
    assert {r.response.refers_to for r in found} == {None, 3}


def test_clashing_columns_and_large_pages(spark, scratch):
    pages = spark.createDataFrame([(1, "u", "y" * 3_000_000 + "\r\n\r\n" * 1000)], PAGES)
    for name in ("capture", "payload_digest", "first_page", "value", "digest"):
        pages = pages.withColumn(name, F.lit("clash"))
    path = f"{scratch.root}/large"
    warc.write_archives(pages, path, scratch)
    row = warc.assemble(warc.read_records(spark, path)).first()
    assert row.response.payload_bytes == 3_004_000


def test_a_broken_archive_raises():
    whole = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50"
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.split_records(iter([("f", whole), ("f", b"abc")])))
    with pytest.raises(ValueError, match="no record"):
        list(warc.split_records(iter([("f", b"GET /")])))


def test_captures_without_all_records(spark):
    row = {c: None for c in ("target_uri", "page_id", "refers_to", "payload_digest", "payload_bytes", "payload", "fields")}
    rows = [
        {"type": "request", "record_id": "q", "concurrent_to": "r", **row},
        {"type": "metadata", "record_id": "m", "concurrent_to": None, **row},
        {"type": "warcinfo", "record_id": "w", "concurrent_to": None, **row},
    ]
    found = {r.capture_id: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert set(found) == {"r", "m"}
    assert found["r"].request.record_id == "q" and found["r"].response is None
