from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from pathlib import Path

import pytest

from panelyst.llm import warc
from panelyst.sources.sinks import shared_folder

LONG = "é<p>" * 60
ROWS = [
    (5, "http://a/", LONG),
    (3, "http://b/\r\nX: y", LONG),
    (9, None, LONG),
    (7, "http://c/", "short"),
    (8, "http://c/", "short"),
    (10, "http://d/", None),
    (11, "http://d/", ""),
    (12, "http://e/", "x\r\n\r\nWARC/1.1\n" * 20_000),
    (13, "http://f/", "y" * 100),
    (14, "http://f/", "y" * 100),
    (14, "http://f/", "y" * 100),
    (15, "http://g/", "z" * 99),
    (16, "http://g/", "z" * 99),
    (None, "http://h/", LONG),
]
SCHEMA = "page_id long, url string, html string"


def want(rows):
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        same = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        first = min(same) if len(raw) >= 100 and same else None
        revisit = first is not None and page_id != first
        kind = "revisit" if revisit else "response"
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), kind, first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, frame):
    out = warc.round_trip(frame(ROWS, SCHEMA), shared_folder(spark))
    assert out.columns == ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in out.drop("url").collect()), key=str) == want(ROWS)
    urls = {r["page_id"]: r["url"] for r in out.collect()}
    assert urls[9] is None and urls[3] == "http://b/ X: y"


def test_a_payload_that_most_pages_share_is_one_response(spark, frame):
    rows = [(i, f"http://{i}/", LONG if i % 3 else f"{i}" * 60) for i in range(400, 0, -1)]
    folder = shared_folder(spark)
    pages = frame(rows, SCHEMA, partitions=5)
    pages.write.parquet(f"{folder}/pages")
    for out in (
        warc.round_trip(pages, f"{folder}/copied"),
        warc.round_trip(spark.read.parquet(f"{folder}/pages"), f"{folder}/scanned", scan=True),
    ):
        assert sorted((tuple(r) for r in out.drop("url").collect()), key=str) == want(rows)
        assert out.where("record_type = 'revisit'").agg({"refers_to": "max"}).first()[0] == 1


def test_only_places_and_digests_are_shuffled(spark, frame):
    rows = warc.located(frame(ROWS, SCHEMA), [warc.F.col("page_id"), warc.F.col("html")], scan=False)
    found = warc.repeats(rows)
    assert found.columns == ["file", "row", "first_id"]
    assert "html" not in found._jdf.queryExecution().executedPlan().toString()


def test_each_record_is_a_member_that_the_index_finds(spark, frame):
    folder = shared_folder(spark)
    warc.round_trip(frame(ROWS, SCHEMA), folder).count()
    plain = Path(folder.removeprefix("file:"))
    whole = sum(len(gzip.decompress(p.read_bytes())) for p in (plain / "monolithic").glob("*.gz"))
    members = list((plain / "members").glob("*.warc.gz"))
    assert whole == sum(len(gzip.decompress(p.read_bytes())) for p in members)
    for entry in warc.read_index(spark, f"{folder}/members").collect():
        raw = (plain / "members" / entry["archive"]).read_bytes()[entry["offset"] : entry["offset"] + entry["length"]]
        record = zlib.decompress(raw, 31)
        assert record.startswith(b"WARC/1.1\r\n") and entry["record_id"].encode() in record and record.endswith(b"\r\n\r\n")
    assert not list((plain / "members").glob(".*"))


def test_empty_table(spark, frame):
    assert warc.round_trip(frame(ROWS, SCHEMA).where("false"), shared_folder(spark)).count() == 0


def test_broken_archives_are_errors():
    record = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    assert [p for _, p, _ in warc.records(io.BytesIO(gzip.compress(record * 3)))] == [b"abcde"] * 3
    assert len(list(warc.records(io.BytesIO(gzip.compress(record) * 3)))) == 3
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.records(io.BytesIO(gzip.compress(record[:-7]))))
    with pytest.raises(ValueError, match="not a WARC record"):
        list(warc.records(io.BytesIO(gzip.compress(b"hello\r\n" + record))))
    assert list(warc.records(io.BytesIO(b""))) == []
