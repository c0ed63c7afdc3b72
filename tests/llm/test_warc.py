"""Archives: round trips, what is pushed down and skipped, and revisits."""

import gzip
import hashlib
import os
import uuid

import pytest
from pyspark.sql import functions as F

from lagweave.llm import warc

PAGES = [
    (1, "http://a.example/x", "<p>" + "same " * 300), (2, None, "<p>" + "same " * 300), (3, "http://b.example/\r\nInjected: yes", None), (4, "u", ""), (5, "u", "é天" * 600), (5, "u", "é天" * 600),
    (None, "u", "é天" * 600), (7, "u", "short"), (8, "u", "short"), (9, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40),
]


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/archive"


def brute(pages):
    out = []
    for page, _, html in pages:
        body = (html or "").encode()
        top = max((p for p, _, h in pages if (h or "").encode() == body and p is not None), default=None)
        again = len(body) >= 1000 and top is not None and page != top
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, folder, compression):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"key": F.lit(1), "response": F.lit("x"), "payload": F.lit(b"z"), "n": F.lit(0)})
    warc.archive(warc.page_records(df), folder, compression=compression)
    got = warc.page_digests(spark, folder)
    assert got.where("not intact").count() == 0
    assert sorted(str(tuple(r)[:5]) for r in got.collect()) == brute(PAGES)
    full = warc.read_warc(spark, folder)
    assert full.where("warc_type = 'warcinfo'").count() >= 1 and full.where("headers['injected'] is not null").count() == 0


def test_rows_of_an_empty_table(spark, folder):
    warc.archive(warc.page_records(spark.createDataFrame([], "page_id long, url string, html string")), folder)
    assert warc.page_digests(spark, folder).count() == 0


def test_predicates_are_pushed_down(spark, folder):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.archive(warc.page_records(df), folder)
    some = warc.read_warc(spark, folder, "warc_type string, page_id long, payload binary, file string")
    plain = spark.createDataFrame(some.collect(), some.schema)
    for condition in ("warc_type = 'response' and page_id > 4", "page_id in (1, 2)", "page_id is null", "warc_type like 'rev%'", "page_id is not null and page_id <= 3"):
        found = some.where(condition)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BatchScan" in plan and " Filter " not in plan, plan
        assert sorted(map(str, found.collect())) == sorted(map(str, plain.where(condition).collect()))
    assert some.where("length(payload) = 5").count() == 2  # a filter that stays with Spark


def test_unwanted_payloads_are_not_inflated(tmp_path):
    path = f"{tmp_path}/x.warc.gz"
    good = warc.gzip_member(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:a>")], b"payload"))
    bad = bytearray(warc.gzip_member(warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:b>")], os.urandom(50_000))))
    bad[20_000:40_000] = b"\xff" * 20_000  # can't be inflated
    with open(path, "wb") as f:
        f.write(bytes(bad) + good + bytes(bad) + good)
    found = list(warc.records(path, lambda h: h["warc-type"] == "response"))
    assert len(found) == 2
    assert [r.block() for r in warc.records(path, lambda h: h["warc-type"] == "response")] == [b"payload"] * 2
    with pytest.raises(Exception):
        [r.block() for r in warc.records(path, lambda h: True)]


def test_archives_of_other_writers(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://x/\r\n folded\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    two = b"WARC/1.0\r\nwarc-type: request\r\nContent-Type: application/http; msgtype=request\r\nContent-Length: 26\r\n\r\nGET / HTTP/1.1\r\nHost: x\r\n\r\n\r\n\r\n"
    with open(tmp_path / "a.warc.gz", "wb") as f:
        f.write(gzip.compress(one) + gzip.compress(two))
    with open(tmp_path / "b.warc", "wb") as f:
        f.write(one + two)
    got = warc.read_warc(spark, str(tmp_path)).orderBy("file", "offset").collect()
    assert [(r["warc_type"], bytes(r["payload"])) for r in got] == [("resource", b"abc"), ("request", b"")] * 2
    assert got[0]["warc_target_uri"] == "http://x/ folded" and got[1]["http_headers"] == {"host": "x"}
    with open(tmp_path / "c.warc", "wb") as f:
        f.write(one[:-6])
    with pytest.raises(Exception, match="cut short"):
        warc.read_warc(spark, str(tmp_path / "c.warc")).collect()


def test_files_are_packed_and_uncommitted_ones_ignored(spark, tmp_path):
    folder = f"{tmp_path}/many"
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.archive(warc.page_records(df), folder, file_bytes=1)
    files = [f for f in os.listdir(folder) if f.startswith("part-")]
    assert len(files) >= len(PAGES)
    with open(f"{folder}/part-{uuid.uuid4().hex}.warc.gz", "wb") as f:
        f.write(b"left by a lost task")
    assert warc.page_digests(spark, folder).count() == len(PAGES)
    reader = warc.WarcReader({"path": folder, "partition_bytes": "1500"}, warc.StructType.fromDDL("file string"))
    parts = reader.partitions()
    assert 1 < len(parts) < len(files) and sorted(p for x in parts for p in x.value) == sorted(f"{folder}/{f}" for f in files)
