import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from ledgerlight.llm import warc
from ledgerlight.llm.common import new_path, ship

from .fixtures import SF


def expected(rows, least=0):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    top = {}
    for i, h in rows:
        if len((h or "").encode()) >= least:
            top[digest(h)] = max(top.get(digest(h), -1), -1 if i is None else i)
    out = []
    for i, h in rows:
        n, d = len((h or "").encode()), digest(h)
        other = n >= least and top[d] != (-1 if i is None else i)
        out.append((i, n, d, "revisit" if other else "response", top[d] if other else None))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark):
    ship(spark)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert found(warc.round_trip(pages, file_bytes=20_000)) == expected([(r.page_id, r.html) for r in pages.collect()])


def test_awkward_pages_and_least_size(spark):
    ship(spark)
    trap = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n\r\n\r\n<p>é\x00\x1f"
    rows = [(1, "u\r\nX: y", "<a>"), (2, None, "<a>"), (3, "w", "<a>"), (4, "w", None), (5, "w", ""), (6, "w", trap), (7, "w", trap * 2000), (None, "w", "<a>"), (8, "w", "only"), (8, "w", "only"), (8, "w", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS payload", "1 AS record_type")
    for least in (0, 4):
        got = found(warc.round_trip(pages, least_bytes=least))
        assert got == expected([(i, h) for i, _, h in rows], least)
    assert warc.round_trip(pages.limit(0)).collect() == []
    assert found(warc.round_trip(pages, file_bytes=100)) == expected([(i, h) for i, _, h in rows])  # payloads above a file's size


def test_damaged_files_are_refused(spark):
    ship(spark)
    pages = spark.createDataFrame([(k, f"http://h/{k}", "<p>" + "x" * k) for k in range(6)], "page_id long, url string, html string").coalesce(1)
    for damage in (lambda x: x[:-30], lambda x: x.replace(b"<p>xx", b"<p>xy"), lambda x: x.replace(b"<p>xxx", b"<p>xxxx"), lambda x: b"junk" + x):
        path = new_path(spark, "warc-damaged")
        warc.write(pages, path)
        for p in Path(path.removeprefix("file:")).glob("part-*"):
            p.write_bytes(gzip.compress(damage(gzip.decompress(p.read_bytes()))))
        for p in Path(path.removeprefix("file:")).glob(".*.crc"):
            p.unlink()
        with pytest.raises(Exception):
            warc.read(spark, path).collect()


def test_files_are_warc_and_hold_each_payload_once(spark):
    ship(spark)
    pages = spark.createDataFrame([(k, f"http://h/{k}", "<p>" + "x" * (k % 3)) for k in range(12)], "page_id long, url string, html string")
    path = new_path(spark, "warc-test")
    warc.write(pages, path)
    heads, payloads = [], []
    for p in Path(path.removeprefix("file:")).glob("part-*"):
        for head, block in warc.records(gzip.decompress(p.read_bytes())):
            heads.append(head)
            if head["warc-type"] == "response":
                payloads.append(block.partition(b"\r\n\r\n")[2])
    assert sorted(payloads) == [b"<p>", b"<p>x", b"<p>xx"]
    ids = {h["warc-record-id"]: h for h in heads}
    assert len(ids) == 12
    for h in heads:
        if h["warc-type"] == "revisit":
            first = ids[h["warc-refers-to"]]
            assert first["warc-type"] == "response" and first["warc-payload-digest"] == h["warc-payload-digest"] and first["warc-target-uri"] == h["warc-refers-to-target-uri"]
    assert warc.read(spark, path, payloads=True).filter("payload IS NOT NULL").count() == 3
