from __future__ import annotations

import base64
import hashlib
import struct

import zstandard

from tastemill.llm import warc_zstd as W

ROWS = [
    (5, "http://a/\n 1", "same"), (3, "http://b", "same"), (9, None, "same"), (7, "http://c", None), (8, "http://d", ""),
    (1, "http://e", "<p>Größe 漢</p>\r\n\r\nx"), (2, "http://f", "y" * 300_000), (3, "http://b", "same"), (None, "http://g", "same"), (None, "http://h", "alone"),
]


def sha(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def brute(rows):
    first: dict = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, _, t in rows:
        f = first.get(t or "")
        refers = f if f is not None and f != i else None
        out.append((i, len((t or "").encode()), sha(t), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame([(i, u, t, 1) for i, u, t in ROWS], "page_id long, url string, html string, payload_bytes int")
    got = W.round_trip(pages)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute(ROWS)
    assert got.where("problem is not null").count() == 0
    assert W.round_trip(pages.limit(0)).count() == 0


def test_payloads_and_dictionary(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"<html><body><p>page {k} {'text ' * (k % 50)}</p></body></html>") for k in range(400)]
    path = f"file://{tmp_path}/w"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    listing = W.write_archives(pages, path, archive_bytes=20_000).collect()
    assert sum(r.records for r in listing) == 400 and len(listing) > 2
    data = next((tmp_path / "w").glob("*.zst")).read_bytes()
    assert struct.unpack_from("<I", data)[0] == 0x184D2A5D
    got = {r.page_id: r.payload.decode() for r in W.read_archives(spark, path, payloads=True).collect()}
    assert got == {i: t for i, _, t in rows}


def test_plain_reader_agrees():
    records = [W.record(k, "http://x", b"body %d" % k, W.payload_digest(b"body %d" % k), None) for k in range(200)]
    data = W.archive(records)
    assert list(W.frames(data)) == records
    none = W.archive(records[:1])  # too little to train on
    assert list(W.frames(none)) == records[:1] and zstandard.ZstdDecompressor().decompress(none) == records[0]


def test_damage_is_reported():
    records = [W.record(k, "u", b"p%d" % k, W.payload_digest(b"p%d" % k), None) for k in range(40)]
    data = W.archive(records)
    assert [W.parse(f).problem for f in W.frames(data[:-3])] == [None] * 39 + ["frame"]
    assert W.parse(records[0].replace(b"WARC/1.1", b"WARC/9")).problem == "version"
    assert W.parse(records[0][:-1]).problem == "length"
    assert W.parse(records[0].replace(b"p0", b"q0")).problem == "payload"
    assert W.parse(records[0].replace(b"WARC-Date:", b"WARC-Date")).problem in ("header", "missing field")
    assert W.parse(None).problem == "frame"


def test_no_frame_is_decoded_beyond_the_limit():
    big = zstandard.ZstdCompressor(write_content_size=True).compress(b"x" * 5_000_000)
    blind = zstandard.ZstdCompressor(write_content_size=False).compress(b"y" * 5_000_000)
    small = zstandard.ZstdCompressor(write_content_size=False).compress(b"small")
    got = list(W.frames(big + blind + small, limit=1000))
    assert got == [W.TOO_LONG, W.TOO_LONG, b"small"] and W.parse(got[0]).problem == "too long"
    assert [len(x) for x in W.frames(big + blind + small)] == [5_000_000, 5_000_000, 5]


def test_unlisted_archives_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    pages = spark.createDataFrame([(k, f"u{k}", f"page {k}") for k in range(20)], "page_id long, url string, html string")
    listing = W.write_archives(pages, path)
    stray = W.archive([W.record(99, "u", b"p", W.payload_digest(b"p"), None)])
    (tmp_path / "w" / "part-000000-00000099-00000.warc.zst").write_bytes(stray)  # of a task that did not end
    assert sorted(r.page_id for r in W.read_listed(listing).collect()) == list(range(20))
    assert W.read_archives(spark, path).count() == 21


def test_salts_follow_the_largest_group(spark, monkeypatch):
    monkeypatch.setattr(W, "SALT_ROWS", 3)
    pages = spark.createDataFrame([(k, f"u{k}", "same" if k % 4 else f"own {k}") for k in range(60)], "page_id long, url string, html string")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted((tuple(r)[:5] for r in W.round_trip(pages).collect()), key=str) == brute(rows)
