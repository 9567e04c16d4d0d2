import hashlib

import pyarrow as pa
import pytest

from barloom.llm import warc
from barloom.llm.common import shared_folder

BIG = "<p>" + "payload " * 20


def pages(spark):
    rows = [(7, "http://a/", BIG), (3, "http://b/", BIG), (9, None, BIG), (4, "http://c/", "short"), (5, "http://d/", "short"),
            (6, "http://e/\r\nX: y", None), (8, "u", ""), (10, "http://é/", "é" * 100), (11, "http://é/", "é" * 100),
            (12, "x", "\r\n\r\nWARC/1.1\r\n" + "z" * 200), (13, "long", "long " * 200000), (3, "http://b/", BIG), (None, "n", BIG),
            (14, "x", "y" * 100), (15, "x", "y" * 99), (16, "x", "y" * 100), (17, "x", "y" * 99)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


def brute(rows):
    least = {}
    for page_id, _, html, _ in rows:
        if page_id is not None:
            least[html or ""] = min(page_id, least.get(html or "", page_id))
    out = []
    for page_id, _, html, _ in rows:
        payload = (html or "").encode()
        first = least.get(html or "")
        revisit = len(payload) >= 100 and page_id != first
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response",
                    first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("roll", [64 << 20, 300])
def test_against_brute_force(spark, monkeypatch, roll):
    monkeypatch.setattr(warc, "ROLL_BYTES", roll)
    frame = pages(spark)
    got = warc.archive_digest(frame)
    assert sorted(map(tuple, got.collect()), key=str) == brute(list(map(tuple, frame.collect())))
    assert warc.archive_digest(frame.filter("false")).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_captures_are_whole(spark, compress):
    frame, folder = pages(spark), shared_folder(spark, "warc-test")
    manifest = warc.write_archives(frame, folder, compress=compress)
    captures = warc.assemble_captures(warc.read_archives(manifest, folder)).collect()
    assert len(captures) == frame.count() and manifest.agg({"n_records": "sum"}).first()[0] == 3 * frame.count()
    assert all(len(c.requests) == 1 and len(c.metadata) == 1 for c in captures)
    seen = {(c.metadata[0].page_id, c.metadata[0].url, c.response.payload.decode()) for c in captures if c.response.record_type == "response"}
    assert (12, "x", "\r\n\r\nWARC/1.1\r\n" + "z" * 200) in seen and (6, "http://e/\r\nX: y", "") in seen
    responses = {c.response.record_id for c in captures if c.response.record_type == "response"}
    assert all(c.response.refers_to_id in responses for c in captures if c.response.record_type == "revisit")


def test_broken_archives_are_refused():
    raw = warc.record([("WARC-Type", "metadata"), ("WARC-Record-ID", "<x>")], b"{}")
    assert [b for _, _, b in warc.parse_archive(pa.BufferReader(raw * 3), False)] == [b"{}"] * 3
    with pytest.raises(ValueError):
        list(warc.parse_archive(pa.BufferReader(raw[:-3]), False))
    with pytest.raises(ValueError):
        list(warc.parse_archive(pa.BufferReader(b"HTTP" + raw), False))
    headers = {"warc-type": "response", "warc-record-id": "<x>", "warc-payload-digest": "sha256:00"}
    with pytest.raises(ValueError):
        warc.record_row("f", 0, headers, b"HTTP/1.1 200 OK\r\n\r\nbody", True)
