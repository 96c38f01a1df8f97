"""Archives against plain restatements, foreign archives and odd payloads."""

from __future__ import annotations

import gzip
import hashlib
import random

import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import warc  # noqa: E402

PAGES = "page_id long, url string, html string, digest int, `to.x` string"


def _expected(rows):
    first = {}
    for page, _, html, *_ in rows:
        html = html or ""
        if len(html.encode()) >= 1000 and page is not None:
            first[html] = max(first.get(html, page), page)
    out = []
    for page, url, html, *_ in rows:
        data = (html or "").encode()
        response = len(data) < 1000 or first.get(html) in (None, page)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if response else "revisit", None if response else first[html]))
    return out


def _round(spark, rows):
    got = warc.round_trip(spark.createDataFrame(rows, PAGES))
    return [tuple(r)[:5] for r in got.collect()]


def test_round_trip_of_odd_payloads(spark):
    mark = "\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rng = random.Random(3)
    texts = ["", None, "é" * 499, "é" * 500, "x" * 999, "x" * 1000, mark * 30, "WARC/1.1", "WARC/1.1\r\n\r\n" * 200, "\r\n\r\n" * 400, "\r\nWARC/1." * 300, "<p>\n" * 9000]
    rows = [(i, f"http://h{i % 3}.example/a b?q={i}", rng.choice(texts), 1, "x") for i in range(120)]
    rows += [(200 + i, None if i else "", t, None, None) for i, t in enumerate(texts)]
    assert sorted(_round(spark, rows), key=repr) == sorted(_expected(rows), key=repr)


def test_repeated_and_missing_ids(spark):
    big = "y" * 1500
    rows = [(None, "u", big, 0, ""), (None, "u", big, 0, ""), (4, "u", big, 0, ""), (4, "u", big, 0, ""), (4, "v", big, 0, ""), (None, None, None, 0, "")]
    got = sorted(_round(spark, rows), key=repr)
    assert [g[3] for g in got].count("response") == 2 and len(got) == 6
    assert all(g[4] == 4 for g in got if g[3] == "revisit")
    only = _round(spark, [(None, "u", big, 0, ""), (None, "v", big, 0, "")])
    assert sorted(g[3] for g in only) == ["response", "revisit"] and all(g[4] is None for g in only)


def test_empty_table(spark):
    assert _round(spark, []) == []


def _raw(head, block):
    return ("WARC/1.0\r\n" + "\r\n".join(head) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    page = b"HTTP/1.0 200 OK\r\nServer: a\r\n\r\n" + b"body\r\n\r\n\xff\xfe\r\nWARC/1.0\r\nnot a record\r\n\r\n"
    response = _raw(["WARC-Type: response", "warc-record-id: <r1>", "X-Long: one", "  two", "WARC-Concurrent-To: <m1>", "Content-Type: application/http; msgtype=response"], page)
    asked = _raw(["WARC-Type: request", "WARC-Record-ID: <q1>", "WARC-Concurrent-To: <r1>", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.0\r\n\r\n")
    second = _raw(["WARC-Type: request", "WARC-Record-ID: <q2>", "WARC-Concurrent-To: <r1>", "Content-Type: application/http; msgtype=request"], b"GET /2 HTTP/1.0\r\n\r\n")
    about = _raw(["WARC-Type: metadata", "WARC-Record-ID: <m1>", "Content-Type: application/warc-fields"], b"via: x\r\nvia2: y\r\n")
    info = _raw(["WARC-Type: warcinfo", "WARC-Record-ID: <i>"], b"")
    sha = hashlib.sha1(b"z").digest()
    import base64

    again = _raw(["WARC-Type: revisit", "WARC-Record-ID: <r2>", "WARC-Refers-To: <r1>", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}"], b"")
    cut = _raw(["WARC-Type: resource", "WARC-Record-ID: <c>"], b"0123456789" * 9)[:-30]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (info, second, asked, response, about)))
    (tmp_path / "b.warc").write_bytes(again + cut)
    (tmp_path / "c.warc").write_bytes(b"no archive at all")
    records = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert set(records) == {"<i>", "<q1>", "<q2>", "<r1>", "<m1>", "<r2>", "<c>"}
    assert bytes(records["<r1>"].payload) == page.partition(b"\r\n\r\n")[2] and records["<r1>"].headers["x-long"] == "one two"
    assert records["<r1>"].payload_digest == hashlib.sha1(page.partition(b"\r\n\r\n")[2]).hexdigest()
    assert records["<r2>"].payload_digest == sha.hex() and records["<r2>"].payload is None and records["<r2>"].payload_bytes is None
    assert [r for r, x in records.items() if x.truncated] == ["<c>"] and records["<c>"].payload_bytes < 90
    found = {c.record_id: c for c in warc.captures(warc.read_archives(spark, str(tmp_path))).collect()}
    assert set(found) == {"<r1>", "<r2>"}
    assert found["<r1>"].request.record_id == "<q1>" and found["<r1>"].metadata.fields == {"via": "x", "via2": "y"}
    assert found["<r2>"].request is None and found["<r2>"].response.refers_to == "<r1>"
