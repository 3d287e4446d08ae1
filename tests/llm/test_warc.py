"""Derived records from real WARC files: reading, preserved headers and digests, and round trips."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tidelog.llm.warc import derivatives, plain_text, read_records, read_responses, responses, write_warc


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, number: int, block: bytes, *more: str, size: int | None = None) -> bytes:
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{number}>", "WARC-Date: 2024-05-05T10:00:00Z",
        f"WARC-Target-URI: http://x.test/{number}", *more, f"Content-Length: {len(block) if size is None else size}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def http(body: bytes, *headers: str) -> bytes:
    return "\r\n".join(["HTTP/1.1 200 OK", *headers]).encode() + b"\r\n\r\n" + body


LATIN = "<p>Stra\xdfe</p>".encode("latin-1")
CHUNKED = b"5\r\n<p>ab\r\n6;x=y\r\ncd</p>\r\n0\r\n\r\n"
TRICKY = b"<p>before</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n<p>after</p>"
FILE = b"".join(
    [
        record("warcinfo", 1, b"software: test\r\n", "WARC-Filename: x.warc"),
        record("request", 2, b"GET / HTTP/1.1\r\n\r\n"),
        record("response", 3, http(LATIN, "Content-Type: text/html; charset=ISO-8859-1", "X-A: 1"), f"WARC-Payload-Digest: {sha1(LATIN)}", "WARC-IP-Address: 192.0.2.1", "WARC-Warcinfo-ID: <urn:uuid:1>"),
        record("response", 4, http(CHUNKED, "Transfer-Encoding: chunked"), f"WARC-Payload-Digest: {sha1(b'<p>abcd</p>')}"),
        record("response", 5, http(gzip.compress("<title>é</title>".encode()), "Content-Encoding: gzip"), "WARC-Payload-Digest: sha1:WRONG"),
        record("response", 6, http(TRICKY)),
        record("response", 7, http(b'<meta charset="nonsense"><p title="a>b">x</p>')),
        record("response", 8, http(b"<p>cut off"), size=500),
    ]
)


@pytest.mark.parametrize("packed", ["plain", "one member", "a member each"])
def test_responses_are_read_from_files(spark, tmp_path, packed):
    if packed == "plain":
        (tmp_path / "a.warc").write_bytes(FILE)
    else:
        parts = [FILE] if packed == "one member" else [b"WARC/" + p for p in FILE.split(b"WARC/")[1:]]
        (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    assert [r.type for r in read_records(spark, str(tmp_path)).collect()] == ["warcinfo", "request", *["response"] * 6]
    rows = {r.record_id: r for r in read_responses(spark, str(tmp_path)).collect()}
    texts = {i: rows[f"<urn:uuid:{i}>"].payload for i in range(3, 9)}
    assert texts == {3: "<p>Straße</p>", 4: "<p>abcd</p>", 5: "<title>é</title>", 6: TRICKY.decode(), 7: '<meta charset="nonsense"><p title="a>b">x</p>', 8: texts[8]}
    assert texts[8].startswith("<p>cut off")
    assert {i: rows[f"<urn:uuid:{i}>"].digest_matches for i in range(3, 9)} == {3: True, 4: True, 5: False, 6: None, 7: None, 8: None}
    assert [i for i in range(3, 9) if rows[f"<urn:uuid:{i}>"].truncated] == [8]
    assert rows["<urn:uuid:3>"].http_headers == "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nX-A: 1"


def test_headers_and_digests_of_the_source_are_preserved(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(FILE)
    made = derivatives(read_responses(spark, str(tmp_path)))
    rows = {(r.refers_to, r.type): r for r in made.collect()}
    about = rows[("<urn:uuid:3>", "metadata")].block
    for line in (f"payload-digest: {sha1(LATIN)}", "payload-digest-matches: true", "http-X-A: 1", "source-WARC-IP-Address: 192.0.2.1", "source-WARC-Warcinfo-ID: <urn:uuid:1>"):
        assert line in about.splitlines()
    assert "payload-digest-matches: false" in rows[("<urn:uuid:5>", "metadata")].block
    assert rows[("<urn:uuid:3>", "conversion")].block == "Straße" and rows[("<urn:uuid:7>", "conversion")].block == "x"


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_derived_records_come_back_from_files(spark, tmp_path, compression):
    (tmp_path / "a.warc").write_bytes(FILE)
    made = derivatives(read_responses(spark, str(tmp_path / "a.warc")))
    write_warc(made, str(tmp_path / "out"), compression)
    back = {r.record_id: r for r in read_records(spark, str(tmp_path / "out")).collect()}
    rows = made.collect()
    assert len(back) == len(rows) == 12
    for r in rows:
        assert (back[r.record_id].type, back[r.record_id].block.decode(), back[r.record_id].truncated) == (r.type, r.block, False)
        assert f"WARC-Refers-To: {r.refers_to}" in back[r.record_id].warc_headers
        assert f"WARC-Block-Digest: {sha1(r.block.encode())}" in back[r.record_id].warc_headers


def test_empty_tables_nulls_and_clashing_names(spark):
    pages = spark.createDataFrame(
        [(1, None, None, "k", "t", "m"), (None, "http://x", "", "k", "t", "m"), (2, "http://y", "<b>z" * 100_000, "k", "t", "m")],
        "page_id BIGINT, url STRING, html STRING, key STRING, type STRING, matches STRING",
    )
    assert derivatives(responses(pages.limit(0))).collect() == []
    rows = derivatives(responses(pages)).collect()
    assert len(rows) == 6 and {r.page_id for r in rows} == {1, 2, None}
    assert [len(r.block) for r in rows if r.type == "conversion"] == [0, 0, 100_000]
    named = responses(pages).withColumns({"key": F.lit("a"), "headers": F.lit("b"), "block": F.lit("c")})
    assert derivatives(named).count() == 6


def test_quoted_signs_do_not_end_a_tag():
    for page, text in (
        ('<p title="a>b">x', "x"), ("<p title='a>b'>x</p>y", "x\ny"), ("<p title=\"it's\">x", "x"), ('<a href="x>y>z">k</a> <b>l</b>', "k l"),
        ('<script data-x="</b>">hidden</script>seen', "seen"), ("a < b and c > d", "a < b and c > d"), ('<p title="open>x', "x"), ("<!-- > -->x", "x"),
    ):
        assert plain_text(page) == text, page
