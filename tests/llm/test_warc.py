"""Codings, members and headers of WARC responses."""

import gzip
import zlib

import pytest
import zstandard

from stockweave.llm import warc

PAGE = b"<html><body><p>Text of the page, in two parts.</p><p>And more.</p></body></html>"
TEXT = "Text of the page, in two parts.\nAnd more."
RAW_DEFLATE = (lambda c: c.compress(PAGE) + c.flush())(zlib.compressobj(wbits=-15))


def chunked(body, size=7):
    return b"".join(b"%x\r\n%s\r\n" % (len(body[i:i + size]), body[i:i + size]) for i in range(0, len(body), size)) + b"0\r\n\r\n"


@pytest.mark.parametrize(("headers", "body"), [
    ({}, PAGE), ({"Content-Encoding": "gzip"}, gzip.compress(PAGE)), ({"Content-Encoding": "gzip"}, gzip.compress(PAGE[:30]) + gzip.compress(PAGE[30:])),
    ({"Content-Encoding": "X-GZIP"}, gzip.compress(PAGE)), ({"Content-Encoding": "deflate"}, zlib.compress(PAGE)), ({"Content-Encoding": "deflate"}, RAW_DEFLATE),
    ({"Content-Encoding": "zstd"}, zstandard.compress(PAGE)), ({"Content-Encoding": "deflate, gzip"}, gzip.compress(zlib.compress(PAGE))),
    ({"Content-Encoding": "gzip", "Transfer-Encoding": "chunked"}, chunked(gzip.compress(PAGE))),
    ({"Transfer-Encoding": "gzip, chunked", "Content-Encoding": "identity"}, chunked(gzip.compress(PAGE))), ({"Content-Encoding": "gzip"}, PAGE)])
def test_codings_are_undone_in_reverse(headers, body):
    assert warc.decoded([*headers.items()], body) == PAGE


def test_broken_and_unknown_codings():
    long = PAGE * 5000
    part = warc.decoded([("Content-Encoding", "gzip")], gzip.compress(long)[:-200])
    assert part and long.startswith(part)
    assert warc.decoded([("Content-Encoding", "gzip")], gzip.compress(PAGE) + b"\x1f\x8bbroken") == PAGE
    assert warc.decoded([("Content-Encoding", "br")], b"abc") is None and warc.decoded([("Content-Encoding", "gzip, br")], b"abc") is None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: br\r\n\r\n\x0b\x02"
    (only,) = warc.derive_one("<r>", "u", "d", block)
    assert only["type"] == "metadata" and b"source-payload-undecoded: true" in only["block"]


def test_source_headers_and_digests_are_kept():
    given = [("WARC-Type", "response"), ("WARC-IP-Address", "10.0.0.1"), ("WARC-Block-Digest", "sha256:b"), ("WARC-Payload-Digest", "md5:p"), ("X-Own", "a: b")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + PAGE
    metadata, conversion = warc.derive_one("<r>", "u", "d", block, given)
    lines = metadata["block"].decode().split("\r\n")
    assert {f"source-header-{k}: {v}" for k, v in given} <= set(lines)
    assert "source-block-digest: sha256:b" in lines and "source-payload-digest: md5:p" in lines
    assert dict(conversion["headers"])["WARC-Source-Payload-Digest"] == "md5:p" and conversion["block"].decode() == TEXT
    plain = warc.derive_one("<r>", "u", "d", block)[0]["block"].decode()
    assert f"source-block-digest: {warc.digest(block)}" in plain and f"source-payload-digest: {warc.digest(PAGE)}" in plain


def test_files_keep_all_headers(spark, tmp_path):
    records = [warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<{i}>"), ("WARC-IP-Address", f"10.0.0.{i}"), ("Content-Length", str(len(b)))], b)
               for i, b in enumerate((b"x" * 100, b"", b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nhello"))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(records[0][:60]) + gzip.compress(records[0][60:] + records[1]) + gzip.compress(records[2])[:30])
    rows = warc.read_warc(spark, str(tmp_path / "*.gz"))
    assert rows.count() == 3 + 3 + 2
    made = warc.derive(rows).collect()
    text = {bytes(r.block).decode() for r in made if r.warc_type == "conversion"}
    assert "hello" in text
    assert sum(b"source-header-WARC-IP-Address: 10.0.0.2" in bytes(r.block) for r in made) == 2


def test_text_of_very_deep_and_long_pages():
    import time

    began = time.process_time()
    assert warc.plain_text("<div>" * 50_000 + "deep, text") == "deep, text"
    assert len(warc.plain_text("<p>some text" * 100_000).split("\n")) == 100_000
    assert time.process_time() - began < 20
