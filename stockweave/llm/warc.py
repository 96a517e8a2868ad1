"""WARC derivatives: every response record becomes a linked metadata and a plain-text conversion record.

Both refer to the response by its identifier and keep its target URI and date. The metadata record
holds the HTTP status and headers of the source, all its WARC headers, its block and payload digests
(as the source gives them, computed where it gives none) and lengths; the
conversion record holds the page's text, its own digest, and the identifier of the metadata record
it belongs with. Identifiers are derived from the source's, so deriving again gives the same ones.

A response is judged on its own: one pass over the records, no shuffle, memory for one record.

Defined results: a record without an HTTP head is all payload; a null or empty block gives an
empty text; transfer and content codings are undone from the last to the first (chunked, gzip with
all its members, deflate, zstd), and bodies that break off are used as far as they go; a payload in a
coding that cannot be undone, or that is no text, gets a metadata record only; a null target URI is left
out of the headers; a null identifier gives records without a reference; records that are no
responses give nothing; an empty table gives no rows. Repeated records give repeated rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .htmltext import RAW, read

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_BREAK = re.compile(rb"\r?\n\r?\n")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields in order, and the body as sent."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    m = _BREAK.search(block)
    head, body = (block[: m.start()], block[m.end():]) if m else (block, b"")
    first, *lines = head.decode("latin-1").splitlines()
    fields: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in " \t" and fields:  # a folded line belongs to the field above
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return first, fields, body


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0].strip() or b"0", 16)
        except ValueError:
            break
        if size <= 0:
            break
        out.append(body[end + 1: end + 1 + size])
        at = end + 1 + size
        at += 2 if body[at:at + 2] == b"\r\n" else body[at:at + 1] == b"\n"
    return b"".join(out)


def _inflated(body: bytes, bits: int) -> tuple[bytes, bytes, bool]:
    """One compressed stream as far as it goes, what follows it, and whether it ended."""
    unpack, out = zlib.decompressobj(bits), []
    for at in range(0, len(body), 1 << 16):
        try:
            out.append(unpack.decompress(body[at: at + (1 << 16)]))
        except zlib.error:
            return b"".join(out), b"", False
        if unpack.eof:
            return b"".join(out), unpack.unused_data + body[at + (1 << 16):], True
    return b"".join(out), b"", False


def _gunzipped(body: bytes) -> bytes:
    out = []
    while body[:2] == b"\x1f\x8b":
        part, body, ended = _inflated(body, 31)
        out.append(part)
        if not ended:
            break
    return b"".join(out)


def _undone(coding: str, body: bytes) -> bytes | None:
    """The body before one coding was applied; a body that does not look coded stays; None for an unknown coding."""
    if coding in ("", "identity"):
        return body
    if coding == "chunked":
        return _dechunked(body)
    if coding in ("gzip", "x-gzip"):
        return _gunzipped(body) if body[:2] == b"\x1f\x8b" else body
    if coding == "deflate":
        for bits in (15, -15):
            out, _, ended = _inflated(body, bits)
            if out or ended:
                return out
        return body
    if coding == "zstd":
        out = []
        try:
            for piece in zstandard.ZstdDecompressor().read_to_iter(body):
                out.append(piece)
        except zstandard.ZstdError:
            pass
        return b"".join(out) or body
    return None


def decoded(fields: list[tuple[str, str]], body: bytes) -> bytes | None:
    """The payload without transfer and content codings, undone from the last to the first; None if one cannot be."""
    for name in ("transfer-encoding", "content-encoding"):
        applied = [c.strip().lower() for k, v in fields if k.lower() == name for c in v.split(",")]
        for coding in reversed(applied):
            body = _undone(coding, body)
            if body is None:
                return None
    return body


def plain_text(page: str) -> str:
    """All readable text of a page, a block a line; scripts, styles and the like are left out."""
    import html

    tree = read(page)
    hidden = [False] * len(tree.nodes)
    for k, node in enumerate(tree.nodes[1:], 1):
        hidden[k] = hidden[node.parent] or node.tag in RAW - {"title", "textarea"} or node.tag in ("noscript", "template")
    lines: dict[int, list[str]] = {}
    for node, block, raw in tree.leaves:
        if not hidden[node]:
            lines.setdefault(block, []).append(html.unescape(raw))
    rows = (" ".join("".join(parts).split()) for parts in lines.values())
    return "\n".join(r for r in rows if r)


def _text_of(fields: list[tuple[str, str]], payload: bytes | None) -> str | None:
    if payload is None:
        return None
    kind = next((v for k, v in fields if k.lower() == "content-type"), "text/html")
    m = _CHARSET.search(kind) or _CHARSET.search(payload[:1024].decode("latin-1"))
    try:
        page = payload.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    if "html" in kind.lower():
        return plain_text(page)
    return page if kind.lower().startswith("text/") else None


def derive_one(record_id: str | None, uri: str | None, date: str | None, block: bytes, given: list[tuple[str, str]] = ()) -> list[dict]:
    """The derived records of one response: type, headers in order, block. `given` are the source's WARC headers."""
    status, fields, body = http_parts(block)
    payload = decoded(fields, body)
    ids = {k: f"<urn:uuid:{uuid.uuid5(SPACE, f'{record_id}#{k}')}>" for k in ("metadata", "conversion")}
    source = [("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Refers-To", record_id)]

    def record(kind: str, content_type: str, data: bytes, more: list[tuple[str, str | None]]) -> dict:
        head = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), *source, *more, ("WARC-Block-Digest", digest(data)),
                ("Content-Type", content_type), ("Content-Length", str(len(data)))]
        return {"type": kind, "id": ids[kind], "headers": [(k, v) for k, v in head if v is not None], "block": data}

    text = _text_of(fields, payload)
    known = {k.lower(): v for k, v in given}
    block_digest, payload_digest = known.get("warc-block-digest") or digest(block), known.get("warc-payload-digest") or digest(body)
    told = [("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("source-block-length", str(len(block))),
            ("source-payload-length", str(len(body)))]
    told += [(f"source-header-{k}", v) for k, v in given]
    told += [("source-payload-undecoded", "true")] * (payload is None)
    told += [("http-status-line", status)] * bool(status) + [(f"http-header-{k}", v) for k, v in fields]
    told += [("derived-text-id", ids["conversion"]), ("derived-text-characters", str(len(text)))] if text is not None else []
    lines = "".join(f"{k}: {v}\r\n" for k, v in told).encode("utf-8", "surrogatepass")
    out = [record("metadata", "application/warc-fields", lines, [])]
    if text is not None:
        out.append(record("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"), [
            ("WARC-Concurrent-To", ids["metadata"]), ("WARC-Source-Payload-Digest", payload_digest)]))
    return out


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as it stands in a file."""
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def _members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file one by one, or the file itself."""
    if data[:2] != b"\x1f\x8b":
        yield data
    while data[:2] == b"\x1f\x8b":
        unpack = zlib.decompressobj(31)
        try:
            part = unpack.decompress(data)
        except zlib.error:
            return
        yield part
        data = unpack.unused_data.lstrip(b"\r\n\0")


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Header fields and block of every record of a file, plain or gzipped by record; a broken end is left out.

    Only one member is unpacked at a time, unless a record goes on in the next one.
    """
    rest = b""
    for member in _members(data):
        member, at = rest + member, 0
        rest = b""
        while (at := member.find(b"WARC/", at)) >= 0:
            m = _BREAK.search(member, at)
            if m is None:
                rest = member[at:]
                break
            fields = []
            for line in member[at: m.start()].decode("utf-8", "replace").splitlines()[1:]:
                name, _, value = line.partition(":")
                fields.append((name.strip(), value.strip()))
            length = int(next((v for k, v in fields if k.lower() == "content-length"), "0"))
            if m.end() + length > len(member):
                rest = member[at:]
                break
            yield fields, member[m.end(): m.end() + length]
            at = m.end() + length


_OUT = ("{}warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
        "block_digest string, headers array<struct<name:string,value:string>>, block binary")


def derive(responses: DataFrame, key: str | None = None) -> DataFrame:
    """Derived records of the rows (record_id, target_uri, warc_date, block, and warc_type if there) of a response table.

    `key` names a column that is carried along. A column `headers`, an array of (name, value), holds the
    source's WARC headers; a column of that name and another type is ignored.
    """
    told = responses.schema["headers"].dataType if "headers" in responses.columns else None
    told = isinstance(told, ArrayType) and isinstance(told.elementType, StructType) and {"name", "value"} <= set(told.elementType.names)
    if "warc_type" in responses.columns:
        responses = responses.filter("warc_type = 'response'")
    names = ["record_id", "target_uri", "warc_date"]
    rows = responses.select(*([key] if key else []), *[F.col(c).cast("string").alias(c) for c in names], F.col("block").cast("binary").alias("block"),
                            *([F.transform("headers", lambda h: F.struct(h["name"].cast("string").alias("name"), h["value"].cast("string").alias("value"))).alias("given")] if told else []))
    kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                owner, made = [], []
                cols = [part.column(c) for c in (*names, "block")]
                given = part.column("given").to_pylist() if told else [None] * part.num_rows
                for i in range(part.num_rows):
                    rid, uri, date, block = (c[i].as_py() for c in cols)
                    source = [(h["name"], h["value"]) for h in given[i] or () if h and h["name"] and h["value"] is not None]
                    for r in derive_one(rid, uri, date, block or b"", source):
                        owner.append(i)
                        made.append((r["type"], r["id"], rid, uri, date, dict(r["headers"])["Content-Type"], digest(r["block"]),
                                     [{"name": k, "value": v} for k, v in r["headers"]], r["block"]))
                arrays = [pa.array(c, pa.string()) for c in list(zip(*made))[:7]] if made else [pa.array([], pa.string())] * 7
                arrays += [pa.array([m[7] for m in made], kind), pa.array([m[8] for m in made], pa.binary())]
                labels = ["warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "headers", "block"]
                if key:
                    arrays, labels = [part.column(key).take(pa.array(owner, pa.int64())), *arrays], [key, *labels]
                yield pa.RecordBatch.from_arrays(arrays, names=labels)

    carried = f"`{key}` {responses.schema[key].dataType.simpleString()}, " if key else ""
    return rows.mapInArrow(run, _OUT.format(carried))


def responses_of(pages: DataFrame, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Response records of a page table (page_id, url, html): page_id, record_id, target_uri, warc_date, headers, block."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    h = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), F.col("url").cast("string")))
    name = F.concat(F.lit("<urn:uuid:"), h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-"), h.substr(13, 4), F.lit("-"),
                    h.substr(17, 4), F.lit("-"), h.substr(21, 12), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body), F.lit("\r\n\r\n"))
    block = F.concat(head, body).cast("binary")
    headers = {"WARC-Type": F.lit("response"), "WARC-Record-ID": name, "WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.sha2(body.cast("binary"), 256)),
               "Content-Type": F.lit("application/http; msgtype=response"), "Content-Length": F.length(block).cast("string")}
    return pages.select("page_id", name.alias("record_id"), F.col("url").cast("string").alias("target_uri"), F.lit(date).alias("warc_date"),
                        F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in headers.items()]).alias("headers"), block.alias("block"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (plain or gzipped by record): warc_type, record_id, target_uri, warc_date, headers, block.

    A file is a row of Spark's binary reader, which ends at 2 GB; its members are unpacked one by one.
    """
    kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for fields, block in parse(content.as_py()):
                    value = {k.lower(): v for k, v in fields}
                    row = [value.get(k) for k in ("warc-type", "warc-record-id", "warc-target-uri", "warc-date")]
                    told = [{"name": k, "value": v} for k, v in fields]
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.string()) for v in row), pa.array([told], kind), pa.array([block], pa.binary())],
                                                     names=["warc_type", "record_id", "target_uri", "warc_date", "headers", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(
        run, "warc_type string, record_id string, target_uri string, warc_date string, headers array<struct<name:string,value:string>>, block binary")


def serialised(headers: str = "headers", block: str = "block") -> Column:
    """The bytes of a derived record as in a file, from its columns."""
    lines = F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\r\n")))
    head = F.concat(F.lit("WARC/1.1\r\n"), F.array_join(lines, ""), F.lit("\r\n")).cast("binary")
    return F.concat(head, F.col(block), F.lit("\r\n\r\n").cast("binary"))
