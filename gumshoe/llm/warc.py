"""Derive WARC records from responses: a metadata record and a plain-text conversion record for each.

Both refer to the response by ``WARC-Refers-To`` and to each other by ``WARC-Concurrent-To``; they keep its target and date.
The metadata block is JSON with the status line, the source's HTTP headers in their order, its payload digest, title and links.
The conversion block is the visible text. Digests are SHA-1 in base 32, as is usual in WARC files; record ids are
derived from the response's id and the record's type, so that a rerun gives the same ids.

Nulls and ties: a null payload is an empty message; a null target or date is an empty header value; a message that is not
HTTP is text without headers; bytes that are not UTF-8 are read by the declared charset, or replaced. Repeated responses give
repeated records. An empty table gives none. Other columns than those named are ignored.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_tree import Page

SCHEMA = (
    "source_row long, warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, "
    "warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, "
    "block string, record binary"
)
_types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
COLUMNS = [tuple(c.split()) for c in SCHEMA.split(", ")]
_charset = re.compile(r"charset\s*=\s*\"?([\w-]+)", re.I)
_size = re.compile(rb"[0-9a-fA-F]{1,15}")
_control = re.compile(r"[\x00-\x1f\x7f\x85\u2028\u2029]")
# fixed values: Python's codecs for other things than pages
NOT_FOR_PAGES = {"idna", "punycode", "undefined", "unicode_escape", "raw_unicode_escape", "mbcs", "oem"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in plain WARC bytes."""
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        n = int(headers["Content-Length"])
        yield headers, rest[:n]
        data = rest[n + 4 :]


def parse_http(message: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body."""
    if not message.startswith(b"HTTP/"):
        return "", [], message
    head, _, body = message.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], body


def _opened(body: bytes, headers: list[tuple[str, str]]) -> bytes:
    """The body without its transfer and content encodings; as it is where they do not hold."""
    named = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in named.get("transfer-encoding", ""):
        body = _unchunked(body)
    for encoding in reversed(named.get("content-encoding", "").split(",")):
        try:
            if encoding.strip() in ("gzip", "x-gzip"):
                body = gzip.decompress(body)
            elif encoding.strip() == "deflate":
                body = zlib.decompress(body)
        except (OSError, EOFError, zlib.error):
            return body
    return body


def _unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = _size.match(body, at)
        if line < 0 or not size:
            return body
        n = int(size[0], 16)
        if not n:
            return b"".join(parts)
        parts.append(body[line + 2 : line + 2 + n])
        at = line + 2 + n + 2


def decoded(body: bytes, charset: str | None) -> str:
    """By the declared charset, else UTF-8; without half surrogates, which no output could hold."""
    try:
        if not codecs.lookup(charset or "utf-8")._is_text_encoding or charset.lower().replace("-", "_") in NOT_FOR_PAGES:
            charset = "utf-8"
        text = body.decode(charset, "replace")
    except (LookupError, UnicodeError, ValueError, AttributeError):
        text = body.decode("utf-8", "replace")
    return text.encode("utf-8", "replace").decode()


def one_line(value: str) -> str:
    """A header value without signs that would end it."""
    return _control.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def derived(row: int | None, record_id: str, target: str, date: str, message: bytes) -> Iterator[tuple]:
    record_id, target, date = map(one_line, (record_id, target, date))
    status, headers, body = parse_http(message)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    charset = _charset.search(kind)
    text = decoded(_opened(body, headers), charset and charset[1])
    source = digest(body)
    page = Page(text) if "html" in kind or not kind else None
    facts = {"status": status, "headers": [list(h) for h in headers], "payload_digest": source}
    if page:
        facts |= {"title": page.title, "links": page.links}
    blocks = {
        "metadata": ("application/json", json.dumps(facts, ensure_ascii=False)),
        "conversion": ("text/plain", "\n".join(t for _, t, _ in page.blocks) if page else text),
    }
    ids = {k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, record_id + ' ' + k)}>" for k in blocks}
    for name, (content_type, block) in blocks.items():
        data = block.encode("utf-8", "replace")
        other = ids["conversion" if name == "metadata" else "metadata"]
        fields = [
            ("WARC-Type", name),
            ("WARC-Record-ID", ids[name]),
            ("WARC-Refers-To", record_id),
            ("WARC-Concurrent-To", other),
            ("WARC-Target-URI", target),
            ("WARC-Date", date),
            ("WARC-Block-Digest", digest(data)),
            ("Content-Type", content_type),
            ("Content-Length", str(len(data))),
        ]
        record = gzip.compress(record_bytes(fields, data), compresslevel=1, mtime=0)
        yield row, name, ids[name], record_id, other, target, date, content_type, len(data), digest(data), source, block, record


def responses_of(pages: DataFrame, date: str) -> DataFrame:
    """``pages (page_id, url, html)`` as the responses a crawler would have stored: source_row, record_id, target_uri, date, message."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body), F.lit("\r\n\r\n")
    )
    h = F.md5(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.md5(body)))
    dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return pages.select(
        F.col("page_id").cast("long").alias("source_row"),
        F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(head.cast("binary"), body).alias("message"),
    )


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records for each of ``responses (source_row, record_id, target_uri, date, message)``."""
    names = ["source_row", "record_id", "target_uri", "date", "message"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows = [
                    r
                    for row, rid, uri, date, message in zip(*(part[c].to_pylist() for c in names), strict=True)
                    for r in derived(row, rid or "", uri or "", date or "", message or b"")
                ]
                arrays = [pa.array(c, _types[t]) for c, (_, t) in zip(zip(*rows, strict=True), COLUMNS, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in COLUMNS])

    return responses.select(*names).mapInArrow(build, SCHEMA)
