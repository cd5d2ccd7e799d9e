"""WARC derivatives (operator 3): responses become metadata and plain-text conversion records.

``responses`` wraps crawled pages as response records (the captured bytes, header
fields and digests), ``parse_records`` cuts the bytes of WARC files into records, and
``derive`` makes two linked records for each response: a ``metadata`` record and a
``conversion`` record.  Both carry ``WARC-Refers-To`` with the response's identifier
and keep its target, date and payload digest; block digests are of their own content.  The
metadata record lists every header of the response record and of HTTP, repeats included.
Text is taken after transfer and content encoding are undone, in the declared charset if it is one
that browsers read, else as UTF-8; what cannot be decoded becomes a replacement character, so
that no page content ends a job.

Header names go by their letters, not their case.  Files may be packed with gzip, record by record or
whole.  Null or empty files have no records, null blocks are empty, repeated records give repeated derivatives, other
columns of the input are not read, and an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

VERSION = "WARC/1.1"
#: Captured pages carry no time; records of a table get this one.
UNDATED = "1970-01-01T00:00:00Z"
RECORD = (
    "record_id string, record_type string, headers map<string,string>, block binary, "
    "fields array<struct<name:string,value:string>>"
)

# The charsets that browsers read, by Python's names for them.
CHARSETS = frozenset((
    "utf-8", "utf-16", "utf-16-le", "utf-16-be", "ascii", "iso8859-1", "iso8859-2", "iso8859-3", "iso8859-4", "iso8859-5", "iso8859-6",
    "iso8859-7", "iso8859-8", "iso8859-9", "iso8859-10", "iso8859-13", "iso8859-14", "iso8859-15", "iso8859-16", "cp866", "cp874",
    "cp1250", "cp1251", "cp1252", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "cp1258", "koi8-r", "koi8-u", "mac-roman",
    "mac-cyrillic", "gbk", "gb2312", "gb18030", "big5", "big5hkscs", "euc_jp", "shift_jis", "cp932", "iso2022_jp", "euc_kr", "cp949",
))
#: Bytes of records that a task hands on at once.
BATCH = 16 << 20

_DROPPED = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|$)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header|title|body)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*(?:>|$)")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title|$)", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([\w-]+)", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*\bhref\s*=", re.I)


class Fields(dict):
    """Headers by name, with ``pairs``: all of them in their order, repeats included."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        super().__init__(pairs)
        self.pairs = pairs


def _pairs(lines: list[str]) -> list[tuple[str, str]]:
    return [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines) if k.strip()]


def _unchunked(data: bytes) -> bytes:
    """The bytes of a chunked body; data that is not chunked as it is, and of a cut body what there is."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n", at)
        size = re.fullmatch(rb"\s*([0-9a-fA-F]+)\s*(;.*)?", data[at:end] if end >= 0 else b"", re.S)
        if not size:
            return b"".join(out) if out else data
        n = int(size[1], 16)
        if not n:
            break
        out.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n
        at += 2 if data[at : at + 2] == b"\r\n" else 0
    return b"".join(out)


def _inflated(data: bytes, bits: int) -> bytes:
    """All members of zlib data, and what there is of one that is cut."""
    out = []
    while data:
        member = zlib.decompressobj(bits)
        out.append(member.decompress(data))
        data = member.unused_data if member.eof else b""
        if data and not data.startswith(b"\x1f\x8b"):  # padding
            break
    return b"".join(out)


def _decoded(data: bytes, coding: str) -> bytes:
    """``data`` without one content coding; ValueError if it can't be undone."""
    try:
        if coding in ("", "identity"):
            return data
        if coding in ("gzip", "x-gzip"):
            return _inflated(data, 31)
        if coding == "deflate":
            try:
                return _inflated(data, 15)
            except zlib.error:
                return _inflated(data, -15)
        if coding == "zstd":
            return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    except (zlib.error, zstandard.ZstdError) as error:
        raise ValueError(f"bad {coding} data") from error
    raise ValueError(f"unknown coding {coding}")


def _markup(body: bytes, content_type: str) -> tuple[str, str]:
    """Text of a body and its charset: the byte order mark's, the declared one, that of the markup, or UTF-8."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace"), name
    named = _CHARSET.search(content_type) or _CHARSET.search(body[:1024].decode("latin-1"))
    name = named[1].lower() if named else "utf-8"
    try:
        name = codecs.lookup(name).name
    except (LookupError, ValueError):
        name = ""
    if name in ("iso8859-1", "ascii"):  # as browsers read them
        name = "cp1252"
    if name not in CHARSETS:
        name = "utf-8"
    return _sound(body.decode(name, "replace")), name


def _sound(text: str) -> str:
    """The text without halves of surrogate pairs, which no UTF-8 can hold."""
    return text.encode("utf-8", "replace").decode()


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    """The same identifier whenever the same record is made again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def plain_text(markup: str) -> str:
    """Visible text, one line for each block; entities resolved, white space collapsed."""
    body = _BREAK.sub("\n", _DROPPED.sub(" ", markup))
    lines = (" ".join(line.split()) for line in html.unescape(_TAG.sub("", body)).split("\n"))
    return "\n".join(line for line in lines if line)


def write_record(headers: dict[str, str], block: bytes) -> bytes:
    """One record as bytes; ``headers`` without the length, which is added."""
    pairs = getattr(headers, "pairs", None) or headers.items()
    lines = [VERSION, *(f"{k}: {v}" for k, v in pairs), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(data: bytes) -> Iterator[bytes]:
    """The content of a file: as it is, or of each gzip member, one after the other."""
    if not data.startswith(b"\x1f\x8b"):
        yield data
        return
    while data:
        member = zlib.decompressobj(31)
        try:
            content = member.decompress(data)
        except zlib.error as error:
            raise ValueError("bad gzip data") from error
        if not member.eof:
            raise ValueError("a gzip member is cut")
        yield content
        data = member.unused_data.lstrip(b"\0")


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a file's bytes, packed or not; stops with an error at one whose length is missing or too large."""
    for content in _members(data):
        yield from _records(content)


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = re.sub(r"\r\n[ \t]+", " ", data[at:end].decode("utf-8", "replace")).split("\r\n")[1:]
        headers = Fields(_pairs(lines))
        named = next((v for k, v in headers.pairs if k.lower() == "content-length"), "")
        size = int(named) if named.isascii() and named.isdigit() else -1
        if size < 0 or end + 4 + size > len(data):
            raise ValueError(f"bad length of the record at byte {at}")
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def response_record(url: str, markup: str, date: str, key: str) -> tuple[dict[str, str], bytes]:
    payload = markup.encode("utf-8", "replace")
    block = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode() + payload
    return {
        "WARC-Type": "response",
        "WARC-Record-ID": record_id("response", key, url, digest(payload)),
        "WARC-Target-URI": url,
        "WARC-Date": date,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Block-Digest": digest(block),
        "WARC-Payload-Digest": digest(payload),
    }, block


def derivatives(headers: dict[str, str], block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Metadata and conversion record of a response; nothing for other types."""
    pairs = getattr(headers, "pairs", None) or list(headers.items())
    named = {k.lower(): v for k, v in reversed(pairs)}
    if named.get("warc-type") != "response":
        return []
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        head, payload = b"", block
    status, *fields = re.sub(r"\r\n[ \t]+", " ", head.decode("latin-1")).split("\r\n")
    http = [(k.lower(), v) for k, v in _pairs(fields)]
    every = lambda name: ",".join(v for k, v in http if k == name)
    codings = lambda name: [c.strip().lower() for c in every(name).split(",")]
    failed = ""
    body = payload
    try:
        for coding in reversed(codings("transfer-encoding")):
            body = _unchunked(body) if coding == "chunked" else _decoded(body, coding)
        sent = body
        for coding in reversed(codings("content-encoding")):
            body = _decoded(body, coding)
    except ValueError as error:  # no text rather than the text of coded bytes
        sent, body, failed = payload, b"", str(error)
    markup, charset = _markup(body, every("content-type"))
    text = plain_text(markup)
    title = _TITLE.search(markup)
    lang = _LANG.search(markup)
    facts = [
        ("title", " ".join(html.unescape(title[1]).split()) if title else ""),
        ("language", lang[1].lower() if lang else ""),
        ("outlinks", str(len(_LINK.findall(_DROPPED.sub(" ", markup))))),
        ("text-characters", str(len(text))),
        ("charset", charset),
        *([("decoding-error", failed)] if failed else []),
        ("status-line", status),
        *((f"http-{k}", v) for k, v in http),
        *((f"source-{k}", v) for k, v in pairs),
    ]
    described = "".join(f"{k}: {v}\r\n" for k, v in facts).encode("utf-8", "replace")
    source = named.get("warc-record-id", "")
    kept = {k: named[k.lower()] for k in ("WARC-Target-URI", "WARC-Date") if k.lower() in named}
    payload_digest = named.get("warc-payload-digest") or digest(sent)
    out = []
    for kind, content, mime in (
        ("metadata", described, "application/warc-fields"),
        ("conversion", text.encode("utf-8", "replace"), "text/plain; charset=utf-8"),
    ):
        out.append((
            {
                "WARC-Type": kind,
                "WARC-Record-ID": record_id(kind, source),
                "WARC-Refers-To": source,
                **kept,
                "Content-Type": mime,
                "WARC-Block-Digest": digest(content),
                "WARC-Source-Payload-Digest": payload_digest,
            },
            content,
        ))
    return out


def responses(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as response records; null urls and pages are empty ones.

    Equal rows give equal identifiers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                response_record(url, markup, UNDATED, key)
                for key, url, markup in zip(*(c.to_pylist() for c in batch.columns), strict=True)
            ]
            yield _batch(made)

    return pages.select(
        text_or_empty("page_id").alias("key"), text_or_empty("url").alias("url"), text_or_empty("html").alias("html")
    ).mapInArrow(run, RECORD)


def parse_records(files: DataFrame) -> DataFrame:
    """Records of WARC files, from a frame with a binary column ``content`` (one file each), as ``binaryFile`` reads them.

    A file's records are unpacked and handed on a few at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for data in batch.column(0):
                for record in read_records(data.as_py() or b""):
                    held.append(record)
                    size += len(record[1]) + 1024
                    if size > BATCH:
                        yield _batch(held)
                        held, size = [], 0
        if held:
            yield _batch(held)

    return files.select("content").mapInArrow(run, RECORD)


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of all responses among ``records``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for headers, block in zip(batch.column(0), batch.column(1), strict=True):
                pairs = [(x["name"], x["value"] or "") for x in headers.as_py() or []]
                made += derivatives(Fields(pairs), block.as_py() or b"")
            yield _batch(made)

    return records.where("record_type = 'response'").select("fields", "block").mapInArrow(run, RECORD)


def _batch(records: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([h.get("WARC-Record-ID") for h, _ in records], pa.string()),
            pa.array([h.get("WARC-Type") for h, _ in records], pa.string()),
            pa.array([list(h.items()) for h, _ in records], pa.map_(pa.string(), pa.string())),
            pa.array([b for _, b in records], pa.binary()),
            pa.array(
                [[{"name": k, "value": v} for k, v in getattr(h, "pairs", None) or h.items()] for h, _ in records],
                pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])),
            ),
        ],
        names=["record_id", "record_type", "headers", "block", "fields"],
    )


def derivative_report(pages: DataFrame) -> DataFrame:
    """One row per derived record of ``pages``, its text included for conversions."""
    derived = derive(responses(pages))
    field = lambda name: F.col("headers")[name]
    return derived.select(
        "record_id",
        "record_type",
        field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Date").alias("date"),
        field("Content-Type").alias("content_type"),
        field("WARC-Block-Digest").alias("block_digest"),
        field("WARC-Source-Payload-Digest").alias("payload_digest"),
        F.length("block").cast("long").alias("content_length"),
        F.col("block").cast("string").alias("content"),
    )
