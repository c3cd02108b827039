"""WARC derivatives: response records become metadata and plain-text conversion records.

A response record holds a target URI, a date, HTTP headers and a body in bytes. From each one a `metadata` record (title, language, links and
lengths, as application/warc-fields) and a `conversion` record (the visible text) are made. Both refer to the response by its
record id, repeat its target URI and date, and carry its HTTP headers and digests: the payload digest that the response states, or else that of its
bytes, and the block digest if it states one. Each has the digests of its own block. Record ids are UUIDs made from the response's id and the kind, so building
again gives the same records.

Bodies are taken out of their transfer and content encodings (chunked, gzip, deflate) if these can be undone, and decoded by the charset of the headers, then of
a meta element, then as UTF-8, and as Windows-1252 if they are not that. Tags are read in one pass from left to right: a tag ends at the first `>`, one that
never ends takes the rest of the page with it, and so do a comment, script, style or template without an end.

A page without URL or HTML still has its records: an empty target and empty text. Equal rows are told apart by nothing and
get equal records. An empty table gives no records. Extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2020-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the one for URLs, by RFC 4122
#: Elements whose content is not text; what may stand in a head; elements that end a line.
_RAW = frozenset(("script", "style", "noscript", "template", "title"))
_HEAD = _RAW | frozenset(("html", "head", "meta", "link", "base"))
_BREAKS = frozenset("br p div li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav header footer blockquote pre body".split())
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_ENDS = {name: re.compile(f"</{name}", re.I) for name in _RAW}
_HREF = re.compile(r"(?<![\w-])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_LANG = re.compile(r"(?<![\w-])lang\s*=\s*[\"']?([\w-]+)", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
#: Bytes in which a meta element may state the charset.
_META_BYTES = 1024

RESPONSE = "page_id long, record_id string, target_uri string, date string, http_headers string, body binary, payload_digest string, source_block_digest string, truncated boolean"
RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, source_headers string, source_digest string, block_digest string, headers string, block string"


class Page(NamedTuple):
    title: str | None
    language: str | None
    links: list[str]
    text: str


def read_page(html: str) -> Page:
    """Title, language, links and visible text, in one pass; each search for an end that fails is the last of its kind."""
    title = language = None
    links: list[str] = []
    out: list[str] = []
    in_head, at = False, 0
    while (opens := html.find("<", at)) >= 0:
        if not in_head:
            out.append(html[at:opens])
        name = _NAME.match(html, opens + 1)
        if html.startswith("<!--", opens):
            ends = html.find("-->", opens + 4)
            at = ends + 3 if ends >= 0 else len(html)
            out.append(" ")
            continue
        if name is None and html[opens + 1 : opens + 2] not in ("!", "?"):
            if not in_head:
                out.append("<")
            at = opens + 1
            continue
        ends = html.find(">", opens)
        if ends < 0:
            at = len(html)
            break
        at = ends + 1
        if name is None:
            continue
        tag = name[0].lower()
        if in_head and tag.lstrip("/") not in _HEAD or tag == "/head":
            in_head = False
        if tag in _RAW:
            close = _ENDS[tag].search(html, at)
            inside = html[at : close.start() if close else len(html)]
            if tag == "title" and title is None and close:
                title = inside
            after = html.find(">", close.start()) if close else -1
            at = after + 1 if after >= 0 else len(html)
            if not in_head:
                out.append(" ")
        elif tag == "head":
            in_head = True
        elif tag == "html" and language is None and (said := _LANG.search(html, name.end(), ends)):
            language = said[1]
        elif tag == "a" and (href := _HREF.search(html, name.end(), ends)):
            links.append(entities.unescape(href[1] or href[2] or href[3] or ""))
        if tag.lstrip("/") in _BREAKS and not in_head:
            out.append("\n")
    if not in_head:
        out.append(html[at:])
    text = entities.unescape("".join(out)).replace("\xa0", " ")
    title = None if title is None else _one_line(entities.unescape(title))
    return Page(title, language, links, _LINES.sub("\n", _BLANKS.sub(" ", text)).strip())


def visible_text(html: str) -> str:
    """The text between tags, without scripts, styles, comments and the head; block elements end lines."""
    return read_page(html).text


def _unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        ends = data.find(b"\r\n", at, at + 64)
        size = int(data[at : ends if ends >= 0 else at].partition(b";")[0] or b"x", 16)  # no number: an error, as for other damage
        if not size:
            return b"".join(out)
        out.append(data[ends + 2 : ends + 2 + size])
        at = ends + size + 4


def decoded(body: bytes, http_headers: str) -> str:
    """The text of a body: its encodings undone as far as they can be, then its charset."""
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http_headers.split("\r\n")[1:])}
    try:
        if "chunked" in fields.get("transfer-encoding", "").lower():
            body = _unchunked(body)
        coding = fields.get("content-encoding", "").lower()
        if coding in ("gzip", "x-gzip", "deflate"):
            body = zlib.decompressobj(47).decompress(body)  # 47: gzip or zlib, by what stands at the start
    except (ValueError, zlib.error):
        pass  # what is stated is often undone before a crawl is stored
    said = _CHARSET.search(fields.get("content-type", "")) or _CHARSET.search(body[:_META_BYTES].decode("latin-1"))
    for charset in ([said[1]] if said else []) + ["utf-8", "cp1252"]:
        try:
            return body.decode(charset)
        except (LookupError, ValueError):
            continue
    return body.decode("utf-8", "replace")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(0).join(parts))}>"


def _one_line(value: str) -> str:
    return " ".join(value.split())


def record_headers(kind: str, own: str, target: str, date: str, content_type: str, block: bytes, more: list[tuple[str, str]]) -> str:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", _one_line(target)), *more]
    fields += [("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v) + "\r\n"


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """The pages as response records; a crawl's own WARC files are read by `read_warc`."""
    headers = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("target_uri"), F.coalesce("html", F.lit("")).cast("binary").alias("body"))
    # A version 5 UUID of (page_id, url), as `record_id` makes it, by hash functions of Spark.
    raw = F.sha1(F.concat(F.lit(_NAMESPACE.bytes), F.concat_ws("\0", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "target_uri", F.lit("response")).cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(raw, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    own = F.concat(F.lit("<urn:uuid:"), F.substring(raw, 1, 8), F.lit("-"), F.substring(raw, 9, 4), F.lit("-5"), F.substring(raw, 14, 3), F.lit("-"), variant, F.substring(raw, 18, 3), F.lit("-"), F.substring(raw, 21, 12), F.lit(">"))
    return rows.select("page_id", own.alias("record_id"), "target_uri", F.lit(date).alias("date"), F.lit(headers).alias("http_headers"), "body", *(F.lit(None).cast("string").alias(c) for c in ("payload_digest", "source_block_digest")), F.lit(False).alias("truncated"))


def derive(response: dict) -> list[dict]:
    """The metadata and the conversion record of one response."""
    body, target, source = response["body"] or b"", response["target_uri"] or "", response["record_id"] or ""
    sent = response["http_headers"] or ""
    payload = response["payload_digest"] or digest(body)
    page = read_page(decoded(body, sent))
    fields = [("title", page.title), ("language", page.language), ("source-truncated", "true" if response["truncated"] else None)]
    fields += [("html-length", str(len(body))), ("text-length", str(len(page.text.encode("utf-8", "replace")))), ("outlinks", str(len(page.links)))]
    fields += [("outlink", _one_line(x)) for x in page.links]
    metadata = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    status, *lines = sent.split("\r\n")
    kept = [("WARC-Source-Status", status), ("WARC-Source-Block-Digest", response["source_block_digest"] or "")]
    kept += [(f"WARC-Source-{k.strip()}", _one_line(v)) for k, _, v in (x.partition(":") for x in lines if ":" in x)]
    out = []
    for kind, content_type, block in (("metadata", "application/warc-fields", metadata), ("conversion", "text/plain; charset=utf-8", page.text)):
        data = block.encode("utf-8", "replace")
        own, block = record_id(source, kind), data.decode()
        more = [("WARC-Refers-To", source), ("WARC-Refers-To-Payload-Digest", payload), *kept]
        out.append(
            {
                "page_id": response["page_id"], "record_type": kind, "record_id": own, "refers_to": source, "target_uri": target, "date": response["date"], "content_type": content_type,
                "source_headers": response["http_headers"], "source_digest": payload, "block_digest": digest(data),
                "headers": record_headers(kind, own, target, response["date"] or "", content_type, data, more), "block": block,
            }
        )
    return out


def derivatives(response_rows: DataFrame) -> DataFrame:
    """Two records for each response, made where the response is read; nothing is shuffled."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                made = [r for x in batch.slice(at, 256).to_pylist() for r in derive(x)]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in made], pa.int64() if n == "page_id" else pa.string()) for n in names], names=names)

    return response_rows.select(*(x.split()[0] for x in RESPONSE.split(", "))).mapInArrow(task, RECORD)


def to_bytes(headers: str, block: str) -> bytes:
    """A record as it stands in a file."""
    return headers.encode() + block.encode() + b"\r\n\r\n"


def write_warc(records: DataFrame, path: str) -> None:
    """A file for each partition; the separator is what ends a record in WARC, so files can be put one after another."""
    records.select(F.concat("headers", "block").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at) + 4
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]) if k}
        length = int(fields.get("content-length", 0))
        yield fields, data[end : end + length]
        at = end + length


def _record(data: bytes) -> tuple[dict[str, str], bytes, bool] | None:
    """(headers, block, whether it is cut short) of what stands between two separators; None if it is no record."""
    head, found, block = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if v}
    length = fields.get("content-length", "")
    if not found and not fields or not length.isdigit():
        return None
    return fields, block[: int(length)], len(block) < int(length)


_BETWEEN = "\r\n\r\nWARC/1."


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files, gzipped (`.gz`) or not, for `derivatives`.

    Files are read as text that the start of a record parts, so that a task holds one record at a time and plain files are split. Where a
    block itself holds that sequence, its parts are put together again by its Content-Length, if one task reads them; a
    record that stays shorter than it says is given with `truncated` set.
    """
    names = [x.split()[0] for x in RESPONSE.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 4, pa.binary(), *[pa.string()] * 2, pa.bool_()]

    def row(fields: dict[str, str], block: bytes, short: bool) -> tuple:
        head, _, body = block.partition(b"\r\n\r\n")
        get = fields.get
        return None, get("warc-record-id"), get("warc-target-uri"), get("warc-date"), head.decode("latin-1") + "\r\n\r\n", body, get("warc-payload-digest"), get("warc-block-digest"), short or "warc-truncated" in fields

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = b""
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for value in batch.column(0).slice(at, 64):
                    data = value.as_py()
                    if held and not data.startswith(b"WARC/") and (found := _record(held)) and found[2]:
                        held += _BETWEEN.encode() + data
                        continue
                    if held and (found := _record(held)) and found[0].get("warc-type") == "response":
                        rows.append(row(*found))
                    held = data
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)
        if held and (found := _record(held)) and found[0].get("warc-type") == "response":
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row(*found), kinds, strict=True)], names=names)

    return spark.read.option("lineSep", _BETWEEN).text(path).select(F.col("value").cast("binary").alias("value")).mapInArrow(task, RESPONSE)
