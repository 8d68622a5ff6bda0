"""WARC derivatives: metadata and plain-text conversion records of response records.

``responses`` frames pages as WARC response records, ``derive`` reads response records (bytes, wherever they come
from) and builds two linked records of each: ``metadata`` (JSON with the source's WARC headers,
the HTTP status line and headers, title, links and digests) and ``conversion`` (the visible text).
Both carry WARC-Refers-To with the response's id, its target, date and payload digest, and
WARC-Concurrent-To with each other's id.  Ids are name-based UUIDs, so reruns agree.  ``write`` stores records as WARC files.

Nulls: a null url gives no WARC-Target-URI, a null html an empty payload.  Empty and very long pages are handled whole;
repeated rows give the same records again; records that are not responses, or whose headers do not end, have no
derivatives; an empty table gives an empty result; other columns are ignored.
Markup: text in script, style, template and noscript and in comments is dropped, block elements part lines,
an unclosed comment or script runs to the end as in a browser, and a tag ends at the first ``>``.
"""
from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
SCHEMA = ("record_id string, warc_type string, refers_to string, concurrent_to string, target_uri string, date string, "
          "source_digest string, block_digest string, content_length long, block string")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|<!--|<[!?][^<>]*+>")  # possessive: a run without its end is read once
_ATTR = re.compile(r"""\b(href|src)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_CHARSET = re.compile(r"charset\s*=\s*\"?([\w.:-]+)", re.I)
_DROP = {"script", "style", "template", "noscript"}
# fixed values: HTML elements that start and end a line
_BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
           "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "option", "p", "pre", "section", "table", "tbody", "td",
           "tfoot", "th", "thead", "title", "tr", "ul"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A WARC record; headers without a value are left out."""
    own = [(k, v) for k, v in headers if v is not None] + [("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in own) + "\r\n").encode() + block + b"\r\n\r\n"


def _line(value: str | None) -> str | None:
    return None if value is None else re.sub(r"[\r\n]+", " ", value)


def parse(data: bytes) -> tuple[list[tuple[str, str]], bytes] | None:
    """Headers and block of a record, or None where there is no end of headers."""
    head, end, rest = data.partition(b"\r\n\r\n")
    if not end:
        return None
    rows = head.decode("utf-8", "replace").split("\r\n")
    headers = [(k.strip(), v.strip()) for k, _, v in (r.partition(":") for r in rows[1:])]
    size = next((v for k, v in headers if k.lower() == "content-length"), "")
    return headers, rest[:int(size)] if size.isdigit() else rest


def visible(page: str) -> tuple[str, str, list[str]]:
    """(title, text, links) of a page in one pass over its tags."""
    out, links, title = [], [], []
    at, inside = 0, False

    def text(upto: int) -> None:
        piece = html.unescape(page[at:upto])
        (title if inside else out).append(piece)
    while (m := _TAG.search(page, at)) is not None:
        text(m.start())
        at = m.end()
        name = (m[2] or "").lower()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
        elif name in _DROP and not m[1]:
            shut = re.compile(rf"</{name}\b", re.I).search(page, at)
            end = -1 if shut is None else page.find(">", shut.end())
            at = len(page) if end < 0 else end + 1
        else:
            if name == "title":
                inside = not m[1]
            if name in _BLOCKS:
                out.append("\n")
            if m[3] and not m[1]:
                links += [html.unescape(v.strip("\"'")) for _, v in _ATTR.findall(m[3])]
    text(len(page))
    rows = (" ".join(r.split()) for r in "".join(out).split("\n"))
    return " ".join("".join(title).split()), "\n".join(r for r in rows if r), links


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, record) of each page as a WARC response record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                found = []
                for pid, url, page in zip(*(part[c].to_pylist() for c in ("page_id", "url", "html"))):
                    body = (page or "").encode()
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                    name = uuid.uuid5(_SPACE, f"response {pid} {url} {digest(body)}")
                    found.append(record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Target-URI", _line(url)), ("WARC-Date", date),
                                         ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")], block))
                yield pa.RecordBatch.from_arrays([part["page_id"], pa.array(found, pa.binary())], ["page_id", "record"])
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, record binary")


def derivatives(data: bytes) -> list[dict]:
    """The metadata and conversion record of one response record, as rows of ``SCHEMA``."""
    found = parse(data)
    if found is None:
        return []
    headers, block = found
    named = {k.lower(): v for k, v in headers}
    if named.get("warc-type") != "response":
        return []
    head, _, body = block.partition(b"\r\n\r\n")
    rows = head.decode("utf-8", "replace").split("\r\n")
    http = [[k.strip(), v.strip()] for k, _, v in (r.partition(":") for r in rows[1:])]
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    charset = _CHARSET.search(kind)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    title, text, links = visible(page)
    source, uri = named.get("warc-record-id"), named.get("warc-target-uri")
    payload = named.get("warc-payload-digest") or digest(body)
    base = uri or ""

    def full(link: str) -> str:
        try:
            return urljoin(base, link)
        except ValueError:  # not a URL; kept as it stands
            return link
    meta = json.dumps({
        "warc": [list(h) for h in headers], "http": {"status": rows[0], "headers": http}, "payload": {"digest": payload, "length": len(body)},
        "html": {"title": title, "links": [{"url": x, "resolved": full(x)} for x in links]}, "text": {"digest": digest(text.encode()), "length": len(text)}}, ensure_ascii=False)
    ids = {k: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{k} {source}')}>" for k in ("metadata", "conversion")}
    return [{"record_id": ids[k], "warc_type": k, "refers_to": source, "concurrent_to": ids[other], "target_uri": uri, "date": named.get("warc-date"),
             "source_digest": payload, "block_digest": digest(b.encode()), "content_length": len(b.encode()), "block": b}
            for k, other, b in (("metadata", "conversion", meta), ("conversion", "metadata", text))]


def derive(records: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA``, two per response in the binary column ``record``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            for i in range(0, b.num_rows, 128):
                rows = [r for x in b["record"].slice(i, 128) if x.is_valid for r in derivatives(x.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64() if c == "content_length" else pa.string()) for c in names], names)
    return records.select("record").mapInArrow(run, SCHEMA)


def write(derived: DataFrame, path: str) -> None:
    """Store derived records as gzip WARC files, one per partition."""
    head = ["WARC/1.1", F.concat(F.lit("WARC-Type: "), "warc_type"), F.concat(F.lit("WARC-Record-ID: "), "record_id"),
            F.concat(F.lit("WARC-Refers-To: "), "refers_to"), F.concat(F.lit("WARC-Concurrent-To: "), "concurrent_to"),
            F.concat(F.lit("WARC-Target-URI: "), "target_uri"), F.concat(F.lit("WARC-Date: "), "date"),
            F.concat(F.lit("WARC-Block-Digest: "), "block_digest"),
            F.concat(F.lit("Content-Type: "), F.when(F.col("warc_type") == "metadata", "application/json").otherwise("text/plain")),
            F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string"))]
    parts = [F.lit(h) if isinstance(h, str) else h for h in head]
    whole = F.concat(F.concat_ws("\r\n", *parts), F.lit("\r\n\r\n"), "block")
    derived.select(whole.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
