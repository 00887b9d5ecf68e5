"""WARC derivatives: metadata and plain-text conversion records of response records.

responses() makes response records of fetched pages: an HTTP block with its headers, block and payload digests (SHA-1 in
base 32), and an id that follows from what the record holds. derive() turns every response into two records: metadata
(warc-fields: title, language, outlinks and the source's headers) and conversion (the page's plain text). Both refer to the
response by its id, keep its target address and date, name each other, and carry digests of their own block.
serialize() writes records in the WARC/1.1 format, parse() reads them.

All rows are independent: no shuffle, one record at a time in memory. Null url: an empty target. Null or empty html: an
empty payload, title and text. Repeated pages give equal records with equal ids. Malformed markup is read as it comes.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "WARC/1.1"
TEXT = pa.string()
HEADERS = pa.list_(pa.struct([("name", TEXT), ("value", TEXT)]))
RECORD = pa.schema([("record_type", TEXT), ("record_id", TEXT), ("refers_to", TEXT), ("concurrent_to", TEXT), ("target_uri", TEXT), ("date", TEXT), ("content_type", TEXT), ("content_length", pa.int64()), ("block_digest", TEXT), ("payload_digest", TEXT), ("source_headers", HEADERS), ("block", pa.binary())])
SPARK_RECORD = "record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, content_type string, content_length long, block_digest string, payload_digest string, source_headers array<struct<name: string, value: string>>, block binary"
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_STOP = re.compile(r"[<>=]")
_QUOTE = re.compile(r"\s*([\"'])")
_HREF, _LANG = (re.compile(rf"(?i)\b{k}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))") for k in ("href", "lang"))
# Elements whose content isn't markup, those that readers don't see, and those that start a line.
RAW = {"script", "style"}
HIDDEN = {"noscript", "template", "svg", "head"}
BLOCKS = {"p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "nav", "main", "aside", "blockquote", "pre", "hr", "form", "dl", "dt", "dd"}
_CLOSING = {k: re.compile(rf"(?i)</{k}\s*>") for k in RAW | HIDDEN} | {"title": re.compile("(?i)</title")}


class Page:
    """Text, title, language and links of a page, read in one forward pass.

    A tag starts where a letter, /, ! or ? follows <, ends at the next > outside quotes, and doesn't run across another <
    outside quotes; anything else is text. What has no end mark is looked for once only, and a place from which no tag
    ends isn't tried again, so the time is linear in the length of the page, whatever it holds.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.text: list[str] = []
        self.links: list[str] = []
        self.title = self.lang = None
        self.absent: set[str] = set()
        self.dead: set[int] = set()
        self._read()

    def _find(self, mark: str, at: int) -> int:
        """Where mark is next; -1 if nowhere from here on, which is remembered."""
        if mark in self.absent:
            return -1
        k = self.page.find(mark, at)
        if k < 0:
            self.absent.add(mark)
        return k

    def _closing(self, name: str, at: int) -> re.Match | None:
        if f"/{name}" in self.absent:
            return None
        m = _CLOSING[name].search(self.page, at)
        if m is None:
            self.absent.add(f"/{name}")
        return m

    def _tag_end(self, at: int) -> int:
        """The end of the tag that starts at a place, or -1. In a value in quotes, < and > count for nothing."""
        seen, at = [], at + 2
        while m := _STOP.search(self.page, at):
            k = m.start()
            if m[0] == ">":
                return k + 1
            if m[0] == "<" or k in self.dead:
                break
            seen.append(k)
            quote = _QUOTE.match(self.page, k + 1)
            end = self._find(quote[1], quote.end()) if quote else -1
            at = end + 1 if end >= 0 else k + 1
        self.dead.update(seen)
        return -1

    def _read(self) -> None:
        page, at, hidden, plain = self.page, 0, 0, 0  # hidden: nothing before this place is seen; plain: start of the text at hand

        def say(to: int, then: str) -> None:
            if plain < to and to > hidden:
                self.text.append(page[max(plain, hidden) : to])
            if to >= hidden:
                self.text.append(then)

        while (k := page.find("<", at)) >= 0:
            at = k + 1
            mark = page[k + 1 : k + 2]
            if page.startswith("<!--", k) and (end := self._find("-->", k + 4)) >= 0:
                say(k, " ")
                at = plain = end + 3
                continue
            if not (mark.isascii() and mark.isalpha()) and mark not in ("/", "!", "?"):
                continue
            name = _NAME.match(page, k)
            name = name[1].lower() if name else ""
            if mark != "/" and name in RAW | HIDDEN and (close := self._closing(name, k)):
                say(k, " ")
                if name in RAW:
                    at = plain = close.end()
                    continue
                hidden = max(hidden, close.end())
            end = self._tag_end(k)
            if end < 0:
                continue
            if name not in HIDDEN or mark == "/":
                say(k, "\n" if name in BLOCKS else "")
            at = plain = end
            if mark == "/":
                continue
            if name == "a" and (m := _HREF.search(page, k, end)):
                self.links.append(m[1] or m[2] or m[3] or "")
            elif name == "html" and self.lang is None and (m := _LANG.search(page, k, end)):
                self.lang = m[1] or m[2] or m[3]
            elif name == "title" and self.title is None and (close := self._closing("title", end)):
                self.title = page[end : close.start()]
        say(len(page), "")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _pairs(headers: list[tuple[str, str]]) -> list[dict[str, str]]:
    return [{"name": k, "value": v} for k, v in headers]


def record_id(kind: str, *parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join([kind, *parts]))}>"


def plain_text(page: str | Page) -> str:
    """What a reader sees of a page, a block a line."""
    body = "".join((Page(page) if isinstance(page, str) else page).text)
    lines = (" ".join(x.split()) for x in entities.unescape(body).split("\n"))
    return "\n".join(x for x in lines if x)


def split_block(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """The HTTP headers, repeated ones too, and the payload of a response block."""
    head, _, payload = block.partition(b"\r\n\r\n")
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return [(k.strip(), v.strip()) for k, _, v in pairs if k], payload


def _response(url: str | None, page: str | None, date: str) -> dict:
    payload = (page or "").encode()
    headers = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    block = ("HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode() + payload
    out = {"record_type": "response", "refers_to": None, "concurrent_to": None, "target_uri": url or "", "date": date, "content_type": "application/http; msgtype=response", "content_length": len(block), "block_digest": digest(block), "payload_digest": digest(payload), "source_headers": _pairs(headers), "block": block}
    return out | {"record_id": record_id("response", out["target_uri"], date, out["block_digest"])}


def _derived(r: dict) -> list[dict]:
    headers, payload = split_block(r["block"] or b"")
    page = Page(payload.decode("utf-8", "replace"))
    ids = {k: record_id(k, r["record_id"] or "") for k in ("metadata", "conversion")}
    fields = [("title", " ".join(entities.unescape(page.title or "").split())), ("languages", (page.lang or "").lower()), ("source-payload-digest", r["payload_digest"] or "")]
    fields += [(f"source-header-{k.lower()}", v) for k, v in headers]
    for link in page.links:
        link = " ".join(entities.unescape(link).split())
        try:
            fields.append(("outlink", urljoin(r["target_uri"] or "", link)))
        except ValueError:  # an address that can't be resolved stays as it is
            fields.append(("outlink", link))
    blocks = {"metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode()), "conversion": ("text/plain; charset=utf-8", plain_text(page).encode())}
    out = []
    for kind, (content_type, block) in blocks.items():
        other = ids["conversion" if kind == "metadata" else "metadata"]
        out.append({"record_type": kind, "record_id": ids[kind], "refers_to": r["record_id"], "concurrent_to": other, "target_uri": r["target_uri"], "date": r["date"], "content_type": content_type, "content_length": len(block), "block_digest": digest(block), "payload_digest": r["payload_digest"], "source_headers": _pairs(headers), "block": block})
    return out


def _rows(df: DataFrame, make, keep: list[str]) -> DataFrame:  # noqa: ANN001
    """For each row the records that make(row) gives, with the columns to keep."""
    fields = [f for f in df.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                made = [(k, x) for k, row in enumerate(part.to_pylist()) for x in make(row)]
                at = pa.array([k for k, _ in made], pa.int64())
                cols = [part.column(f.name).take(at) for f in fields]
                cols += [pa.array([x[f.name] for _, x in made], f.type) for f in RECORD]
                yield pa.RecordBatch.from_arrays(cols, [*[f.name for f in fields], *RECORD.names])

    schema = T.StructType([*fields, *T.StructType.fromDDL(SPARK_RECORD).fields])
    return df.mapInArrow(run, schema)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A response record of each page, beside its id."""
    rows = pages.select(F.col(id_col), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    return _rows(rows, lambda r: [_response(r["_url"], r["_html"], date)], [id_col])


def derive(records: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The metadata and the conversion record of each response record; other records have none."""
    return _rows(records.where("record_type = 'response'"), _derived, list(keep))


def record_bytes(r: dict) -> bytes:
    names = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "concurrent_to": "WARC-Concurrent-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "content_length": "Content-Length", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest"}
    head = "".join(f"{name}: {r[k]}\r\n" for k, name in names.items() if r[k] not in (None, ""))
    return f"{VERSION}\r\n{head}\r\n".encode() + (r["block"] or b"") + b"\r\n\r\n"


def serialize(records: DataFrame) -> DataFrame:
    """records with `warc`: the bytes of each as a WARC file has them; files are such bytes end to end."""
    fields = [f for f in records.schema.fields if f.name != "warc"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [record_bytes(r) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in names], pa.array(raw, pa.binary())], [*names, "warc"])

    return records.mapInArrow(run, T.StructType([*fields, T.StructField("warc", T.BinaryType())]))


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The header fields and the block of each record of a WARC file."""
    out, at = [], 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        pairs = (x.partition(": ") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        head = {k: v for k, _, v in pairs}
        size = int(head["Content-Length"])
        out.append((head, data[end + 4 : end + 4 + size]))
        at = end + 4 + size + 4
    return out
