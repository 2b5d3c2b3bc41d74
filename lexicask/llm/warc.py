"""WARC derivatives: metadata and plain-text conversion records of response records.

`responses` writes fetched pages as response records, whole and in the file format. `derive` reads such records back by `parse`
and gives the response itself and two records derived from it: metadata (application/warc-fields: title, language, links and the
source's own WARC and HTTP headers) and conversion (text/plain). Both carry their own identifier, the response's in
WARC-Refers-To, its target, date and payload digest as they stand in the response, and a digest of their own block;
`record_bytes` is a whole record as it stands in a WARC file.

Identifiers of derived records come from the response's identifier and payload, so a repeated task makes the same ones. Defined
results: a null url or html is empty; a page that has no text gets a conversion record with an empty block; a response without a
payload digest gets one, and one whose block or payload digest does not hold is derived with `digest-check: failed` in its
metadata; records of other types give nothing; bytes that are not a record raise an error; repeated rows are separate pages with
the same identifiers; an empty table gives no record. A page is read once from left to right, whatever it holds: a `<` that no
`>` ends is text, and what opens a comment or a script without an end hides the rest. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicask.llm.common import slices, table

#: Date of records whose source gives none.
DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122

#: A comment's beginning, or a whole tag: tried where a `>` is known to follow, so each part is read once.
_TOKEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|[/!?][^>]*>)")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Fixed values of HTML: elements whose content is not text, and elements that end a line.
RAW = {x: re.compile(f"</{x}[^a-zA-Z0-9]", re.I) for x in ("script", "style", "template", "noscript", "title", "textarea")}
HIDDEN = {"script", "style", "template", "noscript"}
BLOCKS = set("p div h1 h2 h3 h4 h5 h6 ul ol li tr table section article header footer nav aside main blockquote pre form dl dt dd br hr".split())
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[\s]*")

RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, content_type string, block_digest string, payload_digest string, content_length long, headers string, block string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join((kind, *parts)))}>"


def _line(value: str) -> str:
    """A value that stays within one header line."""
    return re.sub(r"[\r\n\t ]+", " ", value).strip()


def _attributes(inside: str) -> dict[str, str]:
    """The first value of each attribute of a tag, entities resolved."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(inside):
        found.setdefault(name.lower(), entities.unescape(a or b or c))
    return found


def scan(page: str) -> tuple[str, str | None, str | None, list[str]]:
    """Visible text, title, language and link targets of a page, in one pass.

    Visible text has no head, scripts, styles or comments; blocks end lines; entities are resolved; white space is collapsed.
    """
    out: list[str] = []
    title = lang = None
    links: list[str] = []
    at, stop, in_head, headed = 0, page.rfind(">") + 1, False, False
    flat = lambda text: text.replace("\r", " ").replace("\n", " ")
    while (m := _TOKEN.search(page, at, stop)) is not None:
        if not in_head:
            out.append(flat(page[at : m.start()]))
        at = m.end()
        if m[1]:
            at = page.find("-->", at) + 3
            if at < 3:
                at = stop = len(page)
            continue
        name, closing = (m[3] or "").lower(), m[2] == "/"
        if name == "head":
            if closing:
                in_head = False
            elif not headed:
                in_head = headed = True
        elif name == "body":
            in_head = False
        elif name == "html" and not closing and lang is None:
            lang = _attributes(m[4]).get("lang")
        elif name == "a" and not closing and "href" in (found := _attributes(m[4])):
            links.append(found["href"])
        if name in RAW and not closing and not m[4].endswith("/"):
            end = RAW[name].search(page, at)
            inside = page[at : end.start() if end else len(page)]
            if name == "title" and title is None:
                title = entities.unescape(inside)
            if name not in HIDDEN and not in_head:
                out.append(flat(inside))
            at = end.start() if end else len(page)
            if not end:
                stop = at
        elif not in_head and name in BLOCKS:
            out.append("\n")
    if not in_head:
        out.append(flat(page[at:]))
    text = "".join(out)
    if "&" in text:
        text = entities.unescape(text)
    return _LINES.sub("\n", _BLANK.sub(" ", text)).strip(), title, lang, links


def plain_text(page: str) -> str:
    return scan(page)[0]


def http_block(page: str, content_type: str = "text/html; charset=utf-8") -> tuple[bytes, bytes]:
    """HTTP head and payload of a response record."""
    payload = page.encode()
    return f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(payload)}\r\n\r\n".encode(), payload


def record_bytes(headers: str, block: str | bytes) -> bytes:
    return headers.encode() + b"\r\n" + (block.encode() if isinstance(block, str) else block) + b"\r\n\r\n"


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file's bytes."""
    at, out = 0, []
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:stop].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record starts at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        block = data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4
        if len(block) < size or data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("the last record is cut short")
        out.append((headers, block))
    return out


def _headers(kind: str, rid: str, refers: str, uri: str, date: str, content_type: str, payload_digest: str, block: bytes) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}"]
    lines += [f"WARC-Refers-To: {refers}", f"WARC-Refers-To-Target-URI: {uri}", f"WARC-Refers-To-Date: {date}"] if refers else []
    lines += [f"WARC-Payload-Digest: {payload_digest}", f"WARC-Block-Digest: {digest(block)}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "".join(x + "\r\n" for x in lines)


def response(uri: str, page: str, date: str = DATE) -> bytes:
    """The response record of a fetched page."""
    head, payload = http_block(page)
    uri, payload_digest = _line(uri), digest(payload)
    rid = record_id("response", uri, payload_digest)
    return record_bytes(_headers("response", rid, "", uri, date, "application/http; msgtype=response", payload_digest, head + payload), head + payload)


def derivatives(headers: dict[str, str], block: bytes) -> list[tuple]:
    """Metadata and conversion records of a parsed response: (type, id, content type, digest, length, headers, block)."""
    head, _, payload = block.partition(b"\r\n\r\n")
    rid, uri, date, payload_digest = headers["WARC-Record-ID"], headers.get("WARC-Target-URI", ""), headers.get("WARC-Date", DATE), digest(payload)
    claimed = headers.get("WARC-Payload-Digest", payload_digest)
    sound = claimed == payload_digest and headers.get("WARC-Block-Digest") in (None, digest(block))
    text, title, lang, links = scan(payload.decode("utf-8", "replace"))
    fields = [f"source-{k}: {v}" for k, v in headers.items()]
    fields += [f"source-http-{_line(x)}" for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x]
    fields += ["digest-check: failed"] * (not sound)
    fields += [f"title: {_line(x)}" for x in (title,) if x is not None] + [f"language: {_line(x).lower()}" for x in (lang,) if x]
    fields += [f"outlink: {_line(x)}" for x in links]
    made = []
    for kind, content_type, content in (("metadata", "application/warc-fields", "".join(f"{x}\r\n" for x in fields)), ("conversion", "text/plain; charset=utf-8", text)):
        new, data = record_id(kind, rid, payload_digest), content.encode("utf-8", "replace")
        made.append((kind, new, content_type, digest(data), len(data), _headers(kind, new, rid, uri, date, content_type, claimed, data), data.decode()))
    return made


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id and record, the bytes of each page's response record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 128, column="html"):
                made = [response(uri, page, date) for uri, page in zip(some.column("url").to_pylist(), some.column("html").to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column("page_id"), pa.array(made, pa.binary())], names=["page_id", "record"])

    own = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return own.mapInArrow(run, "page_id long, record binary")


def derive(records: DataFrame, keep: bool = True) -> DataFrame:
    """Rows of RECORD of page_id and record (bytes of one record or more): of each response, with keep, itself, and the two records derived from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in RECORD.split(", ")]
        for batch in batches:
            for some in slices(batch, 128, column="record"):
                rows = []
                for page_id, data in zip(some.column("page_id").to_pylist(), some.column("record").to_pylist()):
                    for headers, block in parse(data or b""):
                        if headers.get("WARC-Type") != "response":
                            continue
                        rid, uri, claimed = headers["WARC-Record-ID"], headers.get("WARC-Target-URI", ""), headers.get("WARC-Payload-Digest", "")
                        if keep:
                            lines = "".join(f"{x}\r\n" for x in ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items())])
                            rows.append((page_id, "response", rid, None, uri, headers.get("Content-Type", ""), digest(block), claimed, len(block), lines, block.decode("utf-8", "replace")))
                        for kind, new, content_type, own, n, lines, content in derivatives(headers, block):
                            rows.append((page_id, kind, new, rid, uri, content_type, own, claimed or digest(block.partition(b"\r\n\r\n")[2]), n, lines, content))
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return records.select(F.col("page_id").cast("long"), F.col("record").cast("binary")).mapInArrow(run, RECORD)


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")))
