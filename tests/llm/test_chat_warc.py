"""Chat formatting and WARC derivatives."""

import hashlib
import random
import re
import time
from html.parser import HTMLParser

import pytest

from lexicask.llm import chat, warc

PARTS = ["<|im_start|>", "<|im_end|>", "\n", "<", "|", "\\", "<\\|", "<\\\\|", "user", "assistant ok", "é😀", ""]


def test_any_turns_come_back():
    rng = random.Random(1)
    for _ in range(3000):
        turns = [("".join(rng.choices(PARTS, k=rng.randint(0, 2))), "".join(rng.choices(PARTS, k=rng.randint(0, 6)))) for _ in range(rng.randint(1, 3))]
        formatted, found = chat.render(turns)
        assert [(r, t) for r, t, _, _ in found] == turns == [(r, t) for r, t, _, _ in chat.parse(formatted)]
        assert all(chat.unescape(formatted[a:b]) == t for _, t, a, b in found)
        assert formatted.count(chat.START) == formatted.count(chat.END) == len(turns)


def test_plain_texts_are_not_escaped():
    formatted, _ = chat.render([("user", "a <| b |> <|x|> \\ c")])
    assert formatted == "<|im_start|>user\na <| b |> <|x|> \\ c<|im_end|>\n"


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user", "<|im_start|>user\nx", "<|im_start|>user\nx<|im_end|>", "<|im_start|>a\\z\nx<|im_end|>\n", "<|im_start|>u\na<|im_start|>b<|im_end|>\n"])
def test_grammar_is_strict(bad):
    with pytest.raises(chat.Grammar):
        chat.parse(bad)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", "one"), (1, 1, "assistant", "two"), (2, None, None, None), (None, 0, "assistant", "<|im_end|>"), (3, 0, "assistant", "é" * 100), (3, 1, "user", "q"), (3, 2, "assistant", "")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn int, role string, text string, chunk int").repartition(3)
    got = {r.conv_id: r for r in chat.digests(chat.formatted(df, most=40)).collect()}
    sha = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert set(got) == {1, 2, 3, None}
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars) == (3, sha(("user", "one"), ("assistant", "two"), ("assistant", "two")), 6)
    assert (got[2].n_turns, got[2].turns_sha256, got[2].loss_chars, got[2].loss_sha256) == (1, sha(("", "")), 0, hashlib.sha256().hexdigest())
    assert got[None].loss_sha256 == hashlib.sha256(b"<|im_end|>").hexdigest() and got[None].loss_chars == 10
    assert (got[3].n_turns, got[3].loss_chars) == (3, 100) and got[3].loss_sha256 == hashlib.sha256(("é" * 100).encode()).hexdigest()
    assert chat.formatted(df, most=40).filter("conv_id = 3").count() > 1
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


PAGE = '<!DOCTYPE html><html lang="de-AT"><head><title>A &amp; B</title><style>p{}</style></head><body><!-- no --><p>One<br>two &lt;x&gt;</p><script>var t="</p>";</script><a href="/x?a=1&amp;b=2">link</a> <A HREF=y>z</A></body></html>'


def test_plain_text():
    assert warc.plain_text(PAGE) == "One\ntwo <x>\nlink z"
    assert warc.plain_text("") == "" and warc.plain_text("a < b &bogus; <3") == "a < b &bogus; <3"
    assert warc.plain_text("<script>never closed") == "" and warc.plain_text("<p>a" * 3) == "a\na\na"
    assert warc.plain_text("a<!-- x > y") == "a" and warc.plain_text("a<!-- x > --> b <i") == "a b <i"
    assert warc.scan("<title>x <b> y</title>z<TITLE>no</TITLE>")[:2] == ("x <b> yzno", "x <b> y")


class Plain(HTMLParser):
    """The same page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.title, self.lang, self.links, self.skip, self.head = [], None, None, [], 0, False

    def handle_starttag(self, tag, attrs):
        given = dict(reversed(attrs))
        self.skip += tag in warc.HIDDEN
        self.head = tag == "head" or self.head and tag != "body"
        if tag == "html" and self.lang is None:
            self.lang = given.get("lang")
        if tag == "a" and "href" in given:
            self.links.append(given["href"] or "")
        if tag == "title" and self.title is None:
            self.title = ""
        if tag in warc.BLOCKS and not self.head:
            self.text.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in warc.HIDDEN
        self.head = self.head and tag != "head"
        if tag in warc.BLOCKS and not self.head:
            self.text.append("\n")

    def handle_data(self, data):
        if self.lasttag == "title" and self.title == "":
            self.title = data
        if not self.skip and not self.head:
            self.text.append(re.sub(r"[\r\n]", " ", data))


def test_pages_against_another_parser(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        other = Plain()
        other.feed(r.html)
        other.close()
        text, title, lang, links = warc.scan(r.html)
        flat = lambda x: re.sub(r"\s+", " ", x or "").strip()
        assert flat(text) == flat("".join(other.text)) and flat(title) == flat(other.title) and (lang or None) == (other.lang or None) and links == other.links, r.page_id


@pytest.mark.parametrize("piece", ["<a ", "<title>", "<script>", "<!--", "<html lang=", "<a href='", '<a href="', "<", "</", "< >", "<a href>", "<p ", "&amp", "<head>", "<a =\"'>"])
@pytest.mark.parametrize("end", ["", ">"])
def test_hostile_pages_take_linear_time(piece, end):
    page = piece * (10_000_000 // len(piece)) + end
    began = time.time()
    warc.scan(page)
    assert time.time() - began < 30


def test_records(spark):
    rows = [(1, "https://x.example/a\r\nEvil: 1", PAGE, "q"), (1, "https://x.example/a\r\nEvil: 1", PAGE, "q"), (2, None, None, "q"), (None, "u", "é" * 50000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record string").repartition(2)
    sources = warc.responses(df, date="2024-05-06T07:08:09Z")
    got = warc.derive(sources).collect()
    assert len(got) == 12 and warc.derive(sources, keep=False).count() == 8
    ids = {r.record_id for r in got if r.record_type == "response"}
    for r in got:
        (headers, block) = warc.parse(warc.record_bytes(r.headers, r.block))[0]
        assert block.decode() == r.block and len(block) == r.content_length == int(headers["Content-Length"])
        assert headers["WARC-Type"] == r.record_type and headers["WARC-Record-ID"] == r.record_id and headers["WARC-Date"] == "2024-05-06T07:08:09Z"
        assert headers.get("WARC-Refers-To") == r.refers_to and headers["WARC-Block-Digest"] == r.block_digest == warc.digest(block)
        assert "Evil" not in headers and (r.refers_to in ids if r.refers_to else r.record_type == "response")
    first = {r.record_type: r for r in got if r.page_id == 1}
    assert first["metadata"].refers_to == first["conversion"].refers_to and first["metadata"].record_id != first["conversion"].record_id
    _, payload = warc.http_block(PAGE)
    assert first["conversion"].payload_digest == warc.digest(payload)
    fields = first["metadata"].block.split("\r\n")
    assert {"title: A & B", "language: de-at", "outlink: /x?a=1&b=2", "outlink: y", f"source-WARC-Record-ID: {first['metadata'].refers_to}", f"source-WARC-Payload-Digest: {warc.digest(payload)}", "source-WARC-Date: 2024-05-06T07:08:09Z", f"source-http-Content-Length: {len(payload)}"} <= set(fields)
    assert not any(x.startswith("digest-check") for x in fields)
    assert {r.block for r in got if r.page_id == 2 and r.record_type == "conversion"} == {""}
    assert warc.derive(warc.responses(df.limit(0))).count() == 0
    both = b"".join(warc.record_bytes(r.headers, r.block) for r in got)
    assert len(warc.parse(both)) == 12
    with pytest.raises(ValueError):
        warc.parse(both[:-6])


def test_foreign_records_keep_their_headers(spark):
    """A response that another crawler wrote, one whose payload was changed, and a record of another type."""
    block = b"HTTP/1.1 404 Not Found\r\nServer: old one\r\nContent-Type: text/html\r\n\r\n<p>gone \xff"
    lines = ["WARC/1.1", "WARC-Type: response", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2001-02-03T04:05:06Z", "WARC-Target-URI: http://y.example/", "WARC-IP-Address: 192.0.2.7", f"Content-Length: {len(block)}"]
    head = "".join(x + "\r\n" for x in lines)
    whole = warc.record_bytes(head, block)
    bad = warc.record_bytes(head.replace("uuid:1", "uuid:2") + "WARC-Payload-Digest: sha1:AAAA\r\n", block)
    other = whole.replace(b"WARC-Type: response", b"WARC-Type: request")
    df = spark.createDataFrame([(1, bytearray(whole + bad)), (2, bytearray(other)), (3, None)], "page_id long, record binary")
    got = warc.derive(df).collect()
    meta = {r.refers_to: r.block.split("\r\n") for r in got if r.record_type == "metadata"}
    assert len(got) == 6 and set(meta) == {"<urn:uuid:1>", "<urn:uuid:2>"}
    assert {"source-WARC-IP-Address: 192.0.2.7", "source-http-Server: old one"} <= set(meta["<urn:uuid:1>"])
    assert "digest-check: failed" in meta["<urn:uuid:2>"] and "digest-check: failed" not in meta["<urn:uuid:1>"]
    assert {r.block for r in got if r.record_type == "conversion"} == {"gone \ufffd"}
