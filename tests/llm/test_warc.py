"""WARC derivatives against a plain derivation with the standard library's parser."""

import base64
import gzip
import hashlib
import uuid
import zlib
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest

from framewright.llm import warc

BLOCK = set(warc._BLOCK)


class Plain(HTMLParser):
    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.titles, self.lang, self.skip, self.in_title = [], [], [], "", 0, False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.text.append("\n")
        for k, v in attrs:
            if tag == "a" and k == "href" and v is not None:
                self.links.append(v.strip())
            if tag == "html" and k == "lang" and not self.lang:
                self.lang = v
        self.skip += tag in warc._SKIP
        self.in_title = self.in_title or tag == "title"

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.text.append("\n")
        self.skip -= tag in warc._SKIP
        self.in_title = self.in_title and tag != "title"

    def handle_data(self, data):
        if self.in_title:
            self.titles.append(data)
        elif not self.skip:
            self.text.append(data)

    def lines(self):
        return "\n".join(x for x in (" ".join(x.replace("\xa0", " ").split()) for x in "".join(self.text).split("\n")) if x)


def sha1(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_derivatives_equal_a_plain_derivation(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r for r in pages.collect()}
    rows = {(r.page_id, r.warc_type): r for r in warc.derive(warc.responses(pages)).collect()}
    assert len(rows) == 2 * len(source)
    for k, page in source.items():
        body = (page.html or "").encode()
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        plain, meta, conv = Plain(page.html or ""), rows[k, "metadata"], rows[k, "conversion"]
        response = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(['response', str(k), page.url or '', sha1(body)]))}>"
        assert meta.refers_to == conv.refers_to == response
        assert meta.concurrent_to == conv.record_id and conv.concurrent_to == meta.record_id
        assert bytes(conv.block).decode() == plain.lines(), k
        fields = [f"source-record-id: {response}", f"source-block-digest: {sha1(head + body)}", f"source-payload-digest: {sha1(body)}", "http-status: HTTP/1.1 200 OK", "http-header: Content-Type: text/html; charset=utf-8", f"http-header: Content-Length: {len(body)}"]
        title = " ".join(" ".join(plain.titles).split())
        fields += [f"title: {title}"] * bool(title) + [f"language: {plain.lang}"] * bool(plain.lang) + [f"outlink: {urljoin(page.url or '', x)}" for x in plain.links]
        assert bytes(meta.block).decode().split("\r\n")[:-1] == fields
        for r in (meta, conv):
            assert (r.target_uri, r.content_length, r.block_digest) == (page.url or "", len(r.block), sha1(bytes(r.block)))
            assert r.source_payload_digest == sha1(body)


def chunked(body, size=7):
    return b"".join(b"%x;x=1\r\n%s\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)) + b"0\r\n\r\n"


@pytest.mark.parametrize("coding, pack", [("", lambda b: b), ("gzip", gzip.compress), ("deflate", zlib.compress), ("deflate", lambda b: zlib.compress(b)[2:-4]), ("deflate, gzip", lambda b: gzip.compress(zlib.compress(b)))])
@pytest.mark.parametrize("transfer", [False, True])
def test_coded_bodies(coding, pack, transfer):
    page = "<p>çoded " + "words of a page " * 50 + "</p>"
    body = pack(page.encode())
    if transfer:
        body = chunked(body)
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Encoding: {coding}\r\n" * bool(coding) + "Transfer-Encoding: chunked\r\n" * transfer
    block = head.encode() + b"\r\n" + body
    r = dict.fromkeys(warc.RECORD.names) | {"block": block, "record_id": "<r>", "target_uri": "http://a.example/"}
    meta, conv = warc.derivatives(r)
    assert conv["block"].decode() == ("çoded " + "words of a page " * 50).strip()
    # Digests name the stored payload, not the decoded one.
    assert meta["source_payload_digest"] == sha1(body)


def test_bodies_that_are_not_coded_as_their_headers_say():
    head = "HTTP/1.1 200 OK\nContent-Encoding: gzip\nTransfer-Encoding: chunked"
    assert warc.entity(head, b"<p>plain</p>") == b"<p>plain</p>"
    half = gzip.compress(b"words and words " * 4000)[:60]
    assert b"words and words ".startswith(warc.entity(head, half)[:16])
    assert warc.entity(head, b"") == b""


@pytest.mark.parametrize("packed", [False, True])
def test_files_are_read_record_by_record(packed, monkeypatch):
    rows = [dict.fromkeys(warc.RECORD.names) | {"warc_type": "response", "record_id": f"<{i}>", "content_length": 50 * i, "block": bytes([i]) * (50 * i)} for i in range(40)]
    raw = b"".join(gzip.compress(warc.serialise(r)) if packed else warc.serialise(r) for r in rows)
    for step in (1, 13, 1 << 20):
        monkeypatch.setattr(warc._Bytes.__init__, "__defaults__", (step,))
        assert [(r["record_id"], r["block"]) for r in warc.parse_warc(raw)] == [(r["record_id"], r["block"]) for r in rows]
    with pytest.raises(ValueError):
        list(warc.parse_warc(raw[:-30]))
