"""WARC derivatives: metadata and plain-text conversion records from response records.

``responses`` makes response records of pages, ``parse_warc`` and ``read_warc`` read them from WARC files, ``derive`` makes two records
of each response: a ``metadata`` record (source HTTP headers, source digests, title, language, outgoing links) and a ``conversion`` record (the page's plain text). Both
keep the response's identifier in WARC-Refers-To, its target URI and date, and link with each other through WARC-Concurrent-To.
Identifiers are UUIDs of names (version 5), so a job that is run again, or a task that is tried again, gives the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import task

EPOCH = "1970-01-01T00:00:00Z"
RECORD = pa.schema([("page_id", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()), ("payload_digest", pa.string()), ("source_payload_digest", pa.string()), ("source_headers", pa.string()), ("block", pa.binary())])
RECORD_SQL = "page_id long, warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, source_payload_digest string, source_headers string, block binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


# ---- plain text

_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")
_TAG_END = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_CLOSE = {n: re.compile(rf"</{n}\b", re.I) for n in ("script", "style", "noscript", "template", "svg", "textarea", "title")}
_SKIP = {"script", "style", "noscript", "template", "svg"}
_BLOCK = {*"address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()}
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z][A-Za-z0-9-]*)", re.I)
_SPACES = re.compile(r"[ \t\r\f\v\xa0]+")


def page_parts(source: str) -> tuple[str, str, str, list[str]]:
    """(plain text, title, language, links) of a page; one pass, in time linear in its length."""
    out, links, title, lang, pos, n, no_quotes = [], [], [], "", 0, len(source), False
    while pos < n:
        lt = source.find("<", pos)
        if lt < 0:
            out.append(source[pos:])
            break
        out.append(source[pos:lt])
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            if end < 0:  # a comment that never ends holds the rest
                break
            pos = end + 3
            continue
        m = _NAME.match(source, lt + 1)
        if not m:
            if source.startswith(("<!", "<?", "</"), lt):  # declarations and bogus comments
                end = source.find(">", lt)
                if end < 0:
                    break
                pos = end + 1
            else:
                out.append("<")
                pos = lt + 1
            continue
        end = None if no_quotes else _TAG_END.match(source, m.end())
        if end is None:
            gt = source.find(">", m.end())
            if gt < 0:
                break
            no_quotes = no_quotes or "\"" not in source[gt:] and "'" not in source[gt:]
            stop = gt + 1
        else:
            stop = end.end()
        name, closing = m[1].lower(), source[lt + 1] == "/"
        if name in _BLOCK:
            out.append("\n")
        if not closing:
            if name == "a" and (h := _HREF.search(source, m.end(), stop)):
                links.append(html.unescape(next(x for x in h.groups() if x is not None)).strip())
            elif name == "html" and not lang and (g := _LANG.search(source, m.end(), stop)):
                lang = g[1]
            if name in _CLOSE:
                close = _CLOSE[name].search(source, stop)
                inner = source[stop : close.start() if close else n]
                if name == "title":
                    title.append(inner)
                elif name not in _SKIP:
                    out.append(inner)
                gt = source.find(">", close.end()) if close else -1
                if gt < 0:
                    break
                if name in _BLOCK:
                    out.append("\n")
                stop = gt + 1
        pos = stop
    lines = (_SPACES.sub(" ", x).strip() for x in html.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), " ".join(html.unescape(" ".join(title)).split()), lang, links


# ---- records


def _response(page: int | None, url: str, body: bytes, date: str) -> dict:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = head + body
    return dict(page_id=page, warc_type="response", record_id=record_id("response", page, url, digest(body)), refers_to=None, concurrent_to=None, target_uri=url, warc_date=date, content_type="application/http; msgtype=response", content_length=len(block), block_digest=digest(block), payload_digest=digest(body), source_payload_digest=None, source_headers=None, block=block)


def split_http(block: bytes) -> tuple[str, bytes]:
    """(header lines, body) of an HTTP response; without a blank line all is body."""
    for sep in (b"\r\n\r\n", b"\n\n"):
        head, found, body = block.partition(sep)
        if found and head[:5].upper() == b"HTTP/":
            return head.decode("latin-1").replace("\r\n", "\n"), body
    return "", block


def _header(headers: str, name: str) -> str:
    m = re.search(rf"(?im)^{name}[ \t]*:[ \t]*(.*)$", headers)
    return m[1].strip().lower() if m else ""


def _dechunked(body: bytes) -> bytes:
    """A chunked body put together; what doesn't look like chunks, or is cut off, stays from there on as it is."""
    out, pos = [], 0
    while pos < len(body):
        end = body.find(b"\r\n", pos)
        size = body[pos : end if end >= 0 else pos].split(b";")[0].strip()
        if not size or len(size) > 12 or not all(c in b"0123456789abcdefABCDEF" for c in size):
            return b"".join(out) + body[pos:] if out or pos else body
        n = int(size, 16)
        if n == 0:
            break
        out.append(body[end + 2 : end + 2 + n])
        pos = end + 2 + n + 2
    return b"".join(out)


def entity(headers: str, body: bytes) -> bytes:
    """The document of a response: transfer coding (chunked), then content codings (gzip, deflate) undone, the last one first. Crawlers often store bodies that are decoded
    already under the old headers, so a body that isn't coded as its header says stays as it is; of a truncated one what can be decoded counts."""
    if "chunked" in _header(headers, "transfer-encoding"):
        body = _dechunked(body)
    for coding in reversed([c.strip() for c in _header(headers, "content-encoding").split(",")]):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
            try:
                plain = zlib.decompressobj(bits).decompress(body)
            except zlib.error:
                continue
            if plain or not body:
                body = plain
                break
    return body


def _charset(headers: str) -> str:
    m = re.search(r"(?im)^content-type:.*?charset=\"?([\w.:-]+)", headers)
    return m[1] if m else "utf-8"


def derivatives(r: dict) -> list[dict]:
    """The metadata and the conversion record of a response."""
    headers, body = split_http(r["block"])
    document = entity(headers, body)
    try:
        source = document.decode(_charset(headers), "replace")
    except LookupError:
        source = document.decode("utf-8", "replace")
    text, title, lang, links = page_parts(source)
    payload = r["payload_digest"] or digest(body)
    meta_id, conv_id = record_id("metadata", r["record_id"]), record_id("conversion", r["record_id"])
    clean = lambda s: " ".join(s.split())
    fields = [("source-record-id", r["record_id"]), ("source-block-digest", r["block_digest"] or digest(r["block"])), ("source-payload-digest", payload)]
    fields += [("http-status", headers.split("\n")[0])] if headers else []
    fields += [("http-header", clean(h)) for h in headers.split("\n")[1:] if h.strip()]
    fields += [("title", title)] * bool(title) + [("language", lang)] * bool(lang)
    for link in links:
        try:
            fields.append(("outlink", clean(urljoin(r["target_uri"] or "", link))))
        except ValueError:
            fields.append(("outlink", clean(link)))
    meta, plain = "".join(f"{k}: {clean(v)}\r\n" for k, v in fields).encode("utf-8", "replace"), text.encode("utf-8", "replace")
    shared = dict(page_id=r["page_id"], refers_to=r["record_id"], target_uri=r["target_uri"], warc_date=r["warc_date"], source_payload_digest=payload, source_headers=headers)
    return [
        dict(shared, warc_type="metadata", record_id=meta_id, concurrent_to=conv_id, content_type="application/warc-fields", content_length=len(meta), block_digest=digest(meta), payload_digest=digest(meta), block=meta),
        dict(shared, warc_type="conversion", record_id=conv_id, concurrent_to=meta_id, content_type="text/plain; charset=utf-8", content_length=len(plain), block_digest=digest(plain), payload_digest=digest(plain), block=plain),
    ]


_HEADERS = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "warc_date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]


def serialise(r: dict) -> bytes:
    """A record as WARC/1.1. Line ends can't occur in header values: they become spaces."""
    head = "".join(f"{h}: {' '.join(str(r[k]).split())}\r\n" for h, k in _HEADERS if r.get(k) is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + r["block"] + b"\r\n\r\n"


class _Bytes:
    """The bytes of a WARC file from ``pos`` on, decompressed member by member as far as they are asked for."""

    def __init__(self, data: bytes, step: int = 1 << 20) -> None:
        self.data, self.step, self.at = memoryview(data), step, 0
        self.packed = data[:2] == b"\x1f\x8b"
        self.plain, self.open = (bytearray(), None) if self.packed else (bytearray(data), None)
        self.gone = 0  # bytes that were given up already

    def more(self) -> bool:
        """Decompress a further step; false at the end."""
        if not self.packed or (self.at >= len(self.data) and self.open is None):
            return False
        if self.open is None:
            if self.data[self.at : self.at + 2] != b"\x1f\x8b":
                raise ValueError(f"no gzip member at byte {self.at}")
            self.open = zlib.decompressobj(31)
        part = self.data[self.at : self.at + self.step]
        if not len(part):
            raise ValueError("the last gzip member is cut off")
        self.plain += self.open.decompress(part)
        self.at += len(part) - len(self.open.unused_data)
        if self.open.eof:
            self.open = None
        return True

    def find(self, what: bytes) -> int:
        from_ = 0
        while (at := self.plain.find(what, from_)) < 0:
            from_ = max(0, len(self.plain) - len(what))
            if not self.more():
                return -1
        return at

    def need(self, n: int) -> bool:
        while len(self.plain) < n:
            if not self.more():
                return False
        return True

    def drop(self, n: int) -> None:
        del self.plain[:n]
        self.gone += n


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or compressed by record, one at a time; what follows a broken record is given up with an error."""
    source, names = _Bytes(data), {h.lower(): k for h, k in _HEADERS}
    while True:
        while source.need(2) and source.plain[:2] == b"\r\n":
            source.drop(2)
        if not source.need(1):
            return
        start = source.need(5) and source.plain.startswith(b"WARC/")
        end = source.find(b"\r\n\r\n") if start else -1
        if end < 0:
            raise ValueError(f"no WARC record at byte {source.gone}")
        r: dict = dict.fromkeys(RECORD.names)
        for line in bytes(source.plain[:end]).decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            if k.strip().lower() in names:
                r[names[k.strip().lower()]] = v.strip()
        r["content_length"] = int(r["content_length"] or 0)
        if not source.need(end + 4 + r["content_length"]):
            raise ValueError(f"the record at byte {source.gone} is cut off")
        r["block"] = bytes(source.plain[end + 4 : end + 4 + r["content_length"]])
        source.drop(end + 4 + r["content_length"])
        yield r


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in RECORD], schema=RECORD)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = EPOCH) -> DataFrame:
    """A response record for each page. Null HTML is an empty body; a null URL is an empty target. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([_response(p, u or "", (h or "").encode("utf-8", "surrogatepass"), date) for p, u, h in zip(*(c.to_pylist() for c in b.columns))])

    return pages.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string")).mapInArrow(task(run), RECORD_SQL)


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records; records of other types have none.

    Repeated responses give repeated records with the same identifiers. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                yield _batch([d for r in b.slice(lo, 512).to_pylist() for d in derivatives(r)])

    return records.filter("warc_type = 'response'").select(*RECORD.names).mapInArrow(task(run), RECORD_SQL)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (``*.warc``, ``*.warc.gz``); a file is read by one task, so keep files at the customary size of about 1 GB or less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows: list[dict] = []
                for r in parse_warc(content.as_py()):
                    rows.append(r)
                    if len(rows) == 512:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(task(run), RECORD_SQL)


def write_warc(records: DataFrame, folder: str, compress: bool = True) -> DataFrame:
    """Write one file for each partition into ``folder``, which all workers share: a path or the URI of a file system that Arrow knows (hdfs, s3, gs, file); returns (file, records, bytes).

    Files are written under another name and then renamed, so a task that is tried again replaces its file and a reader sees whole files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        name = f"{base}/part-{ctx.partitionId():06d}.warc" + ".gz" * compress
        tmp, n, size = f"{name}.{ctx.taskAttemptId()}.tmp", 0, 0
        store.create_dir(base, recursive=True)
        with store.open_output_stream(tmp) as f:
            for b in batches:
                for r in b.to_pylist():
                    raw = serialise(r)
                    raw = gzip.compress(raw, mtime=0) if compress else raw
                    f.write(raw)
                    n, size = n + 1, size + len(raw)
        store.move(tmp, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], names=["file", "records", "bytes"])

    return records.select(*RECORD.names).mapInArrow(task(run), "file string, records long, bytes long")
