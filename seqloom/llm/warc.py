"""WARC derivatives: metadata and plain-text conversion records.

For each response record two records are built and linked: ``metadata``
(application/warc-fields: digests, sizes, title, language and the source's HTTP
headers) and ``conversion`` (text/plain). Both carry WARC-Refers-To with the
response's id, its target URI and date; they name each other by
WARC-Concurrent-To. Records can be written as gzip members, one per record, in
files of ``warc`` format 1.1, with an index for random reads, and read back.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import create_file, fresh_path, open_file

RECORD_FIELDS = (
    "record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, "
    "warc_date string, content_type string, source_headers string, source_digest string, "
    "block_digest string, content_length long, block string"
)
# Elements that end a line, and elements without text inside.
_LINES = frozenset(
    "address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split()
)
_SILENT = ("script", "style", "noscript", "template")
_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_STOP = re.compile(r">|=\s*[\"']")
_COMMENT_END = re.compile(r"--!?>")
_CLOSING = {name: re.compile(rf"(?i)</{name}(?=[\s/>])") for name in (*_SILENT, "svg")}
_TITLE_END = re.compile(r"(?i)</title\s*>")
_LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([A-Za-z0-9-]+)")
_LONG_NUMBER = re.compile(r"&#0*([0-9]+)")


def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _unescape(text: str) -> str:
    """Character references resolved; a decimal one of any length is at most a wrong character."""
    return html.unescape(_LONG_NUMBER.sub(lambda m: "&#" + m[1][:8], text))


class _Scanner:
    """Reads markup once from left to right; time is linear in the page.

    A tag is ``<`` or ``</`` and a letter, and ends at its first ``>`` outside
    quoted values; a bare ``<`` is text. Where such an end is missing up to the
    end of the page, quotes no longer count from there on, and a tag without
    any ``>`` behind it is text. Comments and the elements of ``_SILENT`` have
    no text; left open they reach to the end. An ``svg`` without an end is
    skipped as a tag only.
    """

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.last_end = page.rfind(">")
        self.last_quote = {q: page.rfind(q) for q in "\"'"}
        self.quotes = True
        self.open_svg = False  # no further svg has an end
        self.title: str | None = None
        self.lang = ""

    def _tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose attributes begin at ``at``, or -1."""
        if at > self.last_end:
            return -1
        k = at
        while self.quotes:
            m = _STOP.search(self.page, k)
            if m is None:
                self.quotes = False
                break
            if m[0] == ">":
                return m.start()
            quote = m[0][-1]
            k = m.end()
            if k <= self.last_quote[quote]:
                k = self.page.find(quote, k) + 1
        return self.page.find(">", at)

    def text(self) -> str:
        page, out, done, at = self.page, [], 0, 0
        while True:
            lt = page.find("<", at)
            if lt < 0:
                break
            at, instead = self._markup(lt)
            if instead is not None:
                out += (page[done:lt], instead)
                done = at
        out.append(page[done:])
        return "".join(out)

    def _markup(self, lt: int) -> tuple[int, str | None]:
        """Where to go on behind the ``<`` at ``lt``, and what stands for the markup (None: it is text)."""
        page = self.page
        if page.startswith("<!--", lt):
            if page.startswith((">", "->"), lt + 4):
                return page.index(">", lt) + 1, " "
            m = _COMMENT_END.search(page, lt + 4)
            return (m.end() if m else self.size), " "
        m = _NAME.match(page, lt + 1)
        if m is None:
            if page[lt + 1 : lt + 2] in ("/", "!", "?") and lt < self.last_end:
                return page.find(">", lt) + 1, ""
            return lt + 1, None
        end = self._tag_end(m.end())
        if end < 0:
            return lt + 1 if lt < self.last_end else self.size, None
        name, opens = m[1].lower(), page[lt + 1] != "/"
        if opens and name in _SILENT:
            close = _CLOSING[name].search(page, end + 1)
            shut = page.find(">", close.end()) if close else -1
            return (shut + 1 if shut >= 0 else self.size), " "
        if opens and name == "svg" and page[end - 1] != "/" and not self.open_svg:
            close = _CLOSING["svg"].search(page, end + 1)
            shut = page.find(">", close.end()) if close else -1
            if shut >= 0:
                return shut + 1, " "
            self.open_svg = True
        if opens and name == "title" and self.title is None:
            close = _TITLE_END.search(page, end + 1)
            self.title = " ".join(_unescape(page[end + 1 : close.start()]).split()) if close else ""
        if opens and name == "html" and not self.lang:
            found = _LANG.search(page, m.end(), end)
            self.lang = found[1].lower() if found else ""
        return end + 1, "\n" if name in _LINES else " " if name == "svg" else ""


def read_page(page: str) -> tuple[str, str, str]:
    """``(text, title, language)`` of a page.

    The text has one line per block element, white space folded. The title is
    the first one's text up to its end tag, the language the first ``html``
    tag's; empty where there is none.
    """
    scanner = _Scanner(page)
    lines = (" ".join(line.split()) for line in _unescape(scanner.text()).split("\n"))
    return "\n".join(line for line in lines if line), scanner.title or "", scanner.lang


def plain_text(page: str) -> str:
    """Visible text of a page (see ``read_page``)."""
    return read_page(page)[0]


def derived_id(source_id: str, kind: str) -> str:
    """A stable id, so that a repeated build gives the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source_id} {kind}')}>"


def derive(record_id: str, uri: str, date: str, headers: str, payload: str) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    meta_id, conv_id = derived_id(record_id, "metadata"), derived_id(record_id, "conversion")
    source = sha1_digest(payload.encode())
    text, title, lang = read_page(payload)
    fields = [
        ("payload-digest", source),
        ("payload-length", len(payload.encode())),
        ("text-digest", sha1_digest(text.encode())),
        ("text-length", len(text.encode())),
        ("title", " ".join(title.split())),
        ("language", " ".join(lang.split())),
        *(("source-header", h) for h in headers.split("\r\n") if h),
    ]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return [
        (kind, own, record_id, other, uri, date, ctype, headers, source, sha1_digest(block.encode()), len(block.encode()), block)
        for kind, own, other, ctype, block in (
            ("metadata", meta_id, conv_id, "application/warc-fields", meta),
            ("conversion", conv_id, meta_id, "text/plain; charset=utf-8", text),
        )
    ]


def responses_from_pages(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a crawl table: id, URI, date, HTTP headers, payload.

    The record id is a UUID in the shape of the MD5 of id, payload digest and
    url, so pages that share id and url but not their contents have records of
    their own; null url and html count as empty.
    """
    page = F.md5(F.coalesce(F.col(html_col), F.lit("")).cast("binary"))
    h = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), page, F.coalesce(url_col, F.lit(""))).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    payload = F.coalesce(F.col(html_col), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n"))
    return pages.select(
        F.col(id_col).alias("source_key"),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.coalesce(url_col, F.lit("")).alias("target_uri"),
        F.lit(date).alias("warc_date"),
        head.alias("headers"),
        payload.alias("payload"),
    )


def build_derivatives(responses: DataFrame) -> DataFrame:
    """Two rows per response: ``source_key`` and the fields of the records.

    Needs ``source_key, record_id, target_uri, warc_date, headers, payload``;
    nulls in them count as empty, extra columns are not read. A response
    without text gets an empty conversion; repeated rows give repeated records
    with the same ids. An empty table gives none; pages may be of any length and
    are read in linear time. A narrow map.
    """
    key = responses.schema["source_key"].dataType.simpleString()
    slim = responses.select(
        "source_key", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("record_id", "target_uri", "warc_date", "headers", "payload")]
    )
    names = ["source_key", *(f.split()[0] for f in RECORD_FIELDS.split(", "))]
    kinds = [pa.string()] * 10 + [pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [r for args in zip(*(part.column(j).to_pylist() for j in range(1, 6)), strict=True) for r in derive(*args)]
                owner = pa.array([k for k in range(part.num_rows) for _ in range(2)], pa.int64())
                columns = zip(*rows, strict=True) if rows else [[]] * 12
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(owner), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names
                )

    return slim.mapInArrow(run, f"source_key {key}, {RECORD_FIELDS}")


_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _line(name: str, value: str) -> str:
    """A header line; line breaks and other control characters can't stand in it."""
    if re.search(r"[\x00-\x08\x0a-\x1f\x7f]", value):
        raise ValueError(f"{name} holds control characters: {value[:80]!r}")
    return f"{name}: {value}\r\n" if value else ""


def _uri_lines(uri: str) -> str:
    """The target URI, percent-encoded where it holds white space or control characters, and then its exact form as well."""
    safe = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", uri)
    return _line("WARC-Target-URI", safe) + (_line("X-Exact-Target-URI", json.dumps(uri)) if safe != uri else "")


def _record(lines: str, block: bytes) -> bytes:
    return b"WARC/1.1\r\n" + lines.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def serialise(record: dict) -> bytes:
    """One record in WARC/1.1 form.

    URIs may hold any characters (see ``_uri_lines``); control characters in
    other header values raise, so no value can add a header of its own.
    """
    lines = [
        _line("WARC-Type", record["record_type"]),
        _line("WARC-Record-ID", record["record_id"]),
        _line("WARC-Date", record["warc_date"]),
        _uri_lines(record["target_uri"]),
        _line("WARC-Refers-To", record["refers_to"]),
        _line("WARC-Concurrent-To", record["concurrent_to"]),
        _line("WARC-Block-Digest", record["block_digest"]),
        _line("WARC-Source-Payload-Digest", record["source_digest"]),
        _line("WARC-Source-Headers", json.dumps(record["source_headers"])),
        _line("Content-Type", record["content_type"]),
    ]
    return _record("".join(lines), record["block"].encode())


def _next_record(src) -> tuple[dict[str, str], bytes] | None:
    """Headers (names as written) and block of the next record of a stream; none at its end."""
    while (line := src.readline()) in (b"\r\n", b"\n"):
        pass
    if not line:
        return None
    if not re.fullmatch(rb"WARC/1\.[01]\r?\n", line):
        raise ValueError(f"no WARC record: {line[:40]!r}")
    head: dict[str, str] = {}
    while (line := src.readline()) not in (b"\r\n", b"\n", b""):
        k, _, v = line.decode(errors="replace").rstrip("\r\n").partition(":")
        head[k] = v.strip(" \t")
    if not head.get("Content-Length", "").isdecimal():
        raise ValueError(f"a record without a length: {head.get('WARC-Record-ID', '')!r}")
    size = int(head["Content-Length"])
    block = src.read(size)
    if len(block) != size:
        raise ValueError(f"a record is cut short: {head.get('WARC-Record-ID', '')!r}")
    return head, block


def _uri(head: dict[str, str]) -> str:
    return json.loads(head["X-Exact-Target-URI"]) if "X-Exact-Target-URI" in head else head.get("WARC-Target-URI", "").strip("<>")


def parse(data: bytes) -> dict:
    """The record of :func:`serialise`, its block digest verified; raises where it is damaged."""
    found = _next_record(io.BytesIO(data))
    if found is None:
        raise ValueError("no WARC record")
    head, block = found
    if sha1_digest(block) != head.get("WARC-Block-Digest"):
        raise ValueError("a block does not match its digest")
    get = lambda k: head.get(k, "")
    return {
        "record_type": get("WARC-Type"),
        "record_id": get("WARC-Record-ID"),
        "refers_to": get("WARC-Refers-To"),
        "concurrent_to": get("WARC-Concurrent-To"),
        "target_uri": _uri(head),
        "warc_date": get("WARC-Date"),
        "content_type": get("Content-Type"),
        "source_headers": json.loads(get("WARC-Source-Headers") or '""'),
        "source_digest": get("WARC-Source-Payload-Digest"),
        "block_digest": get("WARC-Block-Digest"),
        "content_length": len(block),
        "block": block.decode(),
    }


def serialise_response(record_id: str, uri: str, date: str, headers: str, payload: str) -> bytes:
    """A response record: the HTTP head and body of a crawl in one block."""
    block = f"{headers}\r\n{payload}".encode()
    lines = [
        _line("WARC-Type", "response"),
        _line("WARC-Record-ID", record_id),
        _line("WARC-Date", date),
        _uri_lines(uri),
        _line("WARC-Block-Digest", sha1_digest(block)),
        _line("WARC-Payload-Digest", sha1_digest(payload.encode())),
        _line("Content-Type", "application/http; msgtype=response"),
    ]
    return _record("".join(lines), block)


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = int(body[at:end].split(b";")[0].strip() or b"0", 16)
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def http_parts(block: bytes) -> tuple[str, str]:
    """Head and decoded body of an HTTP response; chunks and gzip are undone, the charset is the header's or UTF-8."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = head.decode("latin-1") + "\r\n"
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (h.partition(":") for h in headers.split("\r\n")[1:])}
    if "chunked" in fields.get("transfer-encoding", ""):
        body = _dechunked(body)
    if fields.get("content-encoding") in ("gzip", "x-gzip"):
        body = zlib.decompress(body, 47)
    named = re.search(r"charset=[\"']?([\w.:-]+)", fields.get("content-type", ""))
    try:
        return headers, body.decode(named[1] if named else "utf-8", errors="replace")
    except LookupError:  # a charset nobody knows
        return headers, body.decode("utf-8", errors="replace")


RESPONSE_FIELDS = "source_key string, record_id string, target_uri string, warc_date string, headers string, payload string"


def read_responses(files: DataFrame, path_col: str = "path") -> DataFrame:
    """The response records of WARC files, plain or gzip, in the form ``build_derivatives`` takes.

    A file is read as a stream by one task, so memory follows the longest
    record, not the file. ``source_key`` is the file's path and the record's
    number in it. Records of other types are passed over; an HTTP body is
    decoded by its headers. A damaged record raises. Null paths and files
    without records give no rows; a path that is listed twice is read twice.
    """
    names = [f.split()[0] for f in RESPONSE_FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).drop_null().to_pylist():
                rows: list[tuple] = []
                held = no = 0
                with open_file(path) as raw:
                    packed = raw.read(2) == b"\x1f\x8b"
                    raw.seek(0)
                    src = gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw)
                    while (found := _next_record(src)) is not None:
                        head, block = found
                        if head.get("WARC-Type") == "response":
                            headers, payload = http_parts(block)
                            rows.append((f"{path}#{no}", head.get("WARC-Record-ID", ""), _uri(head), head.get("WARC-Date", ""), headers, payload))
                            held += len(block)
                        no += 1
                        if held > 1 << 24 or len(rows) == 512:
                            yield _responses(rows)
                            rows, held = [], 0
                    if rows:
                        yield _responses(rows)

    def _responses(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)

    return files.select(F.col(path_col).cast("string")).mapInArrow(run, RESPONSE_FIELDS)


INDEX_FIELDS = "file string, offset long, length long, record_id string"


def write_warc(records: DataFrame, path: str | None = None, level: int = 6) -> DataFrame:
    """Writes one ``.warc.gz`` per task; ``(source_key, file, offset, length, record_id)``.

    The returned index is a table below ``path``; files of tasks that did not
    finish are not in it. An empty table gives no file.
    """
    spark = records.sparkSession
    path = path or fresh_path(spark, "warc")
    names = [f.split()[0] for f in RECORD_FIELDS.split(", ")]
    schema = f"source_key {records.schema['source_key'].dataType.simpleString()}, {INDEX_FIELDS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{path}/data/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        at = 0
        with create_file(name) as out:
            batch = first
            while batch is not None:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    sizes = []
                    for record in part.select(names).to_pylist():
                        data = gzip.compress(serialise(record), level, mtime=0)
                        out.write(data)
                        sizes.append(len(data))
                    ends = at + np.cumsum(np.array(sizes, np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("source_key"), pa.array([name] * len(sizes), pa.string()), pa.array(ends - sizes), pa.array(sizes, pa.int64()), part.column("record_id")],
                        names=["source_key", "file", "offset", "length", "record_id"],
                    )
                    at = int(ends[-1])
                batch = next(batches, None)

    records.select("source_key", *names).mapInArrow(run, schema).write.parquet(f"{path}/index")
    return spark.read.schema(schema).parquet(f"{path}/index")


def read_warc(index: DataFrame) -> DataFrame:
    """``source_key`` and the records of any subset of index rows, their digests verified."""
    names = [f.split()[0] for f in RECORD_FIELDS.split(", ")]
    kinds = [pa.int64() if n == "content_length" else pa.string() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = part.select(["file", "offset", "length"]).to_pylist()
                found: list = [None] * len(rows)
                wanted: dict[str, list[int]] = {}
                for k, row in enumerate(rows):
                    wanted.setdefault(row["file"], []).append(k)
                for name, members in wanted.items():
                    with open_file(name) as src:
                        for k in sorted(members, key=lambda m: rows[m]["offset"]):
                            src.seek(rows[k]["offset"])
                            found[k] = parse(zlib.decompress(src.read(rows[k]["length"]), 31))
                yield pa.RecordBatch.from_arrays(
                    [part.column("source_key"), *(pa.array([r[n] for r in found], t) for n, t in zip(names, kinds, strict=True))], names=["source_key", *names]
                )

    key = index.schema["source_key"].dataType.simpleString()
    return index.select("source_key", "file", "offset", "length").mapInArrow(run, f"source_key {key}, {RECORD_FIELDS}")
