"""WARC derivatives: responses to linked metadata and plain-text conversion records.

A record is a row: type, id, target, date, the record it refers to, content
type, digests, further headers and the block's bytes.  ``encode`` gives each
record as a gzip member, so any order of members put one behind the other is a
WARC file; ``read_warc`` reads such files, plain or compressed.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import io
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "warc_type string, record_id string, target_uri string, date string, refers_to string, refers_to_target_uri string, refers_to_date string, content_type string, block_digest string, payload_digest string, headers map<string,string>, block binary"
_COLUMNS = [part.strip().split(" ")[0] for part in re.split(r", (?![^<]*>)", RECORD)]
_ARROW = pa.schema([(c, pa.map_(pa.string(), pa.string()) if c == "headers" else pa.binary() if c == "block" else pa.string()) for c in _COLUMNS])

#: Elements whose content is no text, and elements that start a new line: fixed values.
_SKIP = "head|script|style|noscript|template|svg|title"
_LINES = frozenset("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_TOKENS = re.compile(rf"<!--.*?(?:-->|\Z)|<({_SKIP})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|</?([a-zA-Z][a-zA-Z0-9:-]*)[^<>]*>?", re.S | re.I)
_HREF = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
#: Codecs of the language itself that no page means: fixed values.
_NO_CHARSETS = frozenset("punycode idna undefined unicode_escape unicode-escape raw_unicode_escape raw-unicode-escape mbcs oem".split())
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def name_of(*parts: object) -> str:
    """A record id that depends on nothing but the parts."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def plain_text(page: str) -> str:
    """The readable text of a page, a line per block element."""
    text = _TOKENS.sub(lambda m: "\n" if m[2] and m[2].lower() in _LINES else (" " if m[1] or not m[2] else ""), page)
    lines = (" ".join(line.split()) for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def payload_of(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Header fields, in their order and as often as they stand there, and body of an HTTP response as sent."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return [], block
    fields = []
    for line in head.decode("latin-1").split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if colon:
            fields.append((key.strip().lower(), value.strip()))
        elif fields and line[:1] in " \t":  # a folded line goes on
            fields[-1] = fields[-1][0], f"{fields[-1][1]} {line.strip()}".strip()
    return fields, body


def _unchunked(body: bytes) -> bytes:
    """A chunked body put together; one that is not chunked, as crawlers often store it, as it is."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0].strip() or b"-", 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return b"".join(parts) if parts else body
        if size == 0:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def _inflated(body: bytes, coding: str) -> bytes:
    """A compressed body read as far as it goes; one that is not compressed as it is."""
    kinds = {"gzip": [31], "x-gzip": [31], "deflate": [15, -15]}.get(coding, [])
    for window in kinds:
        reader, out = zlib.decompressobj(window), b""
        try:
            for a in range(0, len(body), 1 << 16):
                out += reader.decompress(body[a : a + (1 << 16)])
        except zlib.error:
            if not out:
                continue
        return out
    return body


def content_of(fields: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without transfer and content codings; an unknown coding stays."""
    for name in ("transfer-encoding", "content-encoding"):
        for coding in reversed([c.strip().lower() for k, v in fields if k == name for c in v.split(",")]):
            body = _unchunked(body) if coding == "chunked" else _inflated(body, coding)
    return body


def decoded(fields: list[tuple[str, str]], body: bytes) -> tuple[str, str]:
    """The character set that was used, and the text: UTF-8 where the declared one is unknown or is none for texts."""
    kind = next((v for k, v in fields if k == "content-type"), "")
    found = _CHARSET.search(kind.encode()) or _CHARSET.search(body[:2048])
    name = found[1].decode().lower() if found else "utf-8"
    try:
        if codecs.lookup(name).name in _NO_CHARSETS:
            raise LookupError(name)
        text = body.decode(name, "replace")
        text.encode("utf-8")
        return name, text
    except (LookupError, ValueError):
        return "utf-8", body.decode("utf-8", "replace")


def derivatives(record: dict) -> list[dict]:
    """The metadata and the conversion record of a response record."""
    fields, body = payload_of(record["block"] or b"")
    charset, page = decoded(fields, content_of(fields, body))
    title = _TITLE.search(page)
    lang = _LANG.search(page)
    links = [html.unescape(next(g for g in m if g) if any(m) else "") for m in _HREF.findall(page)]
    lines = [("charset", charset)]
    if title:
        lines.append(("title", " ".join(html.unescape(title[1]).split())))
    if lang:
        lines.append(("language", lang[1]))
    # the source's own headers are kept under its names
    lines += [(f"http-{k}", v) for k, v in fields]
    lines += [("source-payload-digest", record["payload_digest"] or ""), ("source-block-digest", record["block_digest"] or "")]
    lines += [("outlink", x) for x in links]
    shared = {
        "target_uri": record["target_uri"],
        "date": record["date"],
        "refers_to": record["record_id"],
        "refers_to_target_uri": record["target_uri"],
        "refers_to_date": record["date"],
        "payload_digest": None,
    }
    meta = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in lines).encode()
    text = plain_text(page).encode()
    own = dict(record["headers"] or {})
    return [
        {**shared, "warc_type": "metadata", "record_id": name_of("metadata", record["record_id"]), "content_type": "application/warc-fields", "block_digest": digest(meta), "headers": own, "block": meta},
        {**shared, "warc_type": "conversion", "record_id": name_of("conversion", record["record_id"]), "content_type": "text/plain; charset=utf-8", "block_digest": digest(text), "headers": own | {"WARC-Source-Payload-Digest": record["payload_digest"] or ""}, "block": text},
    ]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([list(r[c].items()) if c == "headers" else r[c] for r in rows], type=_ARROW.field(c).type) for c in _COLUMNS], schema=_ARROW)


def _respond(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = []
                for page, url, text in zip(*(c.to_pylist() for c in batch.slice(a, 256).columns)):
                    body = (text or "").encode()
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                    rows.append({"warc_type": "response", "record_id": name_of("response", page, url, date, digest(body)), "target_uri": url, "date": date, "refers_to": None, "refers_to_target_uri": None, "refers_to_date": None, "content_type": "application/http; msgtype=response", "block_digest": digest(block), "payload_digest": digest(body), "headers": {"WARC-Page-Id": str(page)}, "block": block})
                yield _batch(rows)

    return run


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of fetched pages; a null page is an empty body, a null address has no target.

    A record's id depends on page id, address, date and content, so two
    captures of one address have two ids and equal rows have one.  An empty
    table gives an empty one; further columns are left, whatever their names.
    """
    return pages.select(F.col(id_col).cast("string"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(_respond(date), RECORD)


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            rows = [{**r, "headers": dict(r["headers"] or ())} for r in batch.slice(a, 256).to_pylist()]
            out = [d for r in rows for d in derivatives(r)]
            if out:
                yield _batch(out)


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response among ``records``; other types are passed by.

    Both name the response in ``refers_to`` and keep its target, date, HTTP
    headers and digests.  Chunks and compression of the body are undone, an
    unknown or unfit character set is read as UTF-8, and bytes that do not
    decode become replacement characters.  Repeated responses give repeated
    derivatives with equal ids; an empty table gives an empty one, and further
    columns are left.  A body is held whole, some copies of it at a time: it
    is one cell of the table.
    """
    return records.filter("warc_type = 'response'").select(*_COLUMNS).mapInArrow(_derive, RECORD)


_NAMES = {
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To",
    "refers_to_target_uri": "WARC-Refers-To-Target-URI", "refers_to_date": "WARC-Refers-To-Date", "content_type": "Content-Type", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest",
}


def to_bytes(record: dict) -> bytes:
    """A record in the file format, not compressed."""
    block = record["block"] or b""
    head = [f"{name}: {record[c]}" for c, name in _NAMES.items() if record[c] is not None]
    head += [f"{k}: {v}" for k, v in (record["headers"] or {}).items()]
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


_BACK = {name.lower(): c for c, name in _NAMES.items()}


def _head(lines: list[bytes]) -> tuple[dict, int]:
    """A record without its block, and the block's size; header bytes that are no UTF-8 are read as Latin-1."""
    record = dict.fromkeys(_COLUMNS) | {"headers": {}}
    size = 0
    for raw in lines:
        try:
            line = raw.decode()
        except UnicodeDecodeError:
            line = raw.decode("latin-1")
        key, _, value = line.partition(":")
        key, value = key.strip(), value.strip()
        if key.lower() == "content-length":
            size = int(value) if value.isdecimal() else 0
        elif key.lower() in _BACK:
            record[_BACK[key.lower()]] = value
        elif key:  # a repeated field keeps all its values
            before = record["headers"].get(key)
            record["headers"][key] = value if before is None else f"{before}, {value}"
    return record, size


def records_of(stream: io.BufferedReader) -> Iterator[dict]:
    """Records of a stream of a file's bytes, by their lengths, whichever line ends their headers have.

    What lies between records and begins none is given as a row of type
    ``unreadable`` with these bytes, and a record that the file breaks off
    keeps what is there with a field ``WARC-Truncated``.
    """
    junk = b""
    while True:
        line = stream.readline(_MOST_JUNK)
        begins = line.startswith(b"WARC/")
        if junk and (begins or not line or len(junk) >= _MOST_JUNK):
            yield dict.fromkeys(_COLUMNS) | {"headers": {}, "warc_type": "unreadable", "block": junk}
            junk = b""
        if not line:
            return
        if not begins:
            junk += line if line.strip() or junk else b""
            continue
        lines = []
        while (line := stream.readline()).rstrip(b"\r\n") != b"":
            lines.append(line.rstrip(b"\r\n"))
        record, size = _head(lines)
        record["block"] = stream.read(size)
        if len(record["block"]) < size:
            record["headers"].setdefault("WARC-Truncated", "length")
        yield record


#: Bytes of an ``unreadable`` row, about.
_MOST_JUNK = 1 << 20


def parse(data: bytes) -> Iterator[dict]:
    """Records of a file's bytes, plain or of gzip members."""
    yield from records_of(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [{**r, "headers": dict(r["headers"] or ())} for r in batch.to_pylist()]
        members = [gzip.compress(to_bytes(r), 6, mtime=0) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(members, type=pa.binary())], names=["record_id", "member"])


def encode(records: DataFrame) -> DataFrame:
    """``record_id, member``: each record as a gzip member of a WARC file."""
    return records.select(*_COLUMNS).mapInArrow(_encode, "record_id string, member binary")


#: What lies between records, and begins the next one.
_BETWEEN = "\r\n\r\nWARC/"


class _Joined(io.RawIOBase):
    """The bytes of a file, from the pieces between separators."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.left = pieces, memoryview(b"")
        self.between = b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not len(self.left):
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.left = memoryview(self.between + piece)
            self.between = _BETWEEN.encode()
        n = min(len(out), len(self.left))
        out[:n] = self.left[:n]
        self.left = self.left[n:]
        return n


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of files whose pieces follow one another."""
    cells = ((file, cell.as_buffer().to_pybytes()) for batch in batches for file, cell in zip(batch.column(0).to_pylist(), batch.column(1)))
    rows, size = [], 0
    for _, pieces in itertools.groupby(cells, key=lambda c: c[0]):
        for record in records_of(io.BufferedReader(_Joined(p for _, p in pieces), 1 << 16)):
            rows.append(record)
            size += len(record["block"])
            if len(rows) >= 64 or size >= 4 << 20:
                yield _batch(rows)
                rows, size = [], 0
    if rows:
        yield _batch(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, read as a stream of records by Spark's text reader.

    Files ending in ``.gz`` are read by one task each, member after member.
    Plain files are split over tasks like any text; their pieces are dealt by
    file and put in order again, so records are told by their lengths however
    Spark splits a file and whatever their blocks hold.  No file is held whole:
    a task lets the pieces pass and holds one record, or one piece of a file
    without the usual line ends.
    """
    text = spark.read.text(path, lineSep=_BETWEEN).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    zipped = F.col("file").endswith(".gz")
    plain = text.filter(~zipped).repartition("file").sortWithinPartitions("file", "start", "n")
    return text.filter(zipped).select("file", "value").mapInArrow(_records, RECORD).unionByName(plain.select("file", "value").mapInArrow(_records, RECORD))
