"""Books in EPUB archives: spine order, navigation titles and landmarks."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html import parse

#: Fixed limits of an archive.
MOST_ENTRIES, MOST_BYTES = 20_000, 256 << 20
SCHEMA = "path string, chapter_id string, chapter int, title string, landmark string, block_id string, ord int, kind string, level int, text string"


class Unreadable(ValueError):
    """An archive that is not a book, is protected, or expands beyond the limits."""


def safe_entry(name: str) -> bool:
    return not (name.startswith(("/", "\\")) or re.match(r"[A-Za-z]:", name) or ".." in name.replace("\\", "/").split("/"))


def entries(data) -> dict[str, zipfile.ZipInfo]:
    """Names to entries of an archive, bytes or an open file, within the limits; the first of a name counts."""
    try:
        infos = zipfile.ZipFile(_opened(data)).infolist()
    except (zipfile.BadZipFile, ValueError) as e:  # some files refuse places before their start
        raise Unreadable(str(e)) from e
    if len(infos) > MOST_ENTRIES or sum(i.file_size for i in infos) > MOST_BYTES:
        raise Unreadable("too large")
    found: dict[str, zipfile.ZipInfo] = {}
    for i in infos:
        if i.flag_bits & 1:
            raise Unreadable("encrypted")
        if not safe_entry(i.filename):
            raise Unreadable(f"unsafe name {i.filename}")
        found.setdefault(i.filename, i)
    return found


def _opened(data):
    return io.BytesIO(data) if isinstance(data, bytes) else data


def resolve(base: str, href: str) -> str:
    """A reference without fragment, decoded, against the folder of the file that holds it."""
    path = unquote(href.split("#", 1)[0])
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), path)).lstrip("/") if path else ""


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _all(node: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in node.iter() if _local(e.tag) == name]


def _text(node: ET.Element) -> str:
    return " ".join("".join(node.itertext()).split())


def _attr(node: ET.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if _local(k) == name), "")


def book(data) -> list[tuple[str, int, str, str | None, list[tuple[str, int | None, str]]]]:
    """Chapters in spine order, of an archive's bytes or an open file: id, level, title, landmark and blocks."""
    names = entries(data)
    with zipfile.ZipFile(_opened(data)) as z:
        if "META-INF/encryption.xml" in names and b"EncryptedData" in z.read("META-INF/encryption.xml") and b"obfuscation" not in z.read("META-INF/encryption.xml"):
            raise Unreadable("protected")
        try:
            root = _attr(_all(ET.fromstring(z.read("META-INF/container.xml")), "rootfile")[0], "full-path")
            package = ET.fromstring(z.read(root))
        except (KeyError, IndexError, ET.ParseError) as e:
            raise Unreadable("no package") from e
        manifest = {_attr(i, "id"): i for i in _all(package, "item")}
        labels: dict[str, tuple[str, int]] = {}
        marks: dict[str, str] = {}
        for ref in _all(package, "reference"):
            kind = {"title-page": "titlepage", "copyright-page": "copyright"}.get(_attr(ref, "type"), _attr(ref, "type"))
            marks.setdefault(resolve(root, _attr(ref, "href")), kind)
        for item in manifest.values():
            path = resolve(root, _attr(item, "href"))
            if path not in names:
                continue
            if "nav" in _attr(item, "properties").split():
                for nav in _all(ET.fromstring(z.read(path)), "nav"):
                    for depth, a in _links(nav, 0):
                        target = resolve(path, _attr(a, "href"))
                        if _attr(nav, "type") == "landmarks":
                            marks.setdefault(target, _attr(a, "type"))
                        elif _attr(nav, "type") in ("toc", ""):
                            labels.setdefault(target, (_text(a), depth))
            elif _attr(item, "media-type") == "application/x-dtbncx+xml":
                for depth, point in _points(ET.fromstring(z.read(path)), 0):
                    label, src = _all(point, "text"), _all(point, "content")
                    if label and src:
                        labels.setdefault(resolve(path, _attr(src[0], "src")), (_text(label[0]), depth))
        out = []
        for ref in _all(package, "itemref"):
            item = manifest.get(_attr(ref, "idref"))
            path = resolve(root, _attr(item, "href")) if item is not None else ""
            if path not in names or _attr(ref, "linear") == "no":
                continue
            blocks = parse(z.read(path).decode("utf-8", "replace"))
            head = next((b for b in blocks if b[0] == "heading"), None)
            label, depth = labels.get(path, ("", 0))
            title = label or (head[2] if head else "") or posixpath.splitext(posixpath.basename(path))[0]
            out.append((f"ch-{len(out)}", depth or (head[1] if head else 1), title, marks.get(path), blocks))
        return out


def _links(node: ET.Element, depth: int) -> Iterator[tuple[int, ET.Element]]:
    for e in node:
        deeper = depth + (_local(e.tag) == "ol")
        if _local(e.tag) == "a":
            yield depth, e
        yield from _links(e, deeper)


def _points(node: ET.Element, depth: int) -> Iterator[tuple[int, ET.Element]]:
    for e in node:
        if _local(e.tag) == "navPoint":
            yield depth + 1, e
            yield from _points(e, depth + 1)
        elif _local(e.tag) == "navMap":
            yield from _points(e, depth)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    for batch in batches:
        for path, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows, n = [], 0
            try:
                chapters = book(cell.as_buffer().to_pybytes())
            except Unreadable as why:  # told in a row of its own, so no file goes unseen
                rows.append((path, None, None, None, None, None, None, "unreadable", None, str(why)))
                chapters = []
            for k, (cid, _, title, mark, blocks) in enumerate(chapters):
                for j, (kind, depth, text) in enumerate(blocks):
                    rows.append((path, cid, k, title, mark, f"{k}:{j}", n, kind, depth, text))
                    n += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=names)


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all books under a path, a task per file; an archive that cannot be read gives one row of kind ``unreadable`` with the reason."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read, SCHEMA)


def book_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, format, length``: what kind of book each file is."""
    from .plain import book_format

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", book_format(F.col("content"), F.col("path")).alias("format"), "length")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all books under a path, each read as what its first bytes or its name say: ``path, chapter_id, title, block_id, ord, kind, level, text``.

    Page images have no text of their own: a PDF gives one row of kind ``unreadable``.
    """
    from .plain import book_format, text_blocks, text_chapters

    files = spark.read.format("binaryFile").load(path).select("path", "content").withColumn("format", book_format(F.col("content"), F.col("path")))
    wanted = ["path", "chapter_id", "title", "block_id", "ord", "kind", "level", "text"]
    epub = files.filter("format = 'epub'").select("path", "content").mapInArrow(_read, SCHEMA)
    epub = epub.select(*wanted)
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    plain = text_blocks(files.filter("format = 'text'").select("path", F.col("content").cast("string").alias("text")), "path")
    plain = text_chapters(plain, "path", stem).select(*wanted)
    none = F.lit(None)
    pdf = files.filter("format = 'pdf'").select("path", *[none.cast("string").alias(c) for c in wanted[1:4]], none.cast("int").alias("ord"), F.lit("unreadable").alias("kind"), none.cast("int").alias("level"), F.lit("a PDF is read page by page").alias("text"))
    return epub.unionByName(plain).unionByName(pdf)
