"""Folders of books and media as data sources of Spark, and subtitle files as a sink.

``spark.read.format("ink_files")`` lists files, ``"ink_books"`` reads the books
among them: files are packed into partitions by size, conditions on format,
name and path are applied before a file is opened, and of files of one name the
later folder's counts.  ``write.format("ink_subtitles")`` writes one file per
row; none is seen before all are written.  Paths may be of any file system that
Arrow knows.
"""

from __future__ import annotations

import posixpath
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from . import epub as E

#: Bytes of files that a partition takes, and what opening a file counts as, unless the options say otherwise.
PARTITION_BYTES, OPEN_BYTES = 128 << 20, 1 << 20
#: Extensions of sounds, what uploads that were not checked begin with.
SOUNDS, STAGED = (".mp3", ".wav", ".m4a", ".aac", ".flac", ".ogg"), ".upload-"

FILES = "folder string, path string, name string, format string, length long"
BOOKS = "path string, name string, format string, chapter_id string, chapter int, title string, landmark string, block_id string, ord int, kind string, level int, text string"


def _file_system(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def named_format(name: str) -> str:
    ext = posixpath.splitext(name)[1].lower()
    return ext[1:] if ext in (".epub", ".pdf") else "sound" if ext in SOUNDS else "text"


def content_format(head: bytes, name: str) -> str:
    """From the first bytes, else from the extension."""
    return "epub" if head[:4] == b"PK\x03\x04" else "pdf" if head[:4] == b"%PDF" else named_format(name)


@dataclass(frozen=True)
class File:
    folder: str
    path: str
    name: str
    length: int


def listed(folders: list[str], recursive: bool) -> list[File]:
    """Files of the folders, of one name the last folder's; by name without case.  Links that lead out of a folder are not followed."""
    import os

    from pyarrow import fs

    found: dict[str, File] = {}
    for folder in folders:
        system, base = _file_system(folder)
        if system.get_file_info(base).type == fs.FileType.NotFound:
            continue
        local = isinstance(system, fs.LocalFileSystem)
        for info in system.get_file_info(fs.FileSelector(base, recursive=recursive)):
            if info.type != fs.FileType.File or info.base_name.startswith((STAGED, "_")):
                continue
            if local and not os.path.realpath(info.path).startswith(os.path.realpath(base) + os.sep):
                continue
            found[info.path[len(base) :].lstrip("/") if recursive else info.base_name] = File(folder, info.path, info.base_name, info.size)
    return [found[k] for k in sorted(found, key=lambda k: (k.lower(), k))]


class Packed(InputPartition):
    """Files that one task reads."""

    def __init__(self, files: list[File]):
        super().__init__(None)
        self.files = files


def packed(files: list[File], most: int, opening: int = OPEN_BYTES) -> list[Packed]:
    """Files in partitions of about ``most`` bytes, largest first, so that no partition waits for a large file behind many others."""
    out, open_ones = [], []
    for f in sorted(files, key=lambda f: (-f.length, f.path)):
        cost = f.length + opening
        for p in open_ones:
            if p[0] + cost <= most:
                p[0] += cost
                p[1].append(f)
                break
        else:
            open_ones.append([cost, [f]])
            if len(open_ones) > 64:  # the fullest is closed, so packing stays linear
                open_ones.sort(key=lambda p: p[0])
                out.append(open_ones.pop()[1])
    return [Packed(p) for p in [*out, *(p[1] for p in open_ones)]]


class _FileReader(DataSourceReader):
    """What both sources share: options, listing, and conditions that are known before a file is opened."""

    #: Columns whose conditions are applied here, and whether the listing alone tells them.
    known = ("name", "path")

    def __init__(self, options: dict):
        folders = options.get("folders") or options.get("path") or ""
        self.folders = [f.strip() for f in folders.split(";") if f.strip()]
        if not self.folders:
            raise ValueError("give a path, or folders separated by semicolons")
        self.recursive = str(options.get("recursive", "false")).lower() == "true"
        self.most = int(options.get("maxPartitionBytes", PARTITION_BYTES))
        self.tests: list[Filter] = []
        self.formats: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("format",) and isinstance(f, (EqualTo, In)):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.formats = wanted if self.formats is None else self.formats & wanted
            elif len(column) == 1 and column[0] in self.known and isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)):
                self.tests.append(f)
            else:
                yield f

    def _meets(self, f: File) -> bool:
        for t in self.tests:
            value = getattr(f, t.attribute[0])
            ok = (
                value == t.value
                if isinstance(t, EqualTo)
                else value in t.value
                if isinstance(t, In)
                else value.startswith(t.value)
                if isinstance(t, StringStartsWith)
                else value.endswith(t.value)
                if isinstance(t, StringEndsWith)
                else t.value in value
            )
            if not ok:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        return packed([f for f in listed(self.folders, self.recursive) if self._meets(f)], self.most)


class _ListReader(_FileReader):
    def read(self, partition: Packed) -> Iterator[tuple]:
        for f in partition.files:
            system, _ = _file_system(f.folder)
            with system.open_input_file(f.path) as data:
                kind = content_format(data.read(4), f.name)
            if self.formats is None or kind in self.formats:
                yield f.folder, f.path, f.name, kind, f.length


class _BookReader(_FileReader):
    def read(self, partition: Packed) -> Iterator[tuple]:
        for f in partition.files:
            system, _ = _file_system(f.folder)
            with system.open_input_file(f.path) as data:
                kind = content_format(data.read(4), f.name)
                if kind == "sound" or (self.formats is not None and kind not in self.formats):
                    continue
                data.seek(0)
                yield from ((f.path, f.name, kind, *row) for row in _rows(kind, f, data))


def _rows(kind: str, f: File, data) -> Iterator[tuple]:
    told = lambda what, text: (None, None, None, None, None, None, what, None, text)
    if kind == "pdf":
        yield told("unreadable", "a PDF is read page by page")
    elif kind == "text":
        if f.length > E.MOST_BYTES:
            yield told("unreadable", "too large")
        else:
            yield told("source", data.read().decode("utf-8", "replace"))
    else:
        try:  # the archive is read entry by entry, so it is not held whole
            n = 0
            for k, (cid, _, title, mark, blocks) in enumerate(E.book(data)):
                for j, (what, depth, text) in enumerate(blocks):
                    yield cid, k, title, mark, f"{k}:{j}", n, what, depth, text
                    n += 1
        except E.Unreadable as why:
            yield told("unreadable", str(why))


class FileSource(DataSource):
    """Options: ``path``, or ``folders`` separated by semicolons, later ones first; ``recursive``; ``maxPartitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "ink_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ListReader(self.options)


class BookSource(FileSource):
    """Blocks of EPUB books; a text file is one row of kind ``source`` and what cannot be read one of kind ``unreadable``."""

    @classmethod
    def name(cls) -> str:
        return "ink_books"

    def schema(self) -> str:
        return BOOKS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BookReader(self.options)


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class _SubtitleWriter(DataSourceWriter):
    """Files go to a folder of the task's attempt; the driver moves them to their places once all are written."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.suffix = "." + options.get("extension", "srt").lstrip(".")
        names = [f.name for f in schema.fields]
        if len(names) != 2:
            raise ValueError("a subtitle table has two columns: the file's name and its text")
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, base = _file_system(self.path)
        own = f"{base}/{self.staging}/{uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        names = []
        for name, text in iterator:
            if name is None or text is None:
                continue
            file = safe_name(str(name)) + self.suffix
            with system.open_output_stream(f"{own}/{file}") as out:
                out.write(text.encode())
            names.append(file)
        return Staged(own, names)

    def commit(self, messages: list) -> None:
        system, base = _file_system(self.path)
        done = [m for m in messages if m is not None]
        every = Counter(n for m in done for n in m.names)
        twice = [n for n, times in every.items() if times > 1]
        if twice:
            self._clear()
            raise ValueError(f"several rows for one file: {sorted(twice)[:3]}")
        if not self.overwrite:
            known = {f.name for f in listed([self.path], False)} & every.keys()
            if known:
                self._clear()
                raise ValueError(f"files are there already: {sorted(known)[:3]}")
        for m in done:
            for n in m.names:
                system.move(f"{m.folder}/{n}", f"{base}/{n}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, base = _file_system(self.path)
        if system.get_file_info(f"{base}/{self.staging}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/{self.staging}")


def safe_name(name: str) -> str:
    """A name that stays in its folder."""
    return name.replace("/", "_").replace("\\", "_").lstrip(".") or "_"


class SubtitleSink(DataSource):
    """Options: ``path`` and ``extension`` (srt unless given).  Mode ``overwrite`` replaces files of the same names and leaves others."""

    @classmethod
    def name(cls) -> str:
        return "ink_subtitles"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _SubtitleWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the sources and the sink known to a session, which then hands them conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FileSource, BookSource, SubtitleSink):
        spark.dataSource.register(source)


def read_library(spark: SparkSession, *folders: str, recursive: bool = False) -> DataFrame:
    """Blocks of all books in folders, later ones over earlier ones: ``path, chapter_id, title, block_id, ord, kind, level, text``."""
    from pyspark.sql import functions as F

    from .plain import text_blocks, text_chapters

    register(spark)
    wanted = ["path", "chapter_id", "title", "block_id", "ord", "kind", "level", "text"]

    # a table keeps the conditions of its first scan, so each part is a table of its own
    def books(condition: str) -> DataFrame:
        return spark.read.format("ink_books").option("folders", ";".join(folders)).option("recursive", str(recursive)).load().filter(condition)

    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    plain = text_blocks(books("format = 'text' AND kind = 'source'").select("path", "text"), "path")
    told = books("format = 'text' AND kind = 'unreadable'").select(*wanted)
    return books("format IN ('epub', 'pdf')").select(*wanted).unionByName(text_chapters(plain, "path", stem).select(*wanted)).unionByName(told)


def media_files(spark: SparkSession, *folders: str) -> DataFrame:
    """``name, path, length`` of sounds in folders: a later folder's file stands for an earlier one's of that name."""
    register(spark)
    files = spark.read.format("ink_files").option("folders", ";".join(folders)).load()
    return files.filter("format = 'sound'").select("name", "path", "length")
