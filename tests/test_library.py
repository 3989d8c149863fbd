"""Folders as data sources, and subtitle files that appear together."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from inkstream.operators import cues as Q
from inkstream.sources import epub as E
from inkstream.sources import library as L


def archive(*chapters):
    out = io.BytesIO()
    items = "".join(f'<item id="c{k}" href="c{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(len(chapters)))
    refs = "".join(f'<itemref idref="c{k}"/>' for k in range(len(chapters)))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", f"<package><manifest>{items}</manifest><spine>{refs}</spine></package>")
        for k, text in enumerate(chapters):
            z.writestr(f"o/c{k}.xhtml", f"<html><body><h1>Chapter {k}</h1><p>{text}</p></body></html>")
    return out.getvalue()


@pytest.fixture
def folders(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    (a / "one.epub").write_bytes(archive("old text"))
    (b / "one.epub").write_bytes(archive("new text", "more"))
    (a / "named.txt").write_bytes(archive("in disguise"))
    (a / "notes.md").write_text("# Title\n\nFirst words.\n\n## Part\n\nLast words.\n")
    (a / "scan.pdf").write_bytes(b"%PDF-1.7 ...")
    (b / "broken.epub").write_bytes(b"PK\x03\x04 nothing")
    (a / "song.mp3").write_bytes(b"x" * 10)
    (b / "song.mp3").write_bytes(b"y" * 20)
    (b / ".upload-9.mp3").write_bytes(b"z")
    (tmp_path / "secret.mp3").write_bytes(b"s")
    os.symlink(tmp_path / "secret.mp3", b / "link.mp3")
    (a / "deep").mkdir()
    (a / "deep" / "inner.txt").write_text("Inner.")
    return str(a), str(b)


def test_books_of_folders(spark, folders):
    rows = L.read_library(spark, *folders).orderBy("path", "ord").collect()
    by = {}
    for r in rows:
        by.setdefault(os.path.basename(r.path), []).append(r)
    assert [r.text for r in by["one.epub"]] == ["Chapter 0", "new text", "Chapter 1", "more"] and by["one.epub"][0].path.startswith(folders[1])
    assert [r.text for r in by["named.txt"]] == ["Chapter 0", "in disguise"]
    assert [(r.kind, r.text) for r in by["notes.md"]] == [("heading", "Title"), ("paragraph", "First words."), ("heading", "Part"), ("paragraph", "Last words.")]
    assert [r.kind for r in by["scan.pdf"]] == ["unreadable"] and [r.kind for r in by["broken.epub"]] == ["unreadable"]
    assert "inner.txt" not in by and "song.mp3" not in by
    deep = L.read_library(spark, *folders, recursive=True)
    assert "Inner." in {r.text for r in deep.collect()}


def test_the_same_blocks_as_the_archive_reader(spark, folders):
    columns = ["chapter_id", "chapter", "title", "block_id", "ord", "kind", "level", "text"]
    L.register(spark)
    one = spark.read.format("ink_books").load(folders[1]).filter("name = 'one.epub'").select(*columns)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, E.read_epub(spark, folders[1] + "/one.epub").select(*columns).collect()))


def test_conditions_are_applied_before_files_are_opened(spark, folders):
    L.register(spark)
    files = spark.read.format("ink_files").option("folders", ";".join(folders)).load()
    assert {r.name: r.format for r in files.collect()} == {"broken.epub": "epub", "named.txt": "epub", "notes.md": "text", "one.epub": "epub", "scan.pdf": "pdf", "song.mp3": "sound"}
    got = files.filter("format = 'epub' AND name LIKE '%.epub' AND length > 100")
    assert {r.name for r in got.collect()} == {"one.epub"}
    # what is left to Spark is the length alone
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "length" in plan.split("Filter", 1)[1].split("\n")[0] and "LIKE" not in plan and "EndsWith" not in plan.split("Filter", 1)[1].split("\n")[0]
    reader = L._ListReader({"folders": ";".join(folders)})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringEndsWith

    kept = list(reader.pushFilters([StringEndsWith(("name",), ".epub"), EqualTo(("format",), "epub"), GreaterThan(("length",), 3)]))
    assert [type(f) for f in kept] == [GreaterThan] and {f.name for p in reader.partitions() for f in p.files} == {"one.epub", "broken.epub"}


def test_partitions_by_size():
    files = [L.File("f", f"f/{k}", str(k), n) for k, n in enumerate([100, 90, 60, 40, 30, 30, 10, 5])]
    parts = [[f.length for f in p.files] for p in L.packed(files, 100, opening=0)]
    assert sorted(n for p in parts for n in p) == sorted(f.length for f in files)
    assert all(sum(p) <= 100 for p in parts) and len(parts) == 4
    assert L.packed([], 100) == []


def test_media_folders(spark, folders):
    assert [(r.name, r.length) for r in L.media_files(spark, *folders).collect()] == [("song.mp3", 20)]
    assert L.media_files(spark, folders[0], folders[0] + "/none").count() == 1


def cues(spark, n):
    rows = [(f"film {k}/{k}", i, i * 2.0, i * 2.0 + 1.5, f"line {i} é") for k in range(n) for i in range(3)]
    return spark.createDataFrame(rows, "key string, idx int, start double, end double, content string")


def test_subtitles_appear_together(spark, tmp_path):
    L.register(spark)
    docs = Q.to_srt(cues(spark, 5), "key")
    docs.repartition(3).write.format("ink_subtitles").mode("append").save(f"{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out")) == [f"film {k}_{k}.srt" for k in range(5)]
    want = {r.key: r.srt for r in docs.collect()}
    assert (tmp_path / "out" / "film 2_2.srt").read_text() == want["film 2/2"]
    with pytest.raises(Exception, match="there already"):
        docs.write.format("ink_subtitles").mode("append").save(f"{tmp_path}/out")
    ass = Q.to_ass(cues(spark, 2), "key", 1920, 1080)
    ass.write.format("ink_subtitles").option("extension", "ass").mode("overwrite").save(f"{tmp_path}/out")
    assert (tmp_path / "out" / "film 0_0.ass").read_text().startswith("[Script Info]") and len(os.listdir(tmp_path / "out")) == 7


def test_no_file_is_seen_if_a_task_fails(spark, tmp_path):
    L.register(spark)
    docs = Q.to_srt(cues(spark, 6), "key").repartition(3, "key")
    bad = docs.withColumn("srt", F.when(F.col("key") == "film 4/4", F.raise_error(F.lit("lost"))).otherwise(F.col("srt")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("ink_subtitles").mode("append").save(f"{tmp_path}/out")
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []
    with pytest.raises(Exception, match="several rows"):
        docs.unionAll(docs).write.format("ink_subtitles").mode("append").save(f"{tmp_path}/out")
    assert os.listdir(tmp_path / "out") == []
