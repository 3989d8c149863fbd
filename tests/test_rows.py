"""Work within rows, lists and pages, listings and formats, by examples and plain Python."""

import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkstream.functions import arrays as A
from inkstream.functions import publish as P
from inkstream.operators import cues as Q
from inkstream.operators import media as M
from inkstream.operators import review as V
from inkstream.operators import state as S
from inkstream.sources import epub


@pytest.mark.parametrize("step", [1, 3, 256])
def test_running_totals(spark, step):
    rng = random.Random(step)
    rows = [(k, [rng.randint(0, 9) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 3, 6, 7, 30, 700])]
    got = spark.createDataFrame(rows, "k int, n array<bigint>").select("k", A.running_totals(F.col("n"), step).alias("t")).collect()
    for (_, numbers), r in zip(rows, sorted(got, key=lambda r: r.k)):
        assert r.t == [sum(numbers[: i + 1]) for i in range(len(numbers))]


def test_counted_words(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["apple", "bear's", "'cedar'", "oak", "That", "delta"]) for _ in range(n))) for k, n in enumerate([0, 1, 5, 400])] + [(9, None)]
    df = spark.createDataFrame(rows, "k int, t string")
    got = sorted((r.k, r["rank"], r.word, r.n) for r in M.term_counts(df, "k", "t", ["that"]).collect())
    want = []
    for k, t in rows:
        count = Counter(w for w in (x.strip("'") for x in (t or "").lower().split()) if len(w) >= 4 and w != "that")
        want += [(k, i + 1, w, n) for i, (w, n) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0])))]
    assert got == sorted(want)
    assert M.term_counts(df, "k", "t", [], most=1).filter("k = 3").count() == 1


def test_captions_of_one_row_and_of_many(spark):
    words = "One two, three. four five".split()
    rows = [(1, i, i * 0.5, i * 0.5 + 0.5, w) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "d int, seq int, start double, end double, word string")
    got = [(r.caption, r.start, r.end, r.text) for r in Q.word_captions(df, "d").orderBy("caption").collect()]
    assert got == [(0, 0.0, 1.0, "One two,"), (1, 1.0, 1.5, "three."), (2, 1.5, 2.5, "four five")]
    assert Q.word_captions(df.filter("false"), "d").count() == 0


def test_pages_have_the_total_of_the_list(spark):
    rows = spark.range(7)
    for number, want in ((0, [0, 1, 2]), (1, [0, 1, 2]), (3, [6]), (4, [])):
        got = V.page_with_total(rows, [F.col("id")], number, 3).collect()
        assert [r.id for r in got] == want and all(r.total == 7 for r in got)


def test_excerpts_stop_where_the_budget_ends(spark):
    texts = ["  one\n two ", "", "x" * 30, "y" * 100, "never"]
    df = spark.createDataFrame([(texts,)], "t array<string>")
    r = df.select(P.excerpt(F.col("t"), 60).alias("a"), P.passage_lines(F.col("t"), 200).alias("b"), P.joined(F.col("t")).alias("c")).first()
    assert r.a == "one two\n\n" + "x" * 30 + "\n\n" + "y" * 19 + "…"
    assert r.b == ["one two", "x" * 30, "y" * 100] and r.c.count("\n\n") == 3


def test_names_stand_in_readers_order(spark):
    df = spark.createDataFrame([(x,) for x in ["zebra", "Éclair", "apple", "eclipse", "Zen"]], "n string")
    assert [r.n for r in V.by_name(df, "n").collect()] == ["apple", "Éclair", "eclipse", "zebra", "Zen"]


def test_throttle_passes_what_is_late_or_far_enough(spark):
    events = [(0.1, 0.0), (0.2, 0.005), (0.3, 0.03), (0.4, 0.02), (2.0, 0.031), (2.1, 0.031), (2.2, 0.04), (2.3, 1.0), (2.4, 1.0)]
    got = S.throttled(spark.createDataFrame([(1, *e) for e in events], "k int, at double, value double"), "k", "at", "value")
    assert sorted((r.at, r.value) for r in got.collect()) == [(0.1, 0.0), (0.3, 0.03), (2.0, 0.031), (2.3, 1.0)]


def test_subtitle_documents_are_whole(spark):
    cues = spark.createDataFrame([(1, 1, 0.0, 1.5, "Hello {x}"), (1, 2, 1.5, 3.0, ""), (1, 3, 3661.239, 3662.0, "a\nb")], "k int, idx int, start double, end double, content string")
    lines = Q.to_ass(cues, "k", 1920, 1080, colour="#abc", position="top").first().ass.split("\n")
    assert lines[0] == "[Script Info]" and "PlayResX: 1920" in lines and lines[-1] == ""
    style = next(x for x in lines if x.startswith("Style: ")).removeprefix("Style: ").split(",")
    assert len(style) == len(P.STYLE_FIELDS.split(", ")) and style[3] == "&H00CCBBAA" and style[18] == "8" and style[19:22] == ["96", "96", "54"]
    assert lines[-3:-1] == ["Dialogue: 0,0:00:00.00,0:00:01.50,Default,,0,0,0,,Hello \\{x\\}", "Dialogue: 0,1:01:01.24,1:01:02.00,Default,,0,0,0,,a\\Nb"]


def test_books_are_read_as_what_they_are(spark, tmp_path):
    (tmp_path / "one.txt").write_text("before\n\n## First\n\npara\n\n### Sub\n\nmore\n\n## Second\n\nend\n")
    (tmp_path / "two.md").write_text("# Only\n\ntext")
    (tmp_path / "bad.epub").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF-1.4 ...")
    with zipfile.ZipFile(tmp_path / "empty.epub", "w") as z:
        z.writestr("mimetype", "application/epub+zip")
    rows = epub.read_books(spark, str(tmp_path)).collect()
    of = lambda name: sorted((r.ord, r.chapter_id, r.title, r.block_id, r.kind, r.text) for r in rows if r.path.endswith(name) and r.ord is not None)
    assert of("one.txt") == [
        (0, "ch-0", "one", "0:0", "paragraph", "before"),
        (1, "ch-1", "First", "1:0", "heading", "First"),
        (2, "ch-1", "First", "1:1", "paragraph", "para"),
        (3, "ch-1", "First", "1:2", "heading", "Sub"),
        (4, "ch-1", "First", "1:3", "paragraph", "more"),
        (5, "ch-2", "Second", "2:0", "heading", "Second"),
        (6, "ch-2", "Second", "2:1", "paragraph", "end"),
    ]
    assert [x[1:4] for x in of("two.md")] == [("ch-0", "Only", "0:0"), ("ch-0", "Only", "0:1")]
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows if r.kind == "unreadable") == ["bad.epub", "empty.epub", "scan.pdf"]
