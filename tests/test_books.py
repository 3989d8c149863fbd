import pytest
from pyspark.sql import functions as F

from inkstream.operators import classify as C
from inkstream.operators import outline as O
from inkstream.operators import segment as G

BLOCKS = "book_id long, block_id string, kind string, text string, level int, chapter_id string, ord int"
CHAPTERS = "book_id long, chapter_id string, title string, landmark string"
UNIT = " ".join(["word"] * 27)  # ten seconds


def book(spark, chapters):
    """Chapters as (title, landmark, [(kind, text) or text]); ord starts at 1."""
    b, c, n = [], [], 0
    for k, (title, landmark, rows) in enumerate(chapters):
        c.append((1, f"ch-{k}", title, landmark))
        for j, row in enumerate(rows):
            kind, text = row if isinstance(row, tuple) else ("paragraph", row)
            n += 1
            level = 1 if kind == "heading" else None
            if kind.startswith("h") and kind[1:].isdigit():
                kind, level = "heading", int(kind[1:])
            b.append((1, f"{k}:{j}", kind, text, level, f"ch-{k}", n))
    return spark.createDataFrame(b, BLOCKS), spark.createDataFrame(c, CHAPTERS)


def rules(spark, chapters):
    return {r.block_id: r.rule for r in C.classify(*book(spark, chapters)).collect()}


def prose(k):
    return f"Distinct prose number {k} that tells of many things and ends without a figure at all, so it stays"


@pytest.mark.parametrize(("n", "rule"), [(5, "repeated_running_head"), (4, "default_keep")])
def test_running_heads_need_five_chapters(spark, n, rule):
    got = rules(spark, [(f"c{k}", None, ["The Harbour   " + str(47 + k), prose(chr(97 + k))]) for k in range(n)])
    assert [got[f"{k}:0"] for k in range(n)] == [rule if n == 5 else "toc_entry_shape"] * n
    got = rules(spark, [(f"c{k}", None, ["The Harbour", prose(chr(97 + k))]) for k in range(n)])
    assert [got[f"{k}:0"] for k in range(n)] == [rule if n == 5 else "boilerplate_repeat" if len("the harbour") >= 12 else "default_keep"] * n


def test_cascade(spark):
    got = rules(
        spark,
        [
            ("c", "copyright", ["anything"]),
            ("c", "toc", ["x"]),
            ("c", "index", ["x"]),
            ("c", "frontmatter", ["x"]),
            ("One", None, [("heading", "Chapter One"), "17", ("footnote", "a note"), ("page_number", "ix"), ("toc_entry", "t"), "ISBN 978-3-16-148410-0", "All rights reserved.", "© Some House 1999", prose("q")]),
            ("Two", None, ["iv", "12", prose("r"), "vivid"]),
            ("Three", None, ["Intro ..... 3", "Part A\t\t9", "The End  120", prose("s")]),
            ("Four", None, [("heading", "About the Author"), "She wrote it.", ("h2", "Deeper"), "More.", ("heading", "Notes"), "After."]),
            ("Five", None, ["He paused... then left", "born in 1987", ("heading", "99")]),
        ],
    )
    want = {"0:0": "landmark_front_matter", "1:0": "landmark_toc", "2:0": "landmark_back_matter", "3:0": "landmark_front_matter", "4:0": "default_keep", "4:1": "page_number", "4:2": "footnote_block", "4:3": "page_number", "4:4": "toc_entry_shape"}
    want |= {"4:5": "copyright_notice", "4:6": "copyright_notice", "4:7": "copyright_notice", "4:8": "default_keep", "5:0": "page_number", "5:1": "page_number", "5:2": "default_keep", "5:3": "default_keep"}
    want |= {f"6:{k}": "toc_chapter_shape" for k in range(4)}
    want |= {f"7:{k}": "about_the_author" for k in range(4)} | {"7:4": "default_keep", "7:5": "default_keep", "8:0": "default_keep", "8:1": "default_keep", "8:2": "default_keep"}
    assert got == want


def test_overrides(spark):
    schema = "book_id long, block_id string, keep boolean, rule string, confidence double, source string"
    s = spark.createDataFrame([(1, "a", True, "default_keep", 1.0, "structural"), (1, "b", False, "x", 0.8, "user")], schema)
    o = spark.createDataFrame([(1, "a", False, "r1", 1.0, "llm", 1), (1, "a", True, "r2", 1.0, "user", 2), (1, "a", False, "r3", 1.0, "llm", 3), (1, "b", True, "r4", 1.0, "llm", 1), (1, "z", False, "r5", 1.0, "llm", 1)], schema + ", seq int")
    got = {r.block_id: r.rule for r in C.merge_decisions(s, o).collect()}
    assert got == {"a": "r2", "b": "x", "z": "r5"}


def sizes(spark, chapters, mode, target, most):
    b, c = book(spark, chapters)
    return [r.n_blocks for r in G.plan_segments(b, c, mode, target, most).orderBy("idx").collect()]


def test_segment_sizes(spark):
    assert sizes(spark, [("c", None, [UNIT] * 20)], "duration", 55, 100) == [6, 6, 6, 2]
    assert sizes(spark, [("a", None, [UNIT] * 8), ("b", None, [UNIT] * 3)], "duration", 100, 200) == [8, 3]
    assert sizes(spark, [("a", None, [UNIT] * 4), ("b", None, [UNIT] * 3)], "duration", 100, 200) == [7]
    assert sizes(spark, [("c", None, [UNIT] * 10)], "chapter", 15, 25) == [2, 2, 2, 2, 2]
    assert sizes(spark, [("a", None, [("heading", "A"), UNIT]), ("b", None, [("heading", "B"), UNIT])], "chapter", 900, 1500) == [2, 2]


def test_headings_move_to_the_next_segment(spark):
    b, c = book(spark, [("a", None, [UNIT] * 6 + [("heading", "Next")] + [UNIT] * 3 + [("heading", "Last")])])
    got = G.plan_segments(b, c, "duration", 55, 62).orderBy("idx").collect()
    assert [r.n_blocks for r in got] == [6, 5] and got[1].title == "Next" and got[0].title == "a (part 1)"


def test_segment_invariants(spark):
    b, c = book(spark, [(f"c{k}", None, [("heading", f"H{k}")] + [" ".join(["word"] * (13 + 7 * ((k * j) % 5))) for j in range(9)]) for k in range(6)])
    rows = G.segment_of_block(b, "duration", 40, 60).orderBy("ord").collect()
    assert len(rows) == b.count() and [r.idx for r in rows] == sorted(r.idx for r in rows)
    for k in {r.idx for r in rows}:
        own = [r.seconds for r in rows if r.idx == k]
        assert sum(own[:-1]) <= 60


def test_short_chunks(spark):
    words = lambda n: " ".join(["w"] * n)
    b, c = book(spark, [("A", None, [words(40), words(50)]), ("B", None, [words(30)])])
    got = G.short_chunks(b, c, 200, 400).orderBy("idx").collect()
    assert [(r.first_block, r.last_block, r.words) for r in got] == [("0:0", "0:1", 90), ("1:0", "1:0", 30)]
    assert G.short_chunks(b.filter("false"), c).count() == 0
    many = spark.createDataFrame([(1, k) for k in range(20)] + [(2, k) for k in range(4)], "book_id long, idx int")
    assert [r.idx for r in G.spread(many, 5).filter("book_id = 1").orderBy("idx").collect()] == [0, 4, 9, 13, 17]
    assert G.spread(many, 5).filter("book_id = 2").count() == 4


@pytest.mark.parametrize(("text", "is_title"), [("Chapter 5", True), ("IV. The Storm", True), ("12", True), ("THE STORM", True), ("The storm came", False), ("x" * 90, False), ("Book the First", True), ("", False)])
def test_titles(spark, text, is_title):
    assert spark.createDataFrame([(text,)], "t string").select(O.title_like(F.col("t"))).first()[0] == is_title


def test_section_titles(spark):
    rows = [("IV", "The Storm", "Chapter IV — The Storm"), ("The Calm", "x", "The Calm"), ("3", "4", "Chapter 3"), ("", "After", "After")]
    df = spark.createDataFrame(rows, "a string, b string, want string").withColumn("got", O.section_title(F.col("a"), F.col("b")))
    assert all(r.got == r.want for r in df.collect())


def test_contents_page_is_skipped(spark):
    entries = [("heading", "Contents"), ("heading", "Chapter 1"), ("heading", "Chapter 2"), ("heading", "Chapter 3")]
    b, c = book(spark, [("front", None, entries), ("one", None, [("heading", "Chapter 1"), UNIT * 4]), ("two", None, [("heading", "Chapter 2"), UNIT * 4])])
    units = O.outline(b, c)
    got = {r.start_block for r in O.skipped(units).collect()}
    assert got == {"0:0", "0:1", "0:2", "0:3"}
    left = O.without_skipped(b, O.skipped(units))
    assert left.count() == 4
    assert O.without_skipped(b.filter("ord <= 4"), O.skipped(units)).count() == 4
    named = {r.block_id: r.section_block for r in O.section_of_block(b, O.sections(units)).collect()}
    assert named["1:1"] == "1:0" and named["2:1"] == "2:0"


def test_smart_segments(spark):
    b, c = book(spark, [("One", None, [("heading", "Chapter 1")] + [UNIT] * 4 + [("heading", "Chapter 2")]), ("Two", None, [("heading", "Deeper")] + [UNIT] * 3 + [("heading", "Chapter 3")] + [UNIT] * 12), ("End", None, [("heading", "Coda")])])
    found = b.filter("kind = 'heading'").select("book_id", F.col("block_id").alias("start_block"), F.col("text").alias("title"))
    runs = {}
    for r in O.runs(b, found).orderBy("ord").collect():
        runs.setdefault(r.run, []).append(r.block_id)
    assert [v[0] for v in runs.values()] == ["0:0", "0:5", "1:4", "2:0"] and runs[max(runs)] == ["2:0"]
    got = O.smart_segments(b, c, found, target=60, most=80).orderBy("idx").collect()
    assert sum(r.n_blocks for r in got) == b.count()
    assert [r.first_block for r in got][:2] == ["0:0", "1:4"] and got[0].title == "Chapter 1" and got[1].title == "Chapter 3"
    assert got[2].title == "Chapter 3 (part 2)" and all(r.estimated_duration <= 81 for r in got)
