import pytest

from inkstream.functions import transcripts as X
from inkstream.operators import columns as C
from inkstream.operators import outline as O
from inkstream.operators import scans as Z

CLEAN = "THE HARBOUR\n\nOne: The Pier\n\nThe tide came in at four.\n47"


@pytest.mark.parametrize(
    ("reply", "text", "accepted", "guards"),
    [
        (CLEAN, CLEAN, True, []),
        (None, "", True, ["blank_page"]),
        ("   ", "", True, ["blank_page"]),
        (" [[NO_TEXT]]\n", "", True, ["blank_page"]),
        ("[[NO_TEXT]]\nCHAPTER ONE", "CHAPTER ONE", True, []),
        ("Here is the text from the image\nCHAPTER ONE", "CHAPTER ONE", True, ["preamble_stripped"]),
        ("Here is the transcription: CHAPTER ONE", "CHAPTER ONE", True, ["preamble_stripped"]),
        ("Here is the transcription:\n\nCHAPTER ONE\nx", "CHAPTER ONE\nx", True, ["preamble_stripped"]),
        ("Here is the transcription of the page:", "", False, ["preamble_stripped", "meta_commentary"]),
        ("Here is the church.\nAnd here are the people.", "Here is the church.\nAnd here are the people.", True, []),
        ("Title: HARBOUR\nBody Text: The tide.\nFooter: 47", "HARBOUR\nThe tide.\n47", True, ["structural_labels_stripped"]),
        ("**HARBOUR**\n\n# One\n\nThe tide.", "HARBOUR\n\nOne\n\nThe tide.", True, ["markdown_stripped"]),
        ("**Title:** HARBOUR", "HARBOUR", True, ["markdown_stripped", "structural_labels_stripped"]),
        ("```\nCHAPTER ONE\nThe tide.\n```", "CHAPTER ONE\nThe tide.", True, ["code_fence_stripped"]),
        ("A note.* And another.", "A note.* And another.", True, []),
        ("I'm sorry, I cannot read the text in this image.", "", False, ["meta_commentary"]),
        ("The image shows a ledger.", "", False, ["meta_commentary"]),
        ("w " * 300 + "the image shows " + "w " * 300, ("w " * 300 + "the image shows " + "w " * 300).strip(), True, []),
        ("x" * 8001, "", False, ["over_long"]),
        ("You are an OCR engine. Read.", "", False, ["prompt_echo"]),
        ("Title:", "", True, ["structural_labels_stripped", "blank_page"]),
    ],
)
def test_recogniser_replies(spark, reply, text, accepted, guards):
    row = X.sanitise(spark.createDataFrame([(1, reply)], "page int, reply string"), "reply").first()
    assert (row.transcript, row.accepted, row.guards) == (text, accepted, guards)
    assert row.confidence == (0.0 if not text else pytest.approx(0.36) if {"preamble_stripped", "structural_labels_stripped"} & set(guards) else 0.45)


def column(left, right, count, top=700.0):
    return [(1, f"{left} {n}", float(left), float(right), top - 12 * n) for n in range(count)]


def placed(spark, rows):
    return spark.createDataFrame(rows, "page int, text string, left double, right double, y double")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        (column(50, 240, 6) + column(300, 490, 6), (240.0, 300.0)),
        ([(1, "title", 50.0, 490.0, 760.0)] + column(50, 240, 6) + column(300, 490, 6), (240.0, 300.0)),
        (column(50, 490, 12), None),
        ([(1, "x", 50.0, 400.0 + 8 * n, 700.0 - 12 * n) for n in range(12)], None),
        (column(50, 240, 3) + column(300, 490, 3), None),
        ([(1, "w", 50.0, 490.0, 900.0 - 12 * n) for n in range(9)] + column(50, 240, 6) + column(300, 490, 6), None),
        (column(50, 268, 6) + column(272, 490, 6), None),
        ([(1, None, None, None, None)], None),
        ([], None),
    ],
)
def test_gutter(spark, rows, want):
    found = C.gutter(placed(spark, rows)).collect()
    assert [(r.gutter_start, r.gutter_end) for r in found] == ([want] if want else [])


def test_left_column_is_read_first_between_lines_across(spark):
    rows = [(1, "title", 50.0, 490.0, 780.0), (1, "footer", 50.0, 490.0, 200.0)] + column(300, 490, 5) + column(50, 240, 5)
    got = [r.text for r in C.reading_order(placed(spark, rows)).orderBy("pos").collect()]
    assert got == ["title", *[f"50 {n}" for n in range(5)], *[f"300 {n}" for n in range(5)], "footer"]
    plain = placed(spark, [(1, "second", 50.0, 490.0, 100.0), (1, "first", 50.0, 490.0, 200.0)])
    assert [r.text for r in C.reading_order(plain).orderBy("pos").collect()] == ["first", "second"]


def items(spark, rows):
    return spark.createDataFrame([(1, t, float(x), float(y), 5.0 * len(t), 10.0) for t, x, y in rows], "page int, text string, x double, y double, width double, font_size double")


def test_columns_on_shared_baselines_stay_apart(spark):
    side = lambda name, x, count: [(f"{name} line number {n} xxxx", x, 700 - 14 * n) for n in range(count)]
    wide = "a title running the full width of the page, across both of its columns"
    got = [r.text for r in C.page_lines(items(spark, [(wide, 50, 760)] + side("right", 320, 6) + side("left", 50, 6))).orderBy("pos").collect()]
    assert got == [wide, *[f"left line number {n} xxxx" for n in range(6)], *[f"right line number {n} xxxx" for n in range(6)]]
    few = [r.text for r in C.page_lines(items(spark, side("left", 50, 3) + side("right", 320, 3))).orderBy("pos").collect()]
    assert few == [f"left line number {n} xxxx right line number {n} xxxx" for n in range(3)]


@pytest.mark.parametrize(
    ("pages", "want"),
    [
        (["The harbour\nwas quiet.\n\nShe counted\ntwice."], [(1, "The harbour was quiet."), (1, "She counted twice.")]),
        (["one.\n\n\n\nTwo\n \nthree"], [(1, "one."), (1, "Two"), (1, "three")]),
        (["the light-\nhouse and an Anglo-\nSaxon well-known face"], [(1, "the lighthouse and an Anglo-Saxon well-known face")]),
        (["", "  \n\n \t", None], []),
        (["one.\r\n\r\nTwo"], [(1, "one."), (1, "Two")]),
        (["It was the best, it was", "the worst of times."], [(1, "It was the best, it was the worst of times.")]),
        (["they reached the light-", "house at dusk."], [(1, "they reached the lighthouse at dusk.")]),
        (["The chapter ended.", "a new one"], [(1, "The chapter ended."), (2, "a new one")]),
        (["it runs on", "and ends.\n\nthen more"], [(1, "it runs on and ends."), (2, "then more")]),
        (["it runs on", "   ", "and ends."], [(1, "it runs on and ends.")]),
        (['"I will not," she said.', "the room"], [(1, '"I will not," she said.'), (2, "the room")]),
        (["he muttered about", '"nothing at all"'], [(1, 'he muttered about "nothing at all"')]),
        (["he muttered about", '"Nothing at all"'], [(1, "he muttered about"), (2, '"Nothing at all"')]),
    ],
)
def test_recognised_paragraphs(spark, pages, want):
    rows = spark.createDataFrame([(1, n + 1, t, 0.9 - n / 10) for n, t in enumerate(pages)], "book_id int, page int, text string, confidence double")
    got = Z.recognised_paragraphs(rows).orderBy("pos").collect()
    assert [(r.page, r.text) for r in got] == want
    if len(want) == 1 and len(pages) == 2:
        assert got[0].confidence == pytest.approx(0.8)


def chapters(spark, rows, count):
    blocks = spark.createDataFrame([(1, n, *r) for n, r in enumerate(rows)], "book_id int, pos int, kind string, level int, text string, page int")
    got = Z.page_chapters(blocks, spark.createDataFrame([(1, count)], "book_id int, page_count int"), "A Book").orderBy("pos").collect()
    assert [r.ord for r in got] == list(range(len(rows)))
    return [(r.block_id, r.chapter_title) for r in got]


def test_chapters_of_pages(spark):
    prose = [("paragraph", None, f"p{n}", n) for n in range(1, 26)]
    got = chapters(spark, prose, 25)
    assert got[0] == ("0:0", "Pages 1-10") and got[10] == ("1:0", "Pages 11-20") and got[24] == ("2:4", "Pages 21-25")
    assert chapters(spark, [("paragraph", None, "x", 21)], 21) == [("0:0", "Page 21")]
    headed = [("paragraph", None, "front", 1), ("heading", 2, "One", 1), ("heading", 3, "deep", 2), ("heading", 2, "Two", 40)]
    assert chapters(spark, headed, 40) == [("0:0", "A Book"), ("1:0", "One"), ("1:1", "One"), ("2:0", "Two")]
    assert chapters(spark, [], 0) == []


@pytest.mark.parametrize(("n", "want"), [(0, []), (5, [(0, 0, 4)]), (6, [(0, 0, 4), (1, 3, 5)]), (8, [(0, 0, 4), (1, 3, 7)]), (9, [(0, 0, 4), (1, 3, 7), (2, 6, 8)])])
def test_overlapping_chunks(spark, n, want):
    units = spark.createDataFrame([(1, k) for k in range(n)], "book_id int, idx int")
    got = O.overlapping(units, 5, 2).groupBy("chunk").agg({"idx": "min", "*": "count"}).orderBy("chunk").collect()
    assert [(r["chunk"], r["min(idx)"], r["min(idx)"] + r["count(1)"] - 1) for r in got] == want
