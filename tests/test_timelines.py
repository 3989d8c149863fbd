import pytest
from pyspark.sql import functions as F

from inkstream.operators import cues as Q
from inkstream.operators import layout as L
from inkstream.operators import media as M
from inkstream.operators import narration as N


def test_proportional_cues(spark):
    df = spark.createDataFrame([(1, "Short. A much longer sentence here.", 10.0), (2, " ", 3.0)], "id int, t string, d double")
    got = Q.proportional(df, "id", "t", "d").orderBy("idx").collect()
    assert [r.id for r in got] == [1, 1] and got[0].start == 0 and got[-1].end == 10.0 and got[1].start == got[0].end
    assert got[1].end - got[1].start > got[0].end - got[0].start


def test_offsets_do_not_drift(spark):
    chunks = spark.createDataFrame([(1, k, 7.331) for k in range(50)], "d int, chunk int, duration double")
    cues = spark.createDataFrame([(1, k, 1, 0.25, 6.0, "x") for k in range(50)], "d int, chunk int, idx int, start double, end double, text string")
    got = Q.offset(chunks, cues, "d").orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(1, 51)) and got[-1].start == pytest.approx(49 * 7.331 + 0.25, abs=1e-9)


def test_active_cue_takes_the_later(spark):
    cues = spark.createDataFrame([(1, 1, 0.0, 12.0, "a"), (1, 2, 12.0, 30.0, "b"), (1, 3, 40.0, 41.0, "c")], "d int, idx int, start double, end double, text string")
    times = spark.createDataFrame([(1, t) for t in (0.0, 12.0, 29.9, 35.0, 41.0)], "d int, t double")
    assert {r.t: r.text for r in Q.active(cues, times, "d").collect()} == {0.0: "a", 12.0: "b", 29.9: "b", 41.0: "c"}


def test_srt_document(spark):
    cues = spark.createDataFrame([(1, 7, 1.0, 2.5, "hello"), (1, 9, 3.0, 4.0, "bye")], "d int, idx int, start double, end double, content string")
    assert Q.to_srt(cues, "d").first().srt == "1\n00:00:01,000 --> 00:00:02,500\nhello\n\n2\n00:00:03,000 --> 00:00:04,000\nbye\n"


def test_word_captions(spark):
    words = spark.createDataFrame([(1, k, float(k), k + 0.5, w) for k, w in enumerate("Good day, to you. Bye".split())], "d int, seq int, start double, end double, word string")
    assert [(r.text, r.start, r.end) for r in Q.word_captions(words, "d").orderBy("caption").collect()] == [("Good day,", 0.0, 1.5), ("to you.", 2.0, 3.5), ("Bye", 4.0, 4.5)]


def align(spark, cues, script):
    c = spark.createDataFrame([(1, k, *x) for k, x in enumerate(cues)], "d int, seq int, start double, end double, content string")
    return [(r.start, r.end, r.text) for r in N.aligned(c, spark.createDataFrame([(1, script)], "d int, script string"), "d").orderBy("idx").collect()]


def test_aligned_cues(spark):
    said = [(0.0, 0.5, "Hello"), (0.5, 1.0, "world"), (1.2, 1.6, "Good"), (1.6, 2.0, "bye")]
    assert align(spark, said, "Hello, world. [Good]bye.") == [(0.0, 0.5, "Hello"), (0.5, 1.0, "world"), (1.2, 2.0, "Good bye")]
    assert align(spark, said, "Hello world. Good bye.") == [(0.0, 1.0, "Hello world"), (1.2, 2.0, "Good bye")]
    assert align(spark, said[:1], "Hello. World.") == []
    assert align(spark, said, "Hello wurld. Good bye.") == []


def test_corrected_cues(spark):
    cues = spark.createDataFrame([(1, 0, 0.0, 0.6, "Hello"), (1, 1, 0.6, 1.2, "wrld"), (1, 2, 1.3, 2.0, "Good bye")], "d int, seq int, start double, end double, content string")
    scripts = spark.createDataFrame([(1, "Hello world. Good bye. Extra"), (2, "Alone")], "d int, script string")
    got = [(r.d, r.idx, r.start, r.end, r.text) for r in N.correct_cues(cues, scripts, "d").orderBy("d", "idx").collect()]
    assert got == [(1, 1, 0.0, 1.2, "Hello world"), (1, 2, 1.3, 2.0, "Good bye"), (1, 3, 0.0, 0.0, "Extra"), (2, 1, 0.0, 0.0, "Alone")]


@pytest.mark.parametrize("most", [5, 12, 40, 200])
def test_voice_chunks_lose_nothing(most):
    text = "First one. Second, with 1,000.5 parts; and more!  Third?\n\nA new paragraph 你好。再见！ " + "unbroken" * 8 + " end"
    chunks = N.voice_chunks(text, most)
    assert all(0 < len(c) <= most for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(text.split())
    if most == 200:
        assert len(chunks) == 1
    assert N.voice_chunks(" \n ", most) == []


def test_budgets_and_order(spark):
    items = spark.createDataFrame([(1, k, "ab"[k % 2], float(d)) for k, d in enumerate([9, 3, 20, 4, 8])], "g int, k int, term string, s double")
    assert [r.k for r in M.within_budget(items, "g", "k", "s", 8.0, F.lit(11.0)).orderBy("k").collect()] == [0, 1, 2]
    assert [r.k for r in M.round_robin(items, "g", "term", "k").orderBy("turn").collect()] == [0, 1, 2, 3, 4]
    assert [(r.part, r.start, r.end) for r in M.slices(items.filter("k = 2"), "s", 8.0).orderBy("part").collect()] == [(0, 0.0, 8.0), (1, 8.0, 16.0), (2, 16.0, 20.0)]
    assert M.slices(items, "s", 8.0, first_only=True).count() == 5
    looped = M.loop_to_fill(items.filter("k in (1, 3)"), "g", "k", "s", 15.0).orderBy("at").collect()
    assert [(r.k, r.at) for r in looped] == [(1, 0.0), (3, 3.0), (1, 7.0), (3, 10.0), (1, 14.0)]
    clips = spark.createDataFrame([(1, "a", 0.0, 5.0), (1, "a", 5.0, 2.0), (1, "b", 0.0, 3.0)], "job int, source string, start double, duration double")
    assert [(r.source, r.duration) for r in M.longest_first(clips, "source").orderBy("place").collect()][-1] == ("a", 2.0)


def test_search_replies(spark):
    pexels = '{"videos":[{"id":321,"duration":8,"video_files":[{"link":"l0","width":10,"height":10},{"link":"https://v/1.mp4","width":1080,"height":1920},{"link":"l2","width":1080,"height":1920}]},{"id":4,"duration":2,"video_files":[]}]}'
    pixabay = '{"hits":[{"id":7,"duration":9,"videos":{"large":{"url":"","width":1920,"height":1080},"medium":{"url":"m","width":1280,"height":2000},"small":{"url":"s","width":1200,"height":2000}}}]}'
    coverr = '{"hits":[{"id":"c","duration":5.9,"is_vertical":true,"urls":{"mp4_download":"d"}},{"id":"w","duration":5.9,"is_vertical":false,"urls":{"mp4_download":"d"}},{"id":"","duration":9,"urls":{"mp4_download":"d"}}]}'
    for name, body, want in (("pexels", pexels, ("321", "https://v/1.mp4")), ("pixabay", pixabay, ("7", "m")), ("coverr", coverr, ("c", "d"))):
        df = spark.createDataFrame([(name, "t", body), (name, "t", "not json")], "provider string, term string, body string")
        assert [(r.asset, r.url) for r in M.search_results(df, name, 1080, 1920, 5).collect()] == [want]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>").select(M.cosine(F.col("a"), F.col("b")).alias("c"))
    assert [r.c for r in df.collect()] == [pytest.approx(2**-0.5), 0.0]


def test_layout(spark):
    items = [(1, "Big", 100.0, 700.0, 30.0, 20.0), (1, "Title", 135.0, 700.5, 40.0, 20.0), (1, "light-", 10.0, 650.0, 60.0, 10.0), (1, "house stood", 10.0, 638.0, 60.0, 10.0), (1, "there.", 10.0, 626.0, 60.0, 10.0), (1, "New one.", 10.0, 580.0, 60.0, 10.0), (1, "- 7 -", 50.0, 10.0, 20.0, 10.0)]
    got = L.lines(spark.createDataFrame(items, "page int, text string, x double, y double, width double, font_size double")).orderBy("line")
    assert [r.text for r in got.collect()] == ["Big Title", "light-", "house stood", "there.", "New one.", "- 7 -"]
    placed = got.withColumns({"book_id": F.lit(1), "position_from_top": (F.lit(720.0) - F.col("y")) / 720})
    marked = L.furniture(placed)
    assert {r.text: r.furniture for r in marked.collect() if r.furniture} == {"- 7 -": "page_number"}
    blocks = [(r.kind, r.level, r.text) for r in L.page_blocks(marked).orderBy("pos").collect()]
    assert blocks == [("heading", 1, "Big Title"), ("paragraph", None, "lighthouse stood there."), ("paragraph", None, "New one."), ("page_number", None, "- 7 -")]
    df = spark.createDataFrame([(["Anglo-", "Saxon", "", "x"],)], "t array<string>")
    assert df.select(L.joined(F.col("t"))).first()[0] == "Anglo-Saxon x"


def test_recognition(spark):
    r = spark.createDataFrame([(1, 1, "t", 0.5, None), (1, 2, "u", 0.5, None), (2, 3, "", 0.9, "failed"), (3, 4, "", 0.1, None)], "page int, seq int, text string, confidence double, error string")
    assert sorted((x.page, x.seq) for x in L.best_result(r).collect()) == [(1, 1), (2, 3), (3, 4)]
    pages = spark.createDataFrame([(k,) for k in range(1, 5)], "page int")
    assert sorted(x.page for x in L.to_read(pages, r).collect()) == [2, 4]
    book = lambda df: df.withColumn("book_id", F.lit(1))
    s = L.run_summary(book(pages), book(r)).first()
    assert (s.total, s.done, s.failed, s.attempted) == (4, 3, 1, 4) and s.confidence == pytest.approx(1.1 / 3)
    why = spark.createDataFrame([("x" * 80, 0.9, True), ("x", 0.9, True), ("", 0.9, True), ("x" * 80, 0.1, True), ("", 0.1, False)], "t string, c double, v boolean").select(L.escalation(F.col("t"), F.col("c"), F.col("v")).alias("w"))
    assert [x.w for x in why.collect()] == ["confident", "implausibly_short", "no_text_recognised", "low_confidence", "no_vision_provider"]


def likeness(a, b):
    a, b = a.lower(), b.lower()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j - 1] + 1, row[j] + 1, above + (x != y))
    return 1.0 if not a and not b else 1 - row[-1] / max(len(a), len(b))


def plain_correction(lines, cues):
    out, at = [], 0
    for line in lines:
        if at >= len(cues):
            out.append((0.0, 0.0, line))
            continue
        start, end, heard = cues[at]
        at += 1
        best = likeness(line, heard)
        while heard != line and at < len(cues) and likeness(line, f"{heard} {cues[at][2]}") > best:
            heard, end = f"{heard} {cues[at][2]}", cues[at][1]
            best, at = likeness(line, heard), at + 1
        out.append((start, end, line))
    return out


def test_correction_equals_reading_line_by_line(spark):
    import random

    rng = random.Random(8)
    words = "harbour lantern meadow orchard quarry river stone timber".split()
    scripts, cues, want = [], [], []
    for d in range(40):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 7))]
        heard = []
        for line in lines:
            w = line.split()
            k = rng.randint(0, len(w))
            for part in ([w[:k], w[k:]] if rng.random() < 0.6 else [w]):
                text = " ".join(rng.choice([x, x, x, x[:-1], x + "s"]) for x in part)
                if text and rng.random() < 0.9:
                    heard.append((float(len(heard)), len(heard) + 0.5, text))
        scripts.append((d, ". ".join(lines)))
        cues += [(d, i, *c) for i, c in enumerate(heard)]
        want += [(d, i + 1, *x) for i, x in enumerate(plain_correction(lines, heard))]
    got = N.correct_cues(spark.createDataFrame(cues, "d int, seq int, start double, end double, content string"), spark.createDataFrame(scripts, "d int, script string"), "d")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
