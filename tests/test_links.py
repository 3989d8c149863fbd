import pytest
from pyspark.sql import functions as F

from inkstream.functions import replies as R
from inkstream.operators import links as K


def one(spark, function, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(function(*[F.col(k) for k in values]).alias("y")).first().y


@pytest.mark.parametrize(
    ("header", "size", "want"),
    [(None, 10, (0, 9)), ("bytes=2-5", 10, (2, 5)), ("bytes=2-", 10, (2, 9)), ("bytes=-3", 10, (7, 9)), ("bytes=-30", 10, (0, 9)), ("bytes=5-99", 10, (5, 9)), ("bytes=10-", 10, None), ("bytes=5-2", 10, None), ("bytes=0-1,3-4", 10, None), ("bytes=-", 10, None), ("bytes=-0", 10, None), (None, 0, None)],
)
def test_byte_range(spark, header, size, want):
    got = one(spark, R.byte_range, h=header, s=size)
    assert (got and (got.start, got.end)) == want


@pytest.mark.parametrize(("line", "share"), [('{"percent": 50}', 0.5), ('{"progress": 0.4}', 0.4), ('{"progress": 40}', 0.4), ('{"frame": 3, "total": 4}', 0.75), ('{"percent": 400}', 1.0), ('{"x": 1}', None), ("frame 3", None), ('{"frame": 3, "total": 0}', None)])
def test_progress_lines(spark, line, share):
    assert one(spark, R.progress_of, x=line) == share


def test_replies(spark):
    frame = 'X: 1\r\nPath: audio.metadata\r\n\r\n{"Metadata":[{"Type":"WordBoundary","Data":{"Offset":10000000,"Duration":5000000,"text":{"Text":"hi"}}},{"Type":"SessionEnd","Data":{"Offset":1}},{"Type":"WordBoundary","Data":{"text":{"Text":"no"}}}]}'
    assert [tuple(x) for x in one(spark, R.spoken_cues, f=frame)] == [(1.0, 1.5, "hi")]
    body = '{"items":[{"id":"PL1","snippet":{"title":" a "},"contentDetails":{"itemCount":3}},{"id":"UUx","snippet":{"title":"b"}},{"id":"PL2","snippet":{"title":" "}},{"id":"wl","snippet":{"title":"c"}}]}'
    assert [tuple(x) for x in one(spark, R.playlists, b=body)] == [("PL1", "a", 3)]
    assert one(spark, R.masked, v="key") == "********" and one(spark, R.masked, v="") == ""
    assert one(spark, R.terms, v="a, b，c ,,") == ["a", "b", "c"]
    assert one(spark, R.unescape, v="&amp;lt; &lt;&#39;") == "&lt; <'"
    assert one(spark, R.plain_arabic, v="أُمّة") == "امه"
    assert one(spark, R.track_code, v="de-AT") == "ger" and one(spark, R.track_code, v="xx") == "und"
    lang = lambda a, b: R.language_of(a, b, ["en", "zh-CN", "de"])
    assert one(spark, lang, a="zh_cn", b="de") == "zh-CN" and one(spark, lang, a="", b="de-AT") == "de" and one(spark, lang, a=None, b="fr") == "en"
    assert one(spark, lambda c: R.renamed(c, "/a/old", "/a/new"), c="/a/old/x") == "/a/new/x" and one(spark, lambda c: R.renamed(c, "/a/old", "/a/new"), c="/a/older") == "/a/older"
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    assert one(spark, lambda c: R.publish_time(c, now), c="2024-01-01T00:10:00Z") is None and one(spark, lambda c: R.publish_time(c, now), c="2024-01-01T00:20:00Z") is not None
    assert one(spark, lambda a, b, c: R.listing(a, b, c, True), a="", b=" ", c="g") == "g" and one(spark, lambda a, b, c: R.listing(a, b, c, False), a="", b="s", c="g") == ""
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "********", "b": "3"})], "o map<string,string>, n map<string,string>")
    assert df.select(R.merged_settings(F.col("o"), F.col("n"))).first()[0] == {"a": "1", "b": "3"}


def test_links(spark):
    blocks = spark.createDataFrame([(1, "0:0", "x"), (1, "0:1", "y")], "book_id int, block_id string, text string")
    segs = spark.createDataFrame([(1, 0, ["0:1", "0:0", "9:9"])], "book_id int, idx int, block_ids array<string>")
    assert [r.text for r in K.blocks_of(segs, blocks, ["book_id", "idx"]).orderBy("place").collect()] == ["y", "x"]
    props = spark.createDataFrame([(1, 0, "0:1", "a"), (1, 0, " ", "b"), (1, 0, "7:7", "c")], "book_id int, chunk int, block_id string, title string")
    chunks = spark.createDataFrame([(1, 0, "0:0")], "book_id int, chunk int, first_block string")
    assert sorted((r.title, r.block_id) for r in K.grounded(props, blocks, chunks).collect()) == [("a", "0:1"), ("b", "0:0")]
    shorts = spark.createDataFrame([(1, 0, "The  One"), (1, 1, "the one "), (1, 2, " "), (1, 3, "Two")], "g int, n int, title string")
    assert [(r.idx, r.n) for r in K.distinct_titles(shorts, "g", "title", "n").orderBy("idx").collect()] == [(0, 0), (1, 3)]
    h = spark.createDataFrame([(1, "a", "IV"), (1, "b", "A long heading")], "book_id int, start_block string, title string")
    p = spark.createDataFrame([(1, "a", "The Storm"), (1, "b", "Short"), (1, " c", "New"), (1, " ", "x")], "book_id int, start_block string, title string")
    assert {r.start_block: r.title for r in K.merged_sections(h, p, K.longer_title).collect()} == {"a": "Chapter IV — The Storm", "b": "A long heading", "c": "New"}


def test_state_links(spark):
    old = spark.createDataFrame([("c1", "t", "tok", "s", True, "err"), ("c2", "t2", "tok2", None, False, "err2")], "channel_id string, title string, refresh_token string, scopes string, auto_upload boolean, error string")
    new = spark.createDataFrame([("c1", "T", "", "S"), ("c3", "N", "n", None)], "channel_id string, title string, refresh_token string, scopes string")
    got = {r.channel_id: tuple(r)[1:] for r in K.connected_channels(old, new).collect()}
    assert got == {"c1": ("T", "tok", "S", True, None), "c2": ("t2", "tok2", None, False, "err2"), "c3": ("N", "n", None, False, None)}
    segs = spark.createDataFrame([(1, 2, "pending", None), (1, 0, "failed", "interrupted by restart"), (1, 1, "failed", "bad"), (2, 0, "complete", None), (2, 1, "queued", None)], "book_id int, idx int, state string, error string")
    assert {r.book_id: r["items"] for r in K.resumable(segs).collect()} == {1: [0, 2]}
    assert K.to_render(segs).count() == 4 and K.to_render(segs, segs.filter("idx = 1").select("book_id", "idx")).count() == 1
    schema = "state string, file string, uploads array<struct<success:boolean,video_id:string>>, key string, made_at int"
    a = spark.createDataFrame([("complete", "f", [(True, "v")], "a", 1), ("complete", "f", [(False, None)], "b", 3), ("complete", "f", None, "c", 2), ("complete", "", None, "d", 0)], schema)
    assert [(r.source, r.key) for r in K.backlog({"shorts": a, "tasks": a.filter("key = 'b'")}).collect()] == [("shorts", "c"), ("shorts", "b"), ("tasks", "b")]
    tasks = spark.createDataFrame([("t", "b:1:4"), ("u", "x")], "task_id string, request_id string")
    listed = spark.createDataFrame([("b:1", 4, " ", "text")], "book_id string, idx int, title string, description string")
    assert {r.task_id: r.has_listing for r in K.shorts_of_tasks(tasks, listed).collect()} == {"t": True, "u": False}
    q = spark.createDataFrame([(1, k, k) for k in range(8)], "queue int, task_id int, arrived int")
    assert [r.status for r in K.admitted(q, 2, 3).orderBy("task_id").collect()] == ["running"] * 2 + ["queued"] * 3 + ["rejected"] * 3
    parts = spark.createDataFrame([(1, "mp3", 24000, 1, 5.0), (1, "mp3", 44100, 2, 5.0), (2, "wav", None, None, 3.0)], "d int, codec string, rate int, channels int, duration double")
    assert {r.d: (r.uniform, r.rate, r.channels) for r in K.same_format(parts, "d").collect()} == {1: (False, 44100, 2), 2: (True, 44100, 1)}
    joined = spark.createDataFrame([(1, 10.3), (2, 3.1)], "d int, duration double")
    assert {r.d: r.flagged for r in K.drift(parts, joined, "d").collect()} == {1: True, 2: False}
    once = spark.createDataFrame([("s", 10), ("t", 1), ("u", 10)], "state string, expires_at int")
    given, left = K.consumed(once, once.filter("state != 'u'"), F.lit(5))
    assert [r.state for r in given.collect()] == ["s"] and [r.state for r in left.collect()] == ["u"]


def test_backlog_of_sources_with_orders_of_their_own(spark):
    schema = "state string, file string, uploads array<struct<success:boolean,video_id:string>>, key string, made_at int, book_id string, idx int, upload_state string"
    rows = [("complete", "f", None, f"{b}{i}", 9 - i, b, i, "processing" if (b, i) == ("b", 1) else None) for b in ("b", "a", "ab") for i in (2, 1, 0)]
    table = spark.createDataFrame(rows, schema)
    got = [(r.source, r.key, r.place) for r in K.backlog({"shorts": table, "tasks": table}, {"shorts": ["book_id", "idx"]}).collect()]
    assert got[:8] == [("shorts", k, n + 1) for n, k in enumerate(["a0", "a1", "a2", "ab0", "ab1", "ab2", "b0", "b2"])]
    assert [k for s, k, _ in got[8:]] == ["a2", "ab2", "b2", "a1", "ab1", "a0", "ab0", "b0"]


def test_predicates_of_tasks(spark):
    say = lambda c: spark.range(1).select(c).first()[0]
    none = F.lit(None).cast("string")
    assert [say(K.standalone(F.lit(x))) for x in ("book:1", "book-ocr:1", "bookish", "", None)] == [False, False, True, True, True]
    assert say(K.busy(none, none, none)) is False and say(K.busy(none, F.lit("pending"), none)) is True
    assert say(K.resumes_upload(F.lit("pending"), none, F.lit(True))) is False and say(K.resumes_upload(F.lit("failed"), F.lit(K.INTERRUPTED_UPLOAD), F.lit(True))) is True and say(K.resumes_upload(none, none, F.lit(False))) is False
