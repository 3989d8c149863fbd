"""Table functions from SQL, and stored documents of any shape."""

import pytest
from pyspark.sql import functions as F

from inkstream.functions import documents as X
from inkstream.functions import tables as T
from inkstream.operators import narration as N
from inkstream.sources import html as H
from inkstream.sources import plain as P

SRT = "1\n00:00:01,000 --> 00:00:02,500\nHello\n12\nworld\n2\n00:00:03,000 --> 00:00:04,000\n\n3\n0:00:05.000-->00:00:06,000 X1:2\nBye\n7"


def test_cues_of_lines_in_order(spark):
    T.register(spark)
    rows = [(f, i, line) for f in ("a", "b") for i, line in enumerate(SRT.split("\n"))] + [("c", 0, None), ("c", 1, "no cue")]
    lines = spark.createDataFrame(rows, "file string, n int, line string").repartition(4)
    got = spark.sql("SELECT * FROM srt_cues(TABLE({lines}) PARTITION BY file ORDER BY n)", lines=lines)
    assert [tuple(r) for r in got.orderBy("file", "idx").collect()] == [(f, n, i, s, e, t) for f in ("a", "b") for n, i, s, e, t in ((1, 1, 1.0, 2.5, "Hello\n12\nworld"), (9, 3, 5.0, 6.0, "Bye\n7"))]
    files = spark.createDataFrame([("a", SRT)], "file string, srt string")
    assert sorted(map(tuple, P.parse_srt(files, "file").collect())) == sorted((r.file, r.idx, r.start, r.end, r.text) for r in got.filter("file = 'a'").collect())


def test_texts_and_pages(spark):
    T.register(spark)
    texts = spark.createDataFrame([(1, "x", "One. Two three. " * 40), (2, "y", None), (3, "z", "")], "id int, k string, text string")
    got = spark.sql("SELECT id, k, place, chunk FROM voice_chunks(TABLE({texts}), 200)", texts=texts).orderBy("place").collect()
    assert [r.chunk for r in got] == N.voice_chunks("One. Two three. " * 40, 200) and {(r.id, r.k) for r in got} == {(1, "x")}
    pages = spark.createDataFrame([(1, "<h2>A</h2><p>b<p>c"), (2, None)], "page_id long, html string")
    assert sorted(map(tuple, spark.sql("SELECT * FROM html_blocks(TABLE({p}))", p=pages).collect())) == sorted(map(tuple, H.html_blocks(pages).collect()))


@pytest.mark.parametrize("call", ["voice_chunks(TABLE(SELECT 1 AS id), 5)", "voice_chunks(TABLE(SELECT 'x' AS t), 0)", "voice_chunks(TABLE(SELECT 1 AS place, 'x' AS t))", "html_blocks('x')"])
def test_calls_that_cannot_be_analysed_say_why(spark, call):
    T.register(spark)
    with pytest.raises(Exception, match="must be a string|number of characters|columns of the result|is a table"):
        spark.sql(f"SELECT * FROM {call}").collect()


def test_structures(spark):
    rows = ['{"title":"A","language":3,"chapters":[{"id":"c","level":2},5,null],"blocks":[{"id":1,"chapterId":"c","order":"4","text":"x","more":[1]}]}', "[1]", "no", None, "{}", '{"chapters":{"a":1}}', '{"title":{"a":1}}']
    got = [r.s for r in spark.createDataFrame([(r,) for r in rows], "b string").select(X.structure(F.col("b")).alias("s")).collect()]
    assert got[0].title == "A" and got[0].language == "3" and [(c.id, c.level) for c in got[0].chapters] == [("c", 2)]
    assert [tuple(b) for b in got[0].blocks] == [("1", "c", None, None, 4, "x")]
    assert got[1:4] == [None] * 3 and got[4].chapters == got[5].chapters == got[4].blocks == []


def test_script_data(spark):
    rows = [('{"script":"x","search_terms":["a",1,null],"params":{"z":[1]},"own":5}', '{"script":"y","new":1}'), (None, '{"a":1}'), ("bad", "bad"), ("{}", None)]
    got = spark.createDataFrame(rows, "b string, c string").select(X.script_data(F.col("b")).alias("s"), F.from_json(X.patched_script(F.col("b"), F.col("c")), "map<string,string>").alias("p")).collect()
    assert got[0].s.script == "x" and got[0].s.search_terms == ["a", "1"] and str(got[0].s.params) == '{"z":[1]}' and set(got[0].s.more) == {"own"}
    assert got[0].p == {"script": "y", "search_terms": '["a",1,null]', "params": '{"z":[1]}', "own": "5", "new": "1"}
    assert [r.p for r in got[1:]] == [{"a": "1"}, {}, {}] and got[2].s is None


def test_cues_of_files_in_rows(spark):
    T.register(spark)
    files = spark.createDataFrame([("a", SRT), ("b", SRT), ("c", None), ("d", "no cue")], "file string, srt string").coalesce(1)
    got = spark.sql("SELECT * FROM srt_files(TABLE({files}))", files=files)
    assert [tuple(r) for r in got.orderBy("file", "idx").collect()] == [(f, n, s, e, t) for f in ("a", "b") for n, s, e, t in ((1, 1.0, 2.5, "Hello\n12\nworld"), (3, 5.0, 6.0, "Bye\n7"))]
