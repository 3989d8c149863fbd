import io
import zipfile

import pytest
from pyspark.sql import functions as F

from inkstream.sources import epub, html, plain


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<h1>A</h1><h3>B</h3><h6>C</h6><p>d</p>", [("heading", 1, "A"), ("heading", 3, "B"), ("heading", 6, "C"), ("paragraph", None, "d")]),
        ("<p>a<br>b &amp;lt; &#233;&nbsp; c</p>", [("paragraph", None, "a b &lt; é c")]),
        ("<head><title>t</title></head><script>var a='<p>x</p>'</script><style>p{}</style>text", [("paragraph", None, "text")]),
        ("<ul><li>a</li><li><p>b</p></li></ul><blockquote><p>q</p><ul><li>r</li></ul></blockquote><pre>c  d</pre>", [("list_item", None, "a"), ("list_item", None, "b"), ("quote", None, "q"), ("quote", None, "r"), ("code", None, "c d")]),
        ("<p>word<a epub:type='noteref' href='#n'>1</a> on</p><aside epub:type='footnote'><p>note</p></aside><p>after</p>", [("paragraph", None, "word on"), ("footnote", None, "note"), ("paragraph", None, "after")]),
        ("a<!-- <p>no</p> -->b<div>unclosed <b>bold", [("paragraph", None, "ab"), ("paragraph", None, "unclosed bold")]),
        ("", []),
        ("</p></div>x", [("paragraph", None, "x")]),
    ],
)
def test_html(page, blocks):
    assert html.parse(page) == blocks


def test_html_table(spark):
    df = spark.createDataFrame([(1, "<p>a</p><p>b</p>"), (2, None)], "page_id long, html string")
    assert [(r.page_id, r.pos, r.text) for r in html.html_blocks(df).orderBy("pos").collect()] == [(1, 0, "a"), (1, 1, "b")]
    assert html.clean_text(" a&nbsp;b\n c ") == "a b c"


def test_text_blocks(spark):
    text = "# One #\r\nline a\rline b\n\nTitle\n===\nx\ny\n---\n\n####### seven\n  \nlast"
    df = spark.createDataFrame([(1, text), (2, "")], "id int, text string")
    got = [(r.kind, r.level, r.text) for r in plain.text_blocks(df, "id").filter("id = 1").orderBy("pos").collect()]
    assert got == [("heading", 1, "One"), ("paragraph", None, "line a line b"), ("heading", 1, "Title"), ("paragraph", None, "x y"), ("paragraph", None, "####### seven"), ("paragraph", None, "last")]


def test_srt(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\nhello\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\n\n3\n00:00:05.000 --> 00:00:06.000\nbye"
    got = plain.parse_srt(spark.createDataFrame([(1, srt)], "id int, srt string"), "id").orderBy("idx").collect()
    assert [(r.idx, r.start, r.end, r.text) for r in got] == [(1, 1.0, 2.5, "hello\nthere"), (3, 5.0, 6.0, "bye")]


def test_recognised(spark):
    rows = [(1, 1, 1, 1, 0, -1.0, ""), (1, 1, 1, 1, 1, 90.0, "Hello"), (1, 1, 1, 1, 2, 120.0, "world"), (1, 1, 1, 2, 1, 50.0, "next"), (1, 1, 2, 1, 1, 0.0, "para"), (1, 2, 1, 1, 1, 80.0, " ")]
    df = spark.createDataFrame(rows, "page_num int, block_num int, par_num int, line_num int, word_num int, conf double, text string")
    words = plain.recognised_words(df)
    assert words.count() == 4
    got = plain.recognised_text(words).first()
    assert got.text == "Hello world\nnext\n\npara" and got.confidence == pytest.approx((0.9 + 1 + 0.5 + 0) / 4)


@pytest.mark.parametrize(("reply", "found"), [('```json\n{"a": 1}\n```', '{"a": 1}'), ('Sure: {"a": {"b": 2}} ok', '{"a": {"b": 2}}'), ("none", None), ("{broken", None)])
def test_json_in(spark, reply, found):
    assert spark.createDataFrame([(reply,)], "r string").select(plain.json_in(F.col("r"))).first()[0] == found


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


BOOK = {
    "META-INF/container.xml": '<container xmlns="c"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>',
    "OPS/p.opf": '<package xmlns="o"><manifest><item id="n" href="nav.xhtml" properties="nav"/><item id="a" href="a%20b.xhtml"/><item id="b" href="t/b.xhtml"/><item id="c" href="c.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="c" linear="no"/></spine></package>',
    "OPS/nav.xhtml": '<html xmlns="h" xmlns:epub="e"><nav epub:type="toc"><ol><li><a href="a%20b.xhtml#x">Alpha</a><ol><li><a href="t/b.xhtml">Beta</a></li></ol></li></ol></nav><nav epub:type="landmarks"><ol><li><a epub:type="copyright" href="t/b.xhtml">c</a></li></ol></nav></html>',
    "OPS/a b.xhtml": "<h2>Head</h2><p>one</p>",
    "OPS/t/b.xhtml": "<p>two</p>",
    "OPS/c.xhtml": "<p>no</p>",
}


def test_epub(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(archive(BOOK))
    (tmp_path / "b.epub").write_bytes(b"PK\x03\x04 broken")
    rows = epub.read_epub(spark, str(tmp_path)).orderBy("ord").collect()
    told = [r for r in rows if r.kind == "unreadable"]
    assert [r.path.rsplit("/", 1)[1] for r in told] == ["b.epub"] and told[0].text and told[0].ord is None
    got = [r for r in rows if r.kind != "unreadable"]
    assert [(r.chapter_id, r.title, r.landmark, r.block_id, r.kind, r.text) for r in got] == [("ch-0", "Beta", "copyright", "0:0", "paragraph", "two"), ("ch-1", "Alpha", None, "1:0", "heading", "Head"), ("ch-1", "Alpha", None, "1:1", "paragraph", "one")]
    assert {r.format for r in epub.book_files(spark, str(tmp_path)).collect()} == {"epub"}
    for bad in ({"../x": "y"}, {"x": "y"}):
        with pytest.raises(epub.Unreadable):
            epub.book(archive(bad))
    assert epub.resolve("OPS/t/b.xhtml", "../c%20d.xhtml#f") == "OPS/c d.xhtml" and not epub.safe_entry("a/../../b")
