"""Search terms, titles, listings, stored values and proposals against plain Python."""

import ast
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from inkstream.functions import publish as P
from inkstream.functions import titles as T
from inkstream.operators import footage as G
from inkstream.operators import outline as O
from inkstream.operators import proposals as R


def plain_terms(title, chapter, text, amount=8):
    out = [x for x in [title.strip()] if x]
    if chapter.strip() and chapter.strip().lower() != title.strip().lower():
        out.append(chapter.strip())
    counts = {}
    for w in re.findall(r"(?:[^\W\d_]|')+", text.lower()):
        w = w.strip("'")
        if len(w) >= 4 and w not in G.STOPWORDS:
            counts[w] = counts.get(w, 0) + 1
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    if len(ranked) >= 2:
        out.append(f"{ranked[0]} {ranked[1]}")
    for w in ranked:
        if len(out) >= amount:
            break
        if not any(w in t.lower() for t in out):
            out.append(w)
    return out[:amount]


def test_terms(spark):
    rng = random.Random(3)
    words = "river Rivers lantern don't 'quoted' stone stones said would harbour light lighthouse été über ab abc abcd".split()
    rows = [(k, rng.choice(["", "A River", " The Lighthouse "]), rng.choice(["", "a river", "Stones"]), " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for k in range(60)]
    got = spark.createDataFrame(rows, "k int, t string, c string, x string").select("k", G.terms(F.col("t"), F.col("c"), F.col("x")).alias("terms"))
    assert {r.k: r.terms for r in got.collect()} == {k: plain_terms(t, c, x) for k, t, c, x in rows}


@pytest.mark.parametrize(
    ("title", "episode", "want"),
    [
        ("Book — One", 4, "Book - One | Episode 4"),
        ("x" * 60 + " - " + "y" * 60, 4, "x" * 60 + " - " + "y" * 24 + "… | Episode 4"),
        ("  ", 7, "Episode 7"),
        ("Done |  episode 12 ", 3, "Done | episode 12"),
        ("word " * 30, 10, ("word " * 18).rstrip()[:86].rstrip() + "… | Episode 10"),
    ],
)
def test_upload_titles(spark, title, episode, want):
    got = spark.createDataFrame([(title, episode)], "t string, e int").select(P.upload_title(F.col("t"), F.col("e"))).first()[0]
    assert got == want and len(got) <= 100


def test_upload_listing_tags_stop_at_the_first_that_does_not_fit(spark):
    row = spark.createDataFrame([("b" * 300, "#a" * 150, "c" * 20)], "b string, a string, c string").select(P.upload_listing(F.col("b"), F.col("a"), F.col("c"), F.lit(2)).alias("l")).first().l
    assert row.tags == ["b" * 300] and row.description.startswith("c" * 20 + "\n\nFrom ")


@pytest.mark.parametrize("value", ["1", "-3", "1.5", "True", "None", "[1, 2]", "('a', [2.5, None])", "{'k': {'x': (1,)}}", "007", "plain text", "[broken", "'quoted'", "", "1_000", "1e3", "{1, 2}", "b'x'", "[" * 200, None])
def test_stored_values(spark, value):
    got = spark.createDataFrame([(value,)], "v string").select(P.typed(F.col("v")).alias("t")).first().t
    if value is None:
        assert got.kind is None
        return
    try:
        want = ast.literal_eval(value)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        assert (got.kind, json.loads(got.json)) == (("integer", int(value)) if value.isdigit() else ("text", value))
        return
    plainly = lambda x: sorted(x) if isinstance(x, set) else repr(x) if isinstance(x, bytes) else json.loads(json.dumps(x))
    assert json.loads(got.json) == plainly(want)
    assert got.kind == {int: "integer", float: "float", bool: "boolean", type(None): "none", list: "list", tuple: "list", set: "list", dict: "map", str: "string", bytes: "other"}[type(want)]


def test_titles(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert [one(T.speakable_book(lit(x))) for x in ("a/b", "x.PDF", "a_b", "a_b c", "  A  Book ")] == ["", "", "", "a_b c", "A Book"]
    assert one(T.section_name(lit("A Book — An Author — One"), lit("A Book"), lit("An Author"))) == "One"
    assert one(T.section_name(lit("A Book"), lit("A Book"), lit("An Author"))) == "A Book"
    assert one(T.opening_title(lit("A Book"), lit(""), lit("a book"))) == "a book"
    assert one(T.rewritten_title(lit("A Book — One"), lit("A Book"), lit(""), lit("B"), lit("Me"))) == "B — Me — One"
    assert one(T.rewritten_title(lit("Prologue"), lit("A Book"), lit(""), lit("B"), lit("Me"))) is None


@pytest.mark.parametrize(
    ("reply", "sections", "skips"),
    [
        ('[{"start_block_id":" a ","title":" One  two "},{"startBlockId":"a","title":"again"},{"title":"none"},7,null]', [("a", "One two")], []),
        ('{"sections":[{"start_block_id":"b"}],"skip_block_ids":["x"," x ","",3]}', [("b", "")], ["x", "3"]),
        ('{"sections":"no","skipBlockIds":["y"]}', [], ["y"]),
        ("not json", [], []),
        (None, [], []),
        ('{"sections":[{"startBlockId":5,"title":12}]}', [("5", "12")], []),
    ],
)
def test_replies_of_any_shape(spark, reply, sections, skips):
    got = spark.createDataFrame([(reply,)], "r string").select(R.boundaries(F.col("r")).alias("b")).first().b
    assert ([tuple(s) for s in got.sections], got.skips) == (sections, skips)


def test_sections_are_detected_and_fall_back(spark):
    lines = ["Contents", "Chapter 1", "Chapter 2", "Chapter 1"] + ["long words " * 60] * 3 + ["Chapter 2"] + ["other words " * 60] * 3
    blocks = [(b, "ch-0", f"{b}:{k}", k, "heading" if t.startswith(("Chapter", "Contents")) else "paragraph", t) for b in (1, 2) for k, t in enumerate(lines)]
    kept = spark.createDataFrame(blocks, "book_id long, chapter_id string, block_id string, ord long, kind string, text string")
    chapters = spark.createDataFrame([(b, "ch-0", "All") for b in (1, 2)], "book_id long, chapter_id string, title string")

    def propose(view):
        if view["book_id"] == 2:
            raise ValueError("offline")
        return {"sections": [{"start_block_id": "1:5", "title": "A turn"}, {"start_block_id": "1:3", "title": "The start"}, {"start_block_id": "9:9", "title": "x"}], "skip_block_ids": ["1:7", "1:6"]}

    sections, skips = R.detect_sections(kept, chapters, propose)
    got = {(r.book_id, r.start_block): r.title for r in sections.collect()}
    assert {k for k in got if k[0] == 1} == {(1, "1:0"), (1, "1:3"), (1, "1:5"), (1, "1:7")}
    assert got[1, "1:3"] == "Chapter 1 — The start" and got[1, "1:5"] == "A turn" and got[1, "1:0"] == ""
    own = {r.start_block for r in O.skipped(O.outline(kept, chapters)).filter("book_id = 2").collect()}
    assert {r.start_block for r in skips.filter("book_id = 2").collect()} == own and "1:6" in {r.start_block for r in skips.collect()} and "1:7" not in {r.start_block for r in skips.collect()}
    assert {k for k in got if k[0] == 2} == {(2, "2:0"), (2, "2:3"), (2, "2:7")}
