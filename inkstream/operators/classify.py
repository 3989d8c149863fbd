"""Structural classification of blocks, decisions of reviewers, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import repeat_key, trim

#: Thresholds and patterns of the rules.
TOC_CHARS, TOC_RATIO, TOC_BLOCKS, HEAD_CHARS, HEAD_CHAPTERS, REPEATS, REPEAT_CHARS = 90, 0.7, 3, 60, 5, 3, 12
TOC_LEADER = r"(?i)(?:[.·•]\s?){3,}\s*(?:\d{1,4}|[ivxlcdm]{1,7})$"
TOC_GAP = r"(?i)\S(?:\t+[ \t]*|[ ]{2,})(?:\d{1,4}|[ivxlcdm]{1,7})$"
DIGITS = r"^\d{1,4}$"
ROMAN = r"(?i)^m{0,4}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$"
ISBN = r"(?i)\bISBN(?:-1[03])?\b[:\s]*[\dX][\dX\s-]{8,}"
RIGHTS = r"(?i)\ball rights reserved\b"
YEAR = r"(?i)(?:©|\(c\)|\bcopyright\b)[^\n]{0,40}?\b(?:1[5-9]\d{2}|20\d{2})\b"
PUBLISHER = r"(?i)\b(?:no part of this (?:book|publication|work) may be reproduced|printed (?:and bound )?in the (?:united states|usa|uk|united kingdom)|library of congress cataloging|a cip catalogue record|first published (?:in|by)\b)"
AUTHOR = r"(?i)\babout\s+the\s+(?:author|translator|editor|illustrator)s?\b"
FRONT = ["cover", "titlepage", "copyright"]
BACK = ["backmatter", "index", "bibliography", "glossary", "acknowledgements"]
KINDS = {
    "front_matter": "landmark_front_matter",
    "back_matter": "landmark_back_matter",
    "footnote": "footnote_block",
    "page_number": "page_number",
    "running_head": "repeated_running_head",
    "toc_entry": "toc_entry_shape",
}


def toc_shaped(text: Column) -> Column:
    return (text != "") & (F.length(text) <= TOC_CHARS) & ~text.contains("\n") & (text.rlike(TOC_LEADER) | text.rlike(TOC_GAP))


def copyright_notice(text: Column) -> Column:
    # patterns are searched for only where a word of theirs stands
    small = F.lower(text)
    has = lambda *words: F.array_contains(F.array(*[F.contains(small, F.lit(w)) for w in words]), True)
    return (has("isbn") & text.rlike(ISBN)) | (has("all rights") & text.rlike(RIGHTS)) | (has("©", "(c)", "copyright") & text.rlike(YEAR)) | (has("no part of", "printed", "library of", "a cip", "first published") & text.rlike(PUBLISHER))


def page_number_shaped(kind: Column, text: Column) -> Column:
    return (kind == "page_number") | ((kind != "heading") & (text != "") & (text.rlike(DIGITS) | text.rlike(ROMAN)))


def about_author(titled: Column, about: Column | None = None) -> list[tuple[str, Column]]:
    """Columns, one after another, that end with ``_about``: whether a block is about the author.

    A heading opens a span, a heading as high closes it, and so does the end of
    the chapter; a chapter with such a title is about the author as a whole.
    All windows are one chapter's, in order.
    """
    so_far = Window.partitionBy("book_id", "chapter_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    head, level = F.col("kind") == "heading", F.coalesce("level", F.lit(1))
    about = F.col("text").rlike(AUTHOR) if about is None else about
    opened = F.last(F.when(head & about, F.struct("ord", level.alias("level"))), ignorenulls=True).over(so_far)
    closed = F.last(F.when(head & ~about & (level <= F.col("_opened.level")), F.col("ord")), ignorenulls=True).over(so_far)
    inside = F.col("_opened").isNotNull() & F.coalesce(F.col("_closed") < F.col("_opened.ord"), F.lit(True))
    return [("_opened", opened), ("_closed", closed), ("_about", F.coalesce(titled, F.lit(False)) | inside)]


def author_spans(blocks: DataFrame, chapters: DataFrame) -> DataFrame:
    """``book_id, block_id`` of blocks about the author."""
    rows = blocks.join(chapters.select("book_id", "chapter_id", F.col("title").rlike(AUTHOR).alias("_titled")), ["book_id", "chapter_id"], "left")
    for name, value in about_author(F.col("_titled")):
        rows = rows.withColumn(name, value)
    return rows.filter("_about").select("book_id", "block_id")


def classify(blocks: DataFrame, chapters: DataFrame) -> DataFrame:
    """One decision per block: ``book_id, block_id, ord, keep, rule, confidence, source``; the first rule that matches wins."""
    return decided(blocks, chapters).select("book_id", "block_id", "ord", "keep", "rule", "confidence", "source")


def kept_blocks(blocks: DataFrame, chapters: DataFrame) -> DataFrame:
    """The blocks that classification keeps, in one pass over them."""
    return decided(blocks, chapters).filter("keep").select(*blocks.columns)


def decided(blocks: DataFrame, chapters: DataFrame) -> DataFrame:
    """The blocks with their decisions beside them: ``keep, rule, confidence, source``.

    What a rule asks of a text is answered before anything is sorted, so a text
    that nobody reads later goes no further.  All that it needs to know of
    other blocks is counted by windows over a book's blocks, and chapters come
    as one row for each book, so blocks that are dealt by book stay where they are.
    """
    text, norm, kind = trim(F.col("text")), repeat_key(F.col("text")), F.col("kind")
    body = kind != "heading"
    rows = blocks.withColumns({"_t": text, "_n": norm})
    t, n = F.col("_t"), F.col("_n")
    rows = rows.withColumns(
        {
            "_key": F.when(F.length(n) <= 32, n).otherwise(F.concat(F.length(n), F.lit(":"), F.md5(n))),
            "_short": (F.length(t) < HEAD_CHARS) & (n != ""),
            "_long": F.length(n) >= REPEAT_CHARS,
            "_entry": toc_shaped(t),
            "_notice": copyright_notice(t),
            "_digits": t.rlike(DIGITS),
            "_roman": (t != "") & t.rlike(ROMAN),
            "_paged": page_number_shaped(kind, t),
            "_by": ~body & F.col("text").rlike(AUTHOR),
        }
    ).drop("_t", "_n")
    same = Window.partitionBy("book_id", "_key")
    chapter = Window.partitionBy("book_id", "chapter_id")
    rows = rows.withColumns({"_heads": F.size(F.collect_set(F.when(F.col("_short"), F.col("chapter_id"))).over(same)), "_times": F.count("*").over(same)})
    for name, value in about_author(F.lit(False), F.col("_by")):
        rows = rows.withColumn(name, value)
    rows = rows.withColumns(
        {
            "_pages": F.count_if("_paged").over(chapter),
            "_toc": F.count_if((kind == "toc_entry") | F.col("_entry")).over(chapter),
            "_size": F.count("*").over(chapter),
        }
    )
    told = F.struct("chapter_id", F.col("landmark").alias("mark"), F.col("title").rlike(AUTHOR).alias("titled"))
    books = chapters.filter(F.col("landmark").isNotNull() | F.col("title").rlike(AUTHOR)).groupBy("book_id").agg(F.collect_list(told).alias("_chapters"))
    rows = rows.join(books, "book_id", "left")
    own = F.get(F.filter("_chapters", lambda c: c["chapter_id"] == F.col("chapter_id")), 0)
    rows = rows.withColumn("_own", own).withColumns({"_mark": F.col("_own.mark"), "_about": F.col("_about") | F.coalesce("_own.titled", F.lit(False))})
    mark = F.col("_mark")
    declared = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    rules = [
        (mark == "toc", "landmark_toc", 0.98),
        (mark.isin(FRONT), "landmark_front_matter", 0.98),
        (mark.isin(BACK), "landmark_back_matter", 0.95),
        (mark == "frontmatter", "landmark_front_matter", 0.6),
        (kind.isin(*KINDS), declared[kind], 0.95),
        (F.col("_about"), "about_the_author", 0.85),
        (mark.isNull() & (F.col("_size") >= TOC_BLOCKS) & (F.col("_toc") / F.col("_size") > TOC_RATIO), "toc_chapter_shape", 0.8),
        (F.col("_heads") >= HEAD_CHAPTERS, "repeated_running_head", 0.8),
        (F.col("_notice"), "copyright_notice", 0.85),
        (F.col("_entry"), "toc_entry_shape", 0.75),
        (body & F.col("_digits"), "page_number", 0.85),
        (body & F.col("_roman") & (F.col("_pages") >= 2), "page_number", 0.65),
        (body & F.col("_long") & (F.col("_times") >= REPEATS), "boilerplate_repeat", 0.7),
    ]
    rule, confidence = F.lit("default_keep"), F.lit(1.0)
    for cond, name, sure in reversed(rules):
        cond = F.coalesce(cond, F.lit(False))
        rule = F.when(cond, name).otherwise(rule)
        confidence = F.when(cond, F.lit(sure)).otherwise(confidence)
    return rows.select(*blocks.columns, rule.alias("rule"), confidence.alias("confidence"), F.lit("structural").alias("source")).withColumn("keep", F.col("rule") == "default_keep")


def merge_decisions(structural: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides win by block, later ones over earlier; one that is not a user's never beats a user's row; unknown blocks are added."""
    users = Window.partitionBy("book_id", "block_id")
    is_user = F.col("source") == "user"
    latest = overrides.withColumn("_user", F.max(is_user).over(users)).filter(~F.col("_user") | is_user)
    latest = latest.withColumn("_rn", F.row_number().over(users.orderBy(F.desc("seq")))).filter("_rn = 1")
    o = latest.select("book_id", "block_id", F.struct("keep", "rule", "confidence", "source").alias("o"))
    s = structural.select("book_id", "block_id", F.struct("keep", "rule", "confidence", "source").alias("s"))
    both = s.join(o, ["book_id", "block_id"], "full_outer")
    stays = F.col("o").isNull() | (F.coalesce(F.col("s.source"), F.lit("")) == "user") & (F.col("o.source") != "user")
    return both.select("book_id", "block_id", F.when(stays, F.col("s")).otherwise(F.col("o")).alias("d")).select("book_id", "block_id", "d.*")


def summary(decisions: DataFrame) -> DataFrame:
    """``rule, kept, dropped``, most dropped first; decisions with a ``reason`` give each rule's first by book and place."""
    counts = [F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped")]
    if "reason" in decisions.columns:
        counts.append(F.min_by("reason", F.struct("book_id", "ord")).alias("reason"))
    return decisions.groupBy("rule").agg(*counts).orderBy(F.desc("dropped"), F.desc("kept"), "rule")


def kept(blocks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Blocks without a decision against them."""
    return blocks.join(decisions.filter("not keep").select("book_id", "block_id"), ["book_id", "block_id"], "left_anti")


def apply_edits(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Blocks with edited texts where there is an edit; ``edited`` tells whether it differs."""
    e = edits.select("book_id", "block_id", F.col("text").alias("_new"))
    return blocks.join(e, ["book_id", "block_id"], "left").withColumns({"edited": F.coalesce(F.col("_new") != F.col("text"), F.lit(False)), "text": F.coalesce("_new", "text")}).drop("_new")


def review(blocks: DataFrame, decisions: DataFrame, chapters: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows of the review page; classification has seen the unedited text."""
    rows = apply_edits(blocks, edits).join(decisions.drop("ord"), ["book_id", "block_id"], "left").join(chapters.select("book_id", "chapter_id", "title"), ["book_id", "chapter_id"], "left")
    return rows.select("book_id", "block_id", "ord", "text", "edited", "title", F.coalesce("keep", F.lit(True)).alias("keep"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("source", F.lit("structural")).alias("source"))
