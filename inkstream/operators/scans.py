"""Recognised and laid-out pages as paragraphs and chapters of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim
from .layout import joined

#: Pages of a chapter without headings; ends and beginnings of sentences.
BAND = 10
CLOSED = r"[.!?…。！？][\"'”’»)\]]*$"
RUNS_ON = r"^[\"'“‘«(\[]*\p{Ll}"


def runs_on(before: Column, after: Column) -> Column:
    """Whether a paragraph goes on with the next page: no sentence ends, and small letters follow; never with blanks or nulls."""
    b, a = trim(before), trim(after)
    return F.coalesce((b != "") & ~b.rlike(CLOSED) & a.rlike(RUNS_ON), F.lit(False))


def recognised_paragraphs(pages: DataFrame, book: str = "book_id") -> DataFrame:
    """``book, pos, page, text, confidence`` from pages with ``page, text, confidence``.

    Blank lines part paragraphs, broken words are healed, and a page's first
    paragraph may go on with the last one before it, over blank pages too.  A
    paragraph belongs to the page it begins on and has the least confidence of
    its parts; null and blank pages have none.
    """
    text = F.regexp_replace("text", r"\r\n?", "\n")
    parts = pages.select(book, "page", "confidence", F.posexplode(F.filter(F.split(text, r"\n\s*\n"), lambda p: trim(p) != "")).alias("nth", "part"))
    order = Window.partitionBy(book).orderBy("page", "nth")
    fresh = ~((F.col("nth") == 0) & runs_on(F.lag("part").over(order), F.col("part")))
    rows = parts.withColumn("_new", fresh.cast("int")).withColumn("pos", (F.sum("_new").over(order) - 1).cast("int"))
    whole = rows.groupBy(book, "pos").agg(F.min("page").alias("page"), F.array_sort(F.collect_list(F.struct("page", "nth", "part"))).alias("p"), F.min("confidence").alias("confidence"))
    lines = F.flatten(F.transform("p", lambda x: F.split(x["part"], "\n")))
    return whole.select(book, "pos", "page", joined(lines).alias("text"), "confidence")


def page_chapters(blocks: DataFrame, pages: DataFrame, title: str, book: str = "book_id") -> DataFrame:
    """Adds ``chapter_id, block_id, ord, chapter_title`` to ``pos, kind, level, text, page``.

    Chapters begin at the shallowest headings of a book; a book without any is
    cut every ten pages, and such chapters are named by their pages.  What
    stands before the first heading is a chapter named ``title``.  ``pages``
    holds ``page_count`` per book.
    """
    whole, order = Window.partitionBy(book), Window.partitionBy(book).orderBy("pos")
    heads = F.col("kind") == "heading"
    rows = blocks.join(pages.select(book, "page_count"), book, "left").withColumn("_level", F.min(F.when(heads, F.coalesce("level", F.lit(1)))).over(whole))
    band = F.floor(F.greatest(F.col("page") - 1, F.lit(0)) / BAND)
    rows = rows.withColumns({"_band": band, "_first": F.row_number().over(order) == 1})
    begins = F.when(F.col("_level").isNull(), F.col("_band") != F.lag("_band").over(order)).otherwise(heads & (F.coalesce("level", F.lit(1)) == F.col("_level")))
    first = F.col("_band") * BAND + 1
    last = F.least(first + BAND - 1, F.greatest(first, F.coalesce("page_count", F.lit(0))))
    named = F.when(F.col("_level").isNull(), F.when(first == last, F.concat(F.lit("Page "), first)).otherwise(F.concat(F.lit("Pages "), first, F.lit("-"), last))).when(F.col("_begins"), F.nullif(F.col("text"), F.lit("")))
    rows = rows.withColumn("_begins", F.coalesce(begins, F.lit(False)))
    rows = rows.withColumns({"_n": (F.sum((F.col("_begins") | F.col("_first")).cast("int")).over(order) - 1), "_title": F.coalesce(named, F.lit(title)), "ord": F.row_number().over(order) - 1})
    inside = Window.partitionBy(book, "_n").orderBy("pos")
    out = {"chapter_id": F.concat(F.lit("ch-"), "_n"), "block_id": F.concat("_n", F.lit(":"), F.row_number().over(inside) - 1), "chapter_title": F.first("_title").over(inside)}
    return rows.withColumns(out).select(*blocks.columns, *out, "ord")
