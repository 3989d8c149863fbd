"""The test tables read as books, jobs and media.

A book is 50 consecutive documents and a document is a chapter, so a book's
size does not grow with the corpus and no window or fold spans more than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filled
from ..session import attach, spread

CHAPTERS = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """``book_id, chapter_id, block_id, ord, kind, level, text``: one per line that is not blank; a short first line is a heading.

    Documents are dealt by book once, before they become lines; windows, folds
    and counts by book find their rows in place.  Work on lines alone asks for
    them as they lie, not ``dealt``.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.repartition(F.floor(F.col("doc_id") / CHAPTERS)) if dealt else spread(docs)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).filter(filled(F.col("text")))
    nth = F.col("doc_id") % CHAPTERS
    heading = (F.col("pos") == 0) & (F.length("text") <= 60)
    return lines.select(
        F.floor(F.col("doc_id") / CHAPTERS).alias("book_id"),
        F.concat(F.lit("ch-"), nth).alias("chapter_id"),
        F.concat(nth, F.lit(":"), "pos").alias("block_id"),
        (nth * 1000000 + F.col("pos")).alias("ord"),
        F.when(heading, "heading").otherwise("paragraph").alias("kind"),
        F.when(heading, 1).alias("level"),
        "text",
    )


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, chapter_id, title, landmark``: the first chapter of a book is its copyright page, the last its index."""
    nth = F.col("doc_id") % CHAPTERS
    return table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / CHAPTERS).alias("book_id"),
        F.concat(F.lit("ch-"), nth).alias("chapter_id"),
        F.concat(F.lit("Chapter "), nth).alias("title"),
        F.when(nth == 0, "copyright").when(nth == CHAPTERS - 1, "index").alias("landmark"),
    )


#: Every so many-th place, with this rest, is a block that its book declares to be of a kind.
DECLARED = [(17, 3, "footnote"), (19, 4, "toc_entry"), (23, 5, "running_head"), (29, 6, "page_number"), (31, 7, "front_matter"), (37, 8, "back_matter")]


def declared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks with declared kinds and chapters with every landmark; three chapters of a book are about its author, in whole or in part."""
    nth, pos = F.floor(F.col("ord") / 1000000), F.col("ord") % 1000000
    about = nth.isin(4, 6) & (pos == 0)
    kind = F.when(nth.isin(4, 6) & pos.isin(0, 5), "heading")
    for every, rest, name in DECLARED:
        kind = kind.when((F.col("kind") != "heading") & (F.col("ord") % every == rest), name)
    level = F.when(about, 1).when((nth == 4) & (pos == 5), 1).when((nth == 6) & (pos == 5), 2).otherwise(F.col("level"))
    rows = blocks(spark, sf_dir).withColumns({"kind": kind.otherwise(F.col("kind")), "level": level, "text": F.when(about, "About the Author").otherwise(F.col("text"))})
    marked = F.when(F.col("chapter_id") == "ch-1", "toc").when(F.col("chapter_id") == "ch-2", "frontmatter").otherwise(F.col("landmark"))
    title = F.when(F.col("chapter_id") == "ch-3", "About the Translators").otherwise(F.col("title"))
    return rows, chapters(spark, sf_dir).withColumns({"landmark": marked, "title": title})


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer decisions: a labelled document's first line stays if its quality is good and it is not toxic."""
    nth = F.col("doc_id") % CHAPTERS
    return table(spark, sf_dir, "labels").select(
        F.floor(F.col("doc_id") / CHAPTERS).alias("book_id"),
        F.concat(nth, F.lit(":0")).alias("block_id"),
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("keep"),
        F.lit("user").alias("source"),
        F.lit("user_override").alias("rule"),
        F.lit(1.0).alias("confidence"),
        F.col("doc_id").alias("seq"),
    )


def edits(blocks: DataFrame) -> DataFrame:
    """Every tenth block's text with a mark in front."""
    return blocks.filter(F.col("ord") % 10 == 0).select("book_id", "block_id", F.concat(F.lit("* "), "text").alias("text"))


#: Order status as the state of a segment; a book is an order, a segment a line.
SEGMENT_STATES = {"N": "complete", "A": "failed", "R": "rendering"}


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, idx, state, task_id``."""
    state = F.create_map(*[F.lit(x) for kv in SEGMENT_STATES.items() for x in kv])[F.col("l_returnflag")]
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("idx"), F.when(F.col("l_quantity") <= 5, "queued").when(F.col("l_quantity") >= 48, "bogus").otherwise(state).alias("state"), F.col("l_partkey").alias("task_id"), F.col("l_extendedprice").alias("seconds"))
