"""Plain-text sources: books in Markdown-like text, subtitles, recogniser tables, JSON in replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import srt_seconds, strip_fence, trim


def book_format(content: Column, name: Column) -> Column:
    """From the first bytes, else from the extension."""
    head = F.hex(F.substring(content, 1, 4))
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(head == "504B0304", "epub").when(head == "25504446", "pdf").when(ext.isin("epub", "pdf"), ext).otherwise("text")


def text_blocks(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, pos, kind, level, text``: headings of both kinds, and paragraphs of lines up to a blank one."""
    lines = texts.select(key, F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    t = trim(F.col("line"))
    lines = lines.withColumns({"t": t, "atx": F.length(F.regexp_extract(t, r"^(#{1,6})\s+\S", 1))})
    rule = F.when(F.col("t").rlike("^=+$"), 1).when(F.col("t").rlike("^-+$"), 2)
    plain = (F.col("t") != "") & (F.col("atx") == 0)
    lines = lines.withColumns({"rule": rule, "plain": plain & rule.isNull()})
    # an underline makes a heading of exactly one pending line
    alone = F.col("plain") & ~F.coalesce(F.lag("plain").over(w), F.lit(False))
    level = F.when(F.col("atx") > 0, F.col("atx")).when(alone & F.lead("rule").over(w).isNotNull(), F.lead("rule").over(w))
    lines = lines.withColumn("level", level)
    body = F.col("plain") & F.col("level").isNull()
    starts = F.col("level").isNotNull() | (body & ~F.coalesce(F.lag(body).over(w), F.lit(False)))
    lines = lines.withColumns({"body": body, "starts": starts})
    lines = lines.withColumn("unit", F.sum(F.col("starts").cast("int")).over(w)).filter(F.col("body") | F.col("level").isNotNull())
    parts = lines.groupBy(key, "unit").agg(F.max("level").alias("level"), F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["t"]), " ")
    clean = F.when(F.col("level").isNotNull(), trim(F.regexp_replace(joined, r"^#{1,6}\s+|\s+#+$", ""))).otherwise(joined)
    return parts.select(key, (F.col("unit") - 1).cast("int").alias("pos"), F.when(F.col("level").isNotNull(), "heading").otherwise("paragraph").alias("kind"), "level", clean.alias("text"))


def text_chapters(blocks: DataFrame, key: str, fallback: Column) -> DataFrame:
    """Blocks of :func:`text_blocks` in chapters: ``key, chapter_id, title, chapter_level, block_id, ord`` and the block.

    The shallowest level of heading that a book has begins its chapters; what
    stands before the first is a chapter named ``fallback``.
    """
    book = Window.partitionBy(key)
    w = book.orderBy("pos")
    begins = F.coalesce((F.col("kind") == "heading") & (F.col("level") == F.col("_top")), F.lit(False))
    rows = blocks.withColumn("_title", fallback).withColumn("_top", F.min(F.when(F.col("kind") == "heading", F.col("level"))).over(book)).withColumn("_begins", begins)
    early = F.first("_begins").over(w)  # whether the book begins with a chapter
    nth = F.sum(F.col("_begins").cast("int")).over(w) - F.when(early, 1).otherwise(0)
    rows = rows.withColumns({"chapter": nth, "ord": F.row_number().over(w) - 1})
    inner = Window.partitionBy(key, "chapter").orderBy("pos")
    first = F.first(F.struct("_begins", "text", "level")).over(inner)
    rows = rows.withColumns({"_f": first, "_n": F.row_number().over(inner) - 1})
    return rows.select(
        key,
        F.concat(F.lit("ch-"), "chapter").alias("chapter_id"),
        F.when(F.col("_f._begins"), F.col("_f.text")).otherwise(F.col("_title")).alias("title"),
        F.when(F.col("_f._begins"), F.col("_f.level")).otherwise(1).alias("chapter_level"),
        F.concat("chapter", F.lit(":"), "_n").alias("block_id"),
        "ord",
        "kind",
        "level",
        "text",
    )


def parse_srt(files: DataFrame, key: str, text: str = "srt") -> DataFrame:
    """``key, idx, start, end, text``: a timing line begins a cue even without a blank line; cues without text keep their number and go."""
    timing = r"(\d+:\d+:\d+[,.]\d+)\s*-->\s*(\d+:\d+:\d+[,.]\d+)"
    lines = files.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("is_time", F.col("line").rlike(timing)).withColumn("idx", F.sum(F.col("is_time").cast("int")).over(w)).withColumn("numbers_next", F.coalesce(F.lead("is_time").over(w), F.lit(False)) & trim(F.col("line")).rlike(r"^\d+$"))
    cue = lines.filter("idx > 0").groupBy(key, "idx").agg(
        F.max(F.when(F.col("is_time"), srt_seconds(F.regexp_extract("line", timing, 1)))).alias("start"),
        F.max(F.when(F.col("is_time"), srt_seconds(F.regexp_extract("line", timing, 2)))).alias("end"),
        F.array_sort(F.collect_list(F.when(~F.col("is_time") & ~F.col("numbers_next") & (trim(F.col("line")) != ""), F.struct("pos", trim(F.col("line")).alias("t"))))).alias("p"),
    )
    return cue.select(key, "idx", "start", "end", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text")).filter("text != ''")


def recognised_words(rows: DataFrame) -> DataFrame:
    """Words of a recogniser's table: no empty text, no structural rows, confidence from 0 to 1."""
    ok = rows.filter((trim(F.col("text")) != "") & (F.col("conf") >= 0))
    return ok.withColumn("confidence", F.least(F.greatest(F.col("conf") / 100.0, F.lit(0.0)), F.lit(1.0)))


def recognised_text(words: DataFrame, key: str = "page_num") -> DataFrame:
    """Words joined by spaces, lines by line breaks, paragraphs and blocks by blank lines."""
    order = ["block_num", "par_num", "line_num", "word_num"]
    w = Window.partitionBy(key).orderBy(*order, trim(F.col("text")))
    gap = (
        F.when(F.lag("block_num").over(w).isNull(), "")
        .when((F.lag("block_num").over(w) != F.col("block_num")) | (F.lag("par_num").over(w) != F.col("par_num")), "\n\n")
        .when(F.lag("line_num").over(w) != F.col("line_num"), "\n")
        .otherwise(" ")
    )
    parts = words.withColumns({"piece": F.concat(gap, trim(F.col("text"))), "nth": F.row_number().over(w)})
    got = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", "piece"))).alias("p"), F.avg("confidence").alias("confidence"))
    return got.select(key, F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"), "confidence")


def json_in(c: Column, opener: str = "{") -> Column:
    """The JSON of a reply: without a fence if that parses, else from the first opener to the last closer; else null."""
    closer = {"{": "}", "[": "]"}[opener]
    whole = strip_fence(c)
    a, b = F.instr(whole, opener), F.length(whole) - F.instr(F.reverse(whole), closer) + 1
    inner = F.when((a > 0) & (b >= a), F.substring(whole, a, b - a + 1))
    return F.when(F.try_parse_json(whole).isNotNull() & F.substring(whole, 1, 1).isin("{", "["), whole).when(F.try_parse_json(inner).isNotNull(), inner)
