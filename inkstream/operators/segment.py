"""Books into segments, and chapters into chunks for short pieces, by folds over a book's blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import spoken_seconds, trim, word_count

PREFERRED = 0.6


def measured(blocks: DataFrame, wpm: int = 150) -> DataFrame:
    """Blocks with ``seconds`` and ``words``; blocks that bring both have been measured, and stay as they are."""
    if {"seconds", "words"} <= set(blocks.columns):
        return blocks
    return blocks.withColumns({"seconds": spoken_seconds(F.col("text"), wpm), "words": word_count(F.col("text"))})


def _cuts(mode: str, target: float, most: float):
    """A fold over blocks in order that collects where segments begin; text never enters the state."""
    zero = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0.0).alias("open"), F.lit(0).alias("heads"), F.lit(0.0).alias("head_s"), F.lit("").alias("chapter"), F.array().cast("array<int>").alias("cuts")
    )

    def step(s: Column, b: Column) -> Column:
        some = s["i"] > s["start"]
        changed = s["chapter"] != b["chapter_id"]
        over = s["open"] + b["seconds"] > most
        if mode == "chapter":
            close = changed | over
        else:
            close = over | (s["open"] >= target) | (changed & (s["open"] >= target * PREFERRED))
        # headings at the end move on; nothing closes around headings alone
        close = some & close & (s["heads"] < s["i"] - s["start"])
        cut = s["i"] - s["heads"]
        open_s = F.when(close, s["head_s"]).otherwise(s["open"])
        return F.struct(
            (s["i"] + 1).alias("i"),
            F.when(close, cut).otherwise(s["start"]).alias("start"),
            (open_s + b["seconds"]).alias("open"),
            F.when(b["heading"], s["heads"] + 1).otherwise(0).alias("heads"),
            F.when(b["heading"], s["head_s"] + b["seconds"]).otherwise(0.0).alias("head_s"),
            b["chapter_id"].alias("chapter"),
            F.when(close, F.concat(s["cuts"], F.array(cut))).otherwise(s["cuts"]).alias("cuts"),
        )

    return zero, step


def _folded(kept: DataFrame, mode: str, target: float, most: float, wpm: int) -> DataFrame:
    """``book_id, b, cuts``: a book's measured blocks in order, with the text of headings alone, and where segments after the first begin."""
    heading = F.col("kind") == "heading"
    block = F.struct("ord", "block_id", "chapter_id", "seconds", "words", heading.alias("heading"), F.when(heading, trim(F.col("text"))).alias("head"))
    books = measured(kept, wpm).select("book_id", block.alias("b")).groupBy("book_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    zero, step = _cuts(mode, target, most)
    return books.select("book_id", "b", F.aggregate("b", zero, step)["cuts"].alias("cuts"))


def _parts(cuts: Column, blocks: Column) -> Column:
    """A book's blocks, an array for each segment."""
    bounds = F.array_distinct(F.concat(F.array(F.lit(0)), cuts, F.array(F.size(blocks))))
    return let(bounds, lambda at: F.transform(F.slice(at, 2, F.size(at)), lambda to, k: F.slice(blocks, F.get(at, k) + 1, to - F.get(at, k))))


def segment_of_block(kept: DataFrame, mode: str = "duration", target: float = 900, most: float = 1500, wpm: int = 150) -> DataFrame:
    """``book_id, block_id, idx`` and the block's measures: the segment of every kept block."""
    parts = _folded(kept, mode, target, most, wpm).select("book_id", F.posexplode(_parts(F.col("cuts"), F.col("b"))).alias("idx", "part"))
    return parts.select("book_id", "idx", F.inline("part")).drop("head")


def plan_segments(kept: DataFrame, chapters: DataFrame, mode: str = "duration", target: float = 900, most: float = 1500, wpm: int = 150) -> DataFrame:
    """Segments with title, duration, words and chapters; a title is the first heading or the chapter with a part number.

    Sums are taken over the arrays of a book's row; only segments leave it.
    """
    parts = _folded(kept, mode, target, most, wpm).select("book_id", F.posexplode(_parts(F.col("cuts"), F.col("b"))).alias("idx", "part"))
    total = lambda name, zero: F.aggregate("part", zero, lambda s, x: s + x[name])
    first, last = F.get("part", 0), F.element_at("part", -1)
    segs = parts.select(
        "book_id",
        "idx",
        first["block_id"].alias("first_block"),
        first["chapter_id"].alias("chapter_id"),
        first["head"].alias("head"),
        last["block_id"].alias("last_block"),
        F.size("part").cast("long").alias("n_blocks"),
        F.round(F.round(total("seconds", F.lit(0.0)), 6)).cast("long").alias("estimated_duration"),
        total("words", F.lit(0).cast("long")).alias("word_count"),
        F.size(F.array_distinct(F.transform("part", lambda x: x["chapter_id"]))).cast("long").alias("n_chapters"),
    )
    segs = segs.withColumn("part", F.row_number().over(Window.partitionBy("book_id", "chapter_id").orderBy("idx")))
    named = segs.join(chapters.select("book_id", "chapter_id", "title"), ["book_id", "chapter_id"], "left")
    default = F.concat(F.coalesce(F.nullif(trim(F.col("title")), F.lit("")), F.lit("Segment")), F.lit(" (part "), F.col("part"), F.lit(")"))
    return named.select("book_id", "idx", F.coalesce(F.nullif("head", F.lit("")), default).alias("title"), "first_block", "last_block", "n_blocks", "estimated_duration", "word_count", "n_chapters")


def short_chunks(kept: DataFrame, chapters: DataFrame, target: int = 900, most: int = 1400) -> DataFrame:
    """``book_id, idx, title, first_block, last_block, n_blocks, words``: chapter-aware passages for short pieces."""
    named = kept.join(chapters.select("book_id", "chapter_id", "title"), ["book_id", "chapter_id"], "left")
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif(F.substring("text", 1, 80), F.lit("")), F.lit("Untitled"))
    rows = named.select("book_id", F.struct("ord", "block_id", title.alias("title"), word_count(F.col("text")).alias("words")).alias("b"))
    chunk = "array<struct<title:string,first:string,last:string,n:int,words:bigint>>"
    zero = F.array().cast(chunk)

    def step(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        changed = last["title"] != b["title"]
        flush = (changed & (last["words"] >= min(200, target * 0.35))) | (last["words"] + b["words"] > most) | ((last["words"] >= target) & ~changed & (b["words"] > 0))
        fresh = F.struct(b["title"].alias("title"), b["block_id"].alias("first"), b["block_id"].alias("last"), F.lit(1).alias("n"), b["words"].alias("words"))
        grown = F.struct(F.when(changed, F.concat(last["title"], F.lit(" / "), b["title"])).otherwise(last["title"]).alias("title"), last["first"].alias("first"), b["block_id"].alias("last"), (last["n"] + 1).alias("n"), (last["words"] + b["words"]).alias("words"))
        return F.when(last.isNull() | flush, F.concat(acc, F.array(fresh))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown)))

    books = rows.groupBy("book_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    out = books.select("book_id", F.posexplode(F.aggregate("b", zero, step)).alias("idx", "c"))
    return out.select("book_id", "idx", F.col("c.title").alias("title"), F.col("c.first").alias("first_block"), F.col("c.last").alias("last_block"), F.col("c.n").alias("n_blocks"), F.col("c.words").alias("words"))


def spread(chunks: DataFrame, most: int = 12) -> DataFrame:
    """An even choice of a book's chunks; of eight or more the last tenth is left out."""
    k = max(1, min(30, int(most)))
    n = F.count("*").over(Window.partitionBy("book_id"))
    rows = chunks.withColumn("_n", n).withColumn("_m", F.when((F.col("_n") >= 8) & (F.col("_n") > k), F.col("_n") - F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.1))).otherwise(F.col("_n")))
    i = F.sequence(F.lit(0), F.lit(k - 1))
    picks = F.transform(i, lambda x: F.floor(x * (F.col("_m") - 1) / max(k - 1, 1) + F.lit(0.5)).cast("int"))
    every = (F.col("_m") <= k) & (F.col("idx") < F.col("_m"))
    return rows.filter(every | ((F.col("_m") > k) & F.array_contains(picks, F.col("idx")))).drop("_n", "_m")
