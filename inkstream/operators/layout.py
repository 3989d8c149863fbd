"""Positioned text of pages to lines, furniture and blocks; recogniser results per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import trim

#: Fixed values of page geometry.
BASELINE, WORD_GAP, MARGIN, HEAD_CHARS, HEAD_PAGES = 0.4, 0.2, 0.08, 60, 3
HEADING_RATIO, HEADING_CHARS, GAP_RATIO, LEADING, INDENT, FONT_CHANGE, LEVELS = 1.15, 120, 1.35, 1.2, 0.6, 0.15, 6
PAGE_NUMBER = r"(?i)^[\s\-–—\[\](){}|·•.]*(?:pages?\s+|p\.\s*)?(\d{1,4}|(?=[a-z])m{0,4}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))[\s\-–—\[\](){}|·•.]*$"


def _line(items: Column, n: Column) -> Column:
    """A line of its items: their texts from left to right, and the font size that most of its letters have."""

    def told(w: Column, sizes: Column) -> Column:
        def add(s: Column, v: Column) -> Column:
            gap = s["text"].rlike(r"\s$") | v["text"].rlike(r"^\s") | (v["x"] - s["reach"] > v["font_size"] * WORD_GAP)
            return F.struct(F.greatest(s["reach"], v["x"] + v["width"]).alias("reach"), F.concat(s["text"], F.when(gap, " ").otherwise(""), v["text"]).alias("text"))

        zero = F.struct(F.lit(None).cast("double").alias("reach"), F.lit("").alias("text"))
        letters = lambda z: F.aggregate(F.filter(w, lambda v: F.round(v["font_size"], 1) == z), F.lit(0).cast("long"), lambda s, v: s + F.length(trim(v["text"])))
        weights = F.transform(F.array_distinct(sizes), lambda z: F.struct(letters(z).alias("w"), (-F.array_position(sizes, z)).alias("seen"), z.alias("size")))
        return F.struct(
            n.alias("line"),
            trim(F.regexp_replace(F.aggregate(w, zero, add)["text"], r"\s+", " ")).alias("text"),
            F.array_min(F.transform(w, lambda v: v["x"])).alias("left"),
            F.array_max(F.transform(w, lambda v: v["x"] + v["width"])).alias("right"),
            (-F.get(w, 0)["down"]).alias("y"),
            F.array_max(weights)["size"].alias("font_size"),
        )

    across = F.array_sort(F.transform(items, lambda v: F.struct(v["x"].alias("x"), v["down"].alias("down"), v["font_size"].alias("font_size"), v["text"].alias("text"), v["width"].alias("width"))))
    return let(across, lambda w: let(F.transform(w, lambda v: F.round(v["font_size"], 1)), lambda sizes: told(w, sizes)))


def lines(items: DataFrame, page: str | list[str] = "page") -> DataFrame:
    """``page, line, text, left, right, y, font_size`` from items with ``text, x, y, width, font_size``.

    Items go down the page; one that lies within a part of its line's font of
    the line's first item joins it, and the tolerance grows with larger fonts.
    A page's items are brought together once; its lines are made within its row.
    """
    page = [page] if isinstance(page, str) else page
    ok = items.filter((trim(F.col("text")) != "") & (F.col("font_size") > 0))
    item = F.struct((-F.col("y")).alias("down"), "x", "width", "font_size", "text")
    start = F.struct(F.lit(None).cast("double").alias("at"), F.lit(0.0).alias("tol"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("from"))

    def step(s: Column, i: Column) -> Column:
        same = s["at"].isNotNull() & (F.abs(i["down"] - s["at"]) <= s["tol"])
        tol = F.when(same, F.greatest(s["tol"], i["font_size"] * BASELINE)).otherwise(F.greatest(F.lit(1.0), i["font_size"] * BASELINE))
        begun = F.when(same, s["from"]).otherwise(F.concat(s["from"], F.array(s["i"])))
        return F.struct(F.when(same, s["at"]).otherwise(i["down"]).alias("at"), tol.alias("tol"), (s["i"] + 1).alias("i"), begun.alias("from"))

    pages = ok.groupBy(*page).agg(F.array_sort(F.collect_list(item)).alias("i"))

    def cut(of: Column) -> Column:
        at = F.aggregate(of, start, step)["from"]
        return let(at, lambda a: F.transform(a, lambda k, n: _line(F.slice(of, k + 1, F.coalesce(F.get(a, n + 1), F.size(of)) - k), n)))

    return pages.select(*page, F.inline(let(F.col("i"), cut)))


def margin_key(c: Column) -> Column:
    t = trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return trim(F.regexp_replace(F.regexp_replace(t, r"^\d+[\s.·•|—–-]*", ""), r"[\s.·•|—–-]*\d+$", ""))


def furniture(placed: DataFrame, book: str = "book_id") -> DataFrame:
    """Adds ``furniture``: page numbers, and margin lines that come on enough pages; needs ``page, text, position_from_top``."""
    margin = (F.col("position_from_top") <= MARGIN) | (F.col("position_from_top") >= 1 - MARGIN)
    rows = placed.withColumns({"_m": margin, "_k": margin_key(F.col("text"))})
    counts = F.size(F.collect_set(F.when(F.col("_m") & (F.length(trim(F.col("text"))) <= HEAD_CHARS), F.col("page"))).over(Window.partitionBy(book, "_k")))
    pages = F.size(F.collect_set("page").over(Window.partitionBy(book)))
    rows = rows.withColumns({"_n": counts, "_need": F.greatest(F.lit(2), F.least(F.lit(HEAD_PAGES), pages))})
    number = trim(F.col("text")).rlike(PAGE_NUMBER) & trim(F.col("text")).rlike(r"[0-9A-Za-z]")
    kind = F.when(F.col("_m") & number, "page_number").when(F.col("_m") & (F.col("_k") != "") & (F.col("_n") >= F.col("_need")), "running_head")
    return rows.withColumn("furniture", kind).drop("_m", "_k", "_n", "_need")


def body_size(placed: DataFrame, book: str = "book_id") -> DataFrame:
    """The font size that most characters have, without furniture; ties to the smaller."""
    w = placed.filter("furniture is null and font_size > 0").groupBy(book, F.round("font_size", 1).alias("size")).agg(F.sum(F.length("text")).alias("w"))
    return w.groupBy(book).agg(F.max_by("size", F.struct("w", -F.col("size"))).alias("body_size"))


def joined(texts: Column) -> Column:
    """Lines as one text: a hyphen that breaks a word goes, any other holds without a space."""

    def add(acc: Column, line: Column) -> Column:
        wrapped = acc.rlike(r"\p{L}{2}[-‐\x{00AD}]$") & line.rlike(r"^\p{Ll}")
        return (
            F.when(line == "", acc)
            .when(acc == "", line)
            .when(wrapped, F.concat(F.substring(acc, F.lit(1), F.length(acc) - 1), line))
            .when(acc.rlike(r"\S[-‐\x{00AD}]$"), F.concat(acc, line))
            .otherwise(F.concat(acc, F.lit(" "), line))
        )

    return F.aggregate(F.transform(texts, trim), F.lit(""), add)


def page_blocks(placed: DataFrame, book: str = "book_id") -> DataFrame:
    """``book, pos, kind, level, text, page`` from lines with ``furniture``: headings by size, paragraphs by gaps, indents and fonts."""
    rows = placed.filter(trim(F.col("text")) != "").join(body_size(placed, book), book, "left")
    head = F.col("furniture").isNull() & F.coalesce((F.col("body_size") > 0) & (F.col("font_size") >= F.col("body_size") * HEADING_RATIO) & (F.length("text") <= HEADING_CHARS), F.lit(False))
    rows = rows.withColumn("_h", head).withColumn("_kind", F.when(F.col("_h"), "heading").otherwise(F.coalesce("furniture", F.lit("paragraph"))))
    order = Window.partitionBy(book).orderBy("page", F.desc("y"), "left")
    prose = rows.filter("_kind = 'paragraph'").withColumn("_gap", F.lag("y").over(Window.partitionBy(book, "page").orderBy(F.desc("y"), "left")) - F.col("y"))
    default = F.greatest(F.coalesce("body_size", F.lit(0.0)), F.lit(1.0)) * LEADING
    gaps = prose.filter((F.col("_gap") > 0) & (F.col("_gap") < default * 3)).groupBy(book).agg(F.array_sort(F.collect_list("_gap")).alias("g"))
    lead = gaps.select(book, F.element_at("g", F.floor(F.size("g") / 2).cast("int") + 1).alias("_lead"))
    rows = rows.join(lead, book, "left").withColumn("_lead", F.coalesce("_lead", default))
    prev = lambda c: F.lag(c).over(order)
    gap = prev("y") - F.col("y")
    large = F.greatest("font_size", prev("font_size"))
    fresh = (
        (F.col("_kind") != "paragraph")
        | F.coalesce(prev("_kind") != "paragraph", F.lit(True))
        | (prev("page") != F.col("page"))
        | (gap <= 0)
        | (gap > F.col("_lead") * GAP_RATIO)
        | (F.col("left") > prev("left") + F.col("font_size") * INDENT)
        | (F.abs(F.col("font_size") - prev("font_size")) / large > FONT_CHANGE)
    )
    rows = rows.withColumn("_new", fresh.cast("int")).withColumn("pos", (F.sum("_new").over(order) - 1).cast("int"))
    got = rows.groupBy(book, "pos").agg(F.first("_kind").alias("kind"), F.min("page").alias("page"), F.max("font_size").alias("font_size"), F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("d"), "left", "text"))).alias("t"))
    got = got.select(book, "pos", "kind", joined(F.transform("t", lambda x: x["text"])).alias("text"), "page", F.round("font_size", 1).alias("_s"))
    level = F.least(F.dense_rank().over(Window.partitionBy(book, "kind").orderBy(F.desc("_s"))), F.lit(LEVELS))
    return got.withColumn("level", F.when(F.col("kind") == "heading", level)).drop("_s")


def escalation(text: Column, confidence: Column, vision: Column, least: float = 0.7, chars: int = 60) -> Column:
    """Why a page goes to the stronger recogniser, or why it does not; the first reason that holds."""
    n = F.length(trim(F.coalesce(text, F.lit(""))))
    return F.when(~vision, "no_vision_provider").when(n == 0, "no_text_recognised").when(confidence < least, "low_confidence").when(n < chars, "implausibly_short").otherwise("confident")


def best_result(results: DataFrame, page: str = "page") -> DataFrame:
    """The most confident result of each page, the first by ``seq`` on a tie."""
    w = Window.partitionBy(page).orderBy(F.desc("confidence"), "seq")
    return results.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def mean_confidence(c: Column) -> Column:
    ok = F.when(c.isNotNull() & ~F.isnan(c) & (c >= 0), F.least(c, F.lit(1.0)))
    return F.coalesce(F.avg(ok), F.lit(0.0))


def to_read(pages: DataFrame, results: DataFrame, page: str = "page") -> DataFrame:
    """Pages without a result or with a failed one; a blank page that was read is done."""
    done = results.filter("error is null").select(page).distinct()
    return pages.join(done, page, "left_anti")


def run_summary(pages: DataFrame, results: DataFrame, book: str = "book_id") -> DataFrame:
    """``total, done, failed, attempted, confidence`` per book."""
    got = results.groupBy(book).agg(F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed"), mean_confidence(F.when(F.col("error").isNull(), F.col("confidence"))).alias("confidence"))
    total = pages.groupBy(book).agg(F.count("*").alias("total"))
    return total.join(got, book, "left").select(book, "total", F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("failed", F.lit(0)).alias("failed"), (F.coalesce("done", F.lit(0)) + F.coalesce("failed", F.lit(0))).alias("attempted"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
