"""Reading order of pages whose text stands in two columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import layout

#: A line that spans, how many may, how wide a gutter is, and the lines on each side of it.
SPANNING, SPANNING_SHARE, GUTTER, SIDE_LINES = 0.66, 0.35, 0.04, 4


def gutter(spans: DataFrame, page: str = "page") -> DataFrame:
    """``page, gutter_start, gutter_end`` of pages in two columns, from spans with ``left, right``.

    The gutter is the widest uncovered stretch whose centre lies in the middle
    half of the text, the leftmost of equals; lines across the page do not
    cover it.  Pages with too few lines on a side, too many lines across or too
    narrow a gutter have none, and so have pages of null or empty spans.  All
    windows are of one page, so there is one exchange.
    """
    whole = Window.partitionBy(page)
    width = F.col("_hi") - F.col("_lo")
    rows = spans.select(page, "left", "right").filter("right > left")
    rows = rows.withColumns({"_n": F.count("*").over(whole), "_lo": F.min("left").over(whole), "_hi": F.max("right").over(whole)})
    rows = rows.filter(F.col("right") - F.col("left") <= width * SPANNING).withColumn("_narrow", F.count("*").over(whole))
    rows = rows.filter((F.col("_narrow") >= 2 * SIDE_LINES) & (F.col("_n") - F.col("_narrow") <= F.col("_n") * SPANNING_SHARE))
    rows = rows.withColumn("_to", F.max("right").over(whole.orderBy("left").rowsBetween(Window.unboundedPreceding, -1)))
    centre = (F.col("_to") + F.col("left")) / 2 - F.col("_lo")
    free = (F.col("left") > F.col("_to")) & centre.between(width * 0.25, width * 0.75)
    gap = F.struct((F.col("left") - F.col("_to")).alias("w"), (-F.col("left")).alias("_"), F.col("_to").alias("start"), F.col("left").alias("end"))
    rows = rows.withColumn("_gap", F.max(F.when(free, gap)).over(whole)).filter(F.col("_gap.w") >= width * GUTTER)
    sides = rows.groupBy(page).agg(F.first("_gap").alias("g"), F.count_if(F.col("right") <= F.col("_gap.start")).alias("l"), F.count_if(F.col("left") >= F.col("_gap.end")).alias("r"))
    return sides.filter((F.col("l") >= SIDE_LINES) & (F.col("r") >= SIDE_LINES)).select(page, F.col("g.start").alias("gutter_start"), F.col("g.end").alias("gutter_end"))


def reading_order(placed: DataFrame, page: str = "page", ties: tuple[str, ...] = ("text",)) -> DataFrame:
    """Adds ``pos`` from 0: down the page, and between lines that cross the gutter the left column before the right.

    Needs ``left, right, y``; lines of equal place follow ``ties``.
    """
    rows = placed.join(gutter(placed, page), page, "left")
    across = F.coalesce((F.col("left") < F.col("gutter_end")) & (F.col("right") > F.col("gutter_start")), F.lit(False))
    part = F.when(F.col("gutter_start").isNull() | across, 0).when(F.col("right") <= F.col("gutter_start"), 1).otherwise(2)
    down = [F.desc("y"), F.col("left"), F.col("right"), *map(F.col, ties)]
    rows = rows.withColumns({"_part": part, "_band": F.sum(across.cast("int")).over(Window.partitionBy(page).orderBy(*down).rowsBetween(Window.unboundedPreceding, 0))})
    pos = F.row_number().over(Window.partitionBy(page).orderBy("_band", "_part", *down)) - 1
    return rows.withColumn("pos", pos).drop("_band", "_part", "gutter_start", "gutter_end")


def page_lines(items: DataFrame, page: str = "page") -> DataFrame:
    """``page, pos, text, left, right, y, font_size``: items as lines in reading order.

    Columns that share baselines are parted before lines are made, if both
    sides of the gutter have baselines enough; items across it are lines of
    their own.
    """
    end = F.col("x") + F.col("width")
    rows = items.join(gutter(items.select(page, F.col("x").alias("left"), end.alias("right")), page), page, "left")
    before, after = end <= F.col("gutter_start"), F.col("x") >= F.col("gutter_end")
    distinct: Column = F.floor(F.col("y") + 0.5)
    whole = Window.partitionBy(page)
    baselines = lambda side: F.size(F.collect_set(F.when(side, distinct)).over(whole))
    columns = (baselines(before) >= SIDE_LINES) & (baselines(after) >= SIDE_LINES)
    rows = rows.withColumn("side", F.when(columns & before, 0).when(columns & after, 1).otherwise(2))
    return reading_order(layout.lines(rows, [page, "side"]), page, ("side", "line")).select(page, "pos", "text", "left", "right", "y", "font_size")
