"""Pages of lists as an interface shows them: totals, filters, orders and what is public."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim

#: A description of so many characters or fewer is a stub.
STUB_CHARS = 160


def page_with_total(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered list, each row with the ``total`` of all rows; pages before the first are the first.

    The total is counted in partitions and read as one value; no window spans the list.
    """
    total = rows.agg(F.count("*").alias("n")).scalar()
    return rows.orderBy(*order).offset(max(0, (number - 1) * size)).limit(size).withColumn("total", total)


def visible(rows: DataFrame, chapter: str | None = None, rule: str | None = None, show: str = "all") -> DataFrame:
    """Review rows of a chapter and a rule, if named, that are dropped, kept or overridden by a user."""
    ok = F.lit(True)
    if chapter:
        ok = ok & (F.col("chapter_id") == chapter)
    if rule:
        ok = ok & (F.col("rule") == rule)
    shown = {"dropped": ~F.col("keep"), "kept": F.col("keep"), "overridden": F.col("source") == "user"}.get(show)
    return rows.filter(ok if shown is None else ok & shown)


def unsure_first(rows: DataFrame, key: str) -> DataFrame:
    """``place`` of each of a key's rows in review order: least confident first, then as they stand."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("confidence", "ord")))


def chapters_seen(rows: DataFrame, key: str) -> DataFrame:
    """The chapters of a key's loaded rows with the title that came first; without a title, their id."""
    seen = rows.filter(F.coalesce("chapter_id", F.lit("")) != "").groupBy(key, "chapter_id")
    return seen.agg(F.min_by(F.coalesce(F.nullif("title", F.lit("")), F.col("chapter_id")), "ord").alias("title"))


def is_stub(description: Column) -> Column:
    """A description that is missing or too short to publish."""
    return F.length(trim(F.coalesce(description, F.lit("")))) <= STUB_CHARS


def panel_totals(segments: DataFrame, key: str) -> DataFrame:
    """``seconds, failed, stubs`` of a key's segments."""
    return segments.groupBy(key).agg(F.sum(F.coalesce("estimated_duration", F.lit(0))).alias("seconds"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(is_stub(F.col("description"))).alias("stubs"))


def public(rows: DataFrame, hidden: list[str], files: dict[str, str], root: str, ids: str | None = None) -> DataFrame:
    """Rows as clients see them: hidden columns go, stored paths become addresses below ``root``, id lists their length."""
    out = rows
    for column, name in files.items():
        path = F.col(column)
        out = out.withColumn(name, F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit(root), F.regexp_replace(path, "^.*/", ""))))
    if ids:
        out = out.withColumn(f"{ids.removesuffix('_ids')}_count", F.coalesce(F.size(ids), F.lit(0)))
    return out.drop(*hidden, *files, *([ids] if ids else []))


def merged_bands(bands: DataFrame, key: str) -> DataFrame:
    """One band of each kind per key, from the uppermost edge to the lowest; ``place`` is the order of kinds as first seen."""
    got = bands.groupBy(key, "kind").agg(F.min("seq").alias("_s"), F.min("y").alias("y"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"))
    return got.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_s"))).drop("_s")


def batches(rows: DataFrame, key: str, order: list[str], size: int = 64) -> DataFrame:
    """``batch`` of each of a key's rows, ``size`` rows at a time."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("batch", F.floor((nth - 1) / size))


def first_source(wanted: DataFrame, choices: list[DataFrame], key: str, item: str) -> DataFrame:
    """Each key's items of the first of several sources that has any for it: ``key, item, source``."""
    every = None
    for n, rows in enumerate(choices):
        part = rows.select(key, item, F.lit(n).alias("source"))
        every = part if every is None else every.unionByName(part)
    every = every.join(wanted.select(key).distinct(), key, "left_semi")
    return every.withColumn("_first", F.min("source").over(Window.partitionBy(key))).filter("source = _first").drop("_first")


def by_name(rows: DataFrame, name: str) -> DataFrame:
    """Rows in the order of their names as readers expect it: accents beside their letter, no matter the case."""
    return rows.orderBy(F.collate(F.lower(F.col(name)), "UNICODE"))


def openings(segments: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """The lines that open a segment: distinct, and none that its first six blocks already say.

    Segments have ``lines`` (an array), blocks ``ord, text``.
    """
    said = lambda c: F.lower(trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    w = Window.partitionBy(key).orderBy("ord")
    first = blocks.select(key, "ord", said(F.col("text")).alias("t")).withColumn("_n", F.row_number().over(w)).filter("_n <= 6 and t != ''").groupBy(key).agg(F.collect_list("t").alias("_said"))
    lines = F.filter(F.transform("lines", lambda x: trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")
    keys = F.transform("_l", said)
    own = F.filter("_l", lambda x, i: (F.array_position(keys, said(x)) == i + 1) & ~F.exists(F.coalesce("_said", F.array().cast("array<string>")), lambda t: F.startswith(t, said(x))))
    return segments.join(first, key, "left").withColumn("_l", lines).withColumn("lines", own).drop("_l", "_said")
