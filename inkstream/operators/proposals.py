"""Sections that somebody proposes for a book, held against the book and its own headings."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_of_each, trim
from ..session import written
from . import links as K
from . import outline as O

TITLE_CHARS = 120
#: Units that a proposer sees at once, and those that two of its views share: fixed values.
VIEW, SHARED = 100, 8
#: From a view of a book (``book_id, chunk, chunks, total_seconds, units``) to a reply: sections with starts and titles, and starts to skip.
Proposer = Callable[[dict], object]


def asked(units: DataFrame, propose: Proposer, size: int = VIEW, overlap: int = SHARED) -> DataFrame:
    """``book_id, chunk, reply, error``: what ``propose`` says to each view of a book's units, as JSON.

    A view is bounded, so a proposer may call out as it likes; one that raises
    gives its message and no reply.
    """
    views = O.overlapping(units, size, overlap)
    fields = F.struct("idx", "start_block", "kind", "title", "seconds")
    views = views.groupBy("book_id", "chunk").agg(F.array_sort(F.collect_list(fields)).alias("units"), F.round(F.sum("seconds"), 6).alias("total_seconds"))
    views = views.withColumn("chunks", F.count("*").over(Window.partitionBy("book_id")))
    kind = units.schema["book_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies, errors = [], []
            for view in batch.to_pylist():
                try:
                    reply, error = propose(view), None
                    reply = reply if isinstance(reply, str) else json.dumps(reply)
                except Exception as why:  # whatever a proposer meets, its book falls back
                    reply, error = None, str(why) or type(why).__name__
                replies.append(reply)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=["book_id", "chunk", "reply", "error"])

    return views.select("book_id", "chunk", "chunks", "total_seconds", "units").mapInArrow(run, f"book_id {kind}, chunk long, reply string, error string")


def _texts(v: Column, path: str) -> Column:
    """A field of a JSON document as text, whatever kind of value it is."""
    return F.try_variant_get(v, path, "string")


def boundaries(reply: Column) -> Column:
    """``sections`` (``start_block, title``) and ``skips`` of a reply in JSON, of whatever shape.

    The reply is a list of sections, or an object that holds one; fields go by
    both spellings.  Entries that are no objects or name no start go, as do
    later ones of the same start; titles are one line of bounded length.
    """
    v = F.try_parse_json(reply)
    listed = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.sections", "array<variant>"), F.array().cast("array<variant>"))
    field = lambda e, *names: F.coalesce(*[_texts(e, f"$.{n}") for n in names], F.lit(""))
    read = F.transform(listed, lambda e: F.struct(trim(field(e, "start_block_id", "startBlockId")).alias("start_block"), trim(F.substring(O.one_line(field(e, "title")), 1, TITLE_CHARS)).alias("title")))
    sections = first_of_each(F.filter(read, lambda s: s["start_block"] != ""), lambda s: s["start_block"])
    named = F.coalesce(F.try_variant_get(v, "$.skip_block_ids", "array<variant>"), F.try_variant_get(v, "$.skipBlockIds", "array<variant>"), F.array().cast("array<variant>"))
    skips = F.array_distinct(F.filter(F.transform(named, lambda e: trim(F.coalesce(_texts(e, "$"), F.lit("")))), lambda x: x != ""))
    return F.struct(sections.alias("sections"), skips.alias("skips"))


def normalised(kept: DataFrame, found: DataFrame) -> DataFrame:
    """``book_id, start_block, title``: the starts that are kept blocks, the first of each; every book's first block starts one."""
    s = found.select("book_id", trim(F.col("start_block")).alias("start_block"), trim(F.substring(O.one_line(F.coalesce("title", F.lit(""))), 1, TITLE_CHARS)).alias("title"))
    s = s.groupBy("book_id", "start_block").agg(F.min("title").alias("title"))
    blocks = kept.select("book_id", F.col("block_id").alias("start_block"), (F.row_number().over(Window.partitionBy("book_id").orderBy("ord")) == 1).alias("_first"))
    return blocks.join(s, ["book_id", "start_block"], "left").filter("_first or title is not null").select("book_id", "start_block", F.coalesce("title", F.lit("")).alias("title"))


def _protected(units: DataFrame) -> DataFrame:
    """Starts that no proposal may skip: title-like and numbered ones."""
    numbered = O.one_line(F.col("title")).rlike(O.BARE_NUMBER)
    return units.filter((F.col("kind") != "prose") & (O.title_like(F.col("title")) | numbered)).select("book_id", F.col("start_block").alias("block_id"))


def shown_title(c: Column) -> Column:
    """A section's title as it is spoken: a bare number becomes a chapter."""
    return O.section_title(c, F.lit(""))


def detect_sections(kept: DataFrame, chapters: DataFrame, propose: Proposer, wpm: int = 150, size: int = VIEW, overlap: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """``book_id, start_block, title`` of sections, and ``book_id, start_block`` to skip.

    A book's own headings and what is proposed are merged, so a proposal that
    misses chapters cannot swallow them; contents listings are skipped in any
    case, and what is proposed to be skipped only if it is no chapter's start.
    A book for which any proposal failed has its own headings alone.
    """
    kept = written(kept)  # the outline and the blocks that sections may start at
    units = written(O.outline(kept, chapters, wpm).withColumn("seconds", F.round("seconds", 6)))
    own_skips = O.skipped(units).distinct()
    own = O.sections(units).join(own_skips, ["book_id", "start_block"], "left_anti")
    # a proposer may say something else when it is asked again, so it is asked once
    replies = written(asked(units, propose, size, overlap).withColumn("said", boundaries(F.col("reply"))))
    failed = replies.groupBy("book_id").agg(F.max(F.col("error").isNotNull()).alias("failed")).filter("failed").select("book_id")
    good = replies.join(failed, "book_id", "left_anti")
    # of views that propose one start, the earlier counts first, and the longer title later
    sections = good.select("book_id", "chunk", F.posexplode("said.sections").alias("pos", "s")).select("book_id", "chunk", "pos", "s.start_block", "s.title")
    sections = sections.groupBy("book_id", "start_block").agg(F.array_sort(F.collect_list(F.struct("chunk", "pos", "title"))).alias("t"))
    titles = F.transform("t", lambda x: shown_title(x["title"]))
    proposed = sections.select("book_id", "start_block", F.aggregate(titles, F.lit(""), lambda a, b: K.longer_title(a, b)).alias("title"))
    skips = good.select("book_id", F.explode("said.skips").alias("block_id"))
    skips = K.honoured_skips(own_skips.withColumnRenamed("start_block", "block_id"), skips, _protected(units)).withColumnRenamed("block_id", "start_block")
    merged = K.merged_sections(own.select("book_id", "start_block", shown_title(F.col("title")).alias("title")), proposed, K.longer_title).join(skips, ["book_id", "start_block"], "left_anti")
    fallback = own.join(failed, "book_id", "left_semi").select("book_id", "start_block", "title")
    chosen = merged.join(failed, "book_id", "left_anti").unionByName(fallback)
    return normalised(kept, chosen), skips
