"""Subtitle cues: timing from text, offsets of chunks, what is on screen, captions from words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions.arrays import let, places, running_totals
from ..functions.publish import ass_dialogue, ass_head
from ..functions.text import caption_lines, filled, has_punctuation, srt_time, trim


def proportional_in(text: Column, duration: Column) -> Column:
    """A row's cues ``idx, start, end, content``; null where nothing is left of its text when it is trimmed."""
    lines = let(caption_lines(text), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(trim(text))))
    whole = F.greatest(duration, F.lit(0.001))

    def ends(upto: Column) -> Column:
        return F.transform(upto, lambda u, i: F.when(i == F.size(upto) - 1, whole).otherwise(whole * u / F.element_at(upto, -1)))

    def cues(l: Column) -> Column:
        till = let(running_totals(F.transform(l, lambda x: F.length(x).cast("long"))), ends)
        one = lambda e: F.transform(l, lambda x, i: F.struct((i + 1).alias("idx"), F.coalesce(F.get(e, i - 1), F.lit(0.0)).alias("start"), F.get(e, i).alias("end"), x.alias("content")))
        return let(till, one)

    return F.when(filled(text), let(lines, cues))


def _timed(shape: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Times of a batch's lines, all texts in step: each line ends with its share of what is spoken by then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, lines, whole = batch.columns
            content, whole = lines.flatten(), whole.to_numpy()
            offsets = lines.offsets.to_numpy() - lines.offsets[0].as_py()
            counts, first, last = np.diff(offsets), offsets[:-1], offsets[1:] - 1
            n = pc.utf8_length(content).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(n)
            upto -= np.repeat(upto[first] - n[first], counts)
            end = np.repeat(whole, counts) * upto / np.repeat(upto[last], counts)
            end[last] = whole
            start = np.concatenate([[0.0], end[:-1]])
            start[first] = 0.0
            idx = (np.arange(len(n)) - np.repeat(first, counts) + 1).astype(np.int32)
            cues = pa.StructArray.from_arrays([pa.array(idx), pa.array(start), pa.array(end), content], names=["idx", "start", "end", "content"])
            yield pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), cues).cast(shape.field(1).type)], schema=shape)

    return run


def timed(texts: DataFrame, key: str, text: str, duration: str) -> DataFrame:
    """``key, cues``: a text's cues ``idx, start, end, content`` in its row, made in Arrow batches; texts of white space alone are left out."""
    c = F.col(text)
    lines = let(caption_lines(c), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(trim(c))))
    rows = texts.filter(filled(c)).select(key, lines.alias("lines"), F.greatest(F.col(duration), F.lit(0.001)).cast("double").alias("whole"))
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, cues array<struct<idx: int, start: double, end: double, content: string>>"
    return rows.mapInArrow(_timed(to_arrow_schema(_parse_datatype_string(schema))), schema)


def proportional(texts: DataFrame, key: str, text: str, duration: str) -> DataFrame:
    """``key, idx, start, end, content``: lines share the duration by their lengths; the last ends exactly with it.

    A text's times are computed within its row, so nothing is shuffled.
    """
    return timed(texts, key, text, duration).select(key, F.inline("cues"))


def offset(chunks: DataFrame, cues: DataFrame, key: str) -> DataFrame:
    """Cues of a document's chunks on one time line, numbered anew; chunks have ``chunk, duration``, cues ``chunk, idx, start, end, text``."""
    before = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = chunks.select(key, "chunk", F.coalesce(F.sum("duration").over(before), F.lit(0.0)).alias("_shift"))
    moved = cues.join(shifts, [key, "chunk"]).withColumns({"start": F.col("start") + F.col("_shift"), "end": F.col("end") + F.col("_shift")})
    return moved.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy("chunk", "idx"))).drop("_shift")


def active(cues: DataFrame, times: DataFrame, key: str, bucket: float = 10.0) -> DataFrame:
    """``key, t, idx, text``: the last cue that covers each time, both ends closed.

    Cues and times meet in buckets of seconds, so no side is compared whole.
    """
    first, last = F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)
    spread = cues.withColumn("_b", F.explode(F.sequence(first, last)))
    hits = times.withColumn("_b", F.floor(F.col("t") / bucket)).join(spread, [key, "_b"]).filter(F.col("t").between(F.col("start"), F.col("end")))
    return hits.groupBy(key, "t").agg(F.max("idx").alias("idx"), F.max_by("text", "idx").alias("text"))


def active_in(cues: Column, times: Column) -> Column:
    """``t, idx, text`` of a row's own cues ``idx, start, end, content``: the last that covers each of its times, both ends closed."""
    last = lambda t: F.array_max(F.transform(F.filter(cues, lambda c: t.between(c["start"], c["end"])), lambda c: F.struct(c["idx"].alias("idx"), c["content"].alias("text"))))
    found = F.transform(times, lambda t: let(last(t), lambda c: F.when(c.isNotNull(), F.struct(t.alias("t"), c["idx"].alias("idx"), c["text"].alias("text")))))
    return F.filter(found, lambda x: x.isNotNull())


def _body(start: Column, end: Column, text: Column) -> Column:
    return F.concat(F.lit("\n"), srt_time(start), F.lit(" --> "), srt_time(end), F.lit("\n"), text, F.lit("\n"))


def srt_in(cues: Column) -> Column:
    """A row's own cues ``start, end, content``, which are in order, as one document, as :func:`to_srt` has it."""
    return F.array_join(F.transform(cues, lambda c, i: F.concat(i + 1, _body(c["start"], c["end"], c["content"]))), "\n")


def to_srt(cues: DataFrame, key: str, text: str = "content") -> DataFrame:
    """One document per key: cues numbered from 1, a blank line between them."""
    one = _body(F.col("start"), F.col("end"), F.col(text))
    ordered = cues.select(key, F.struct("start", "idx", one.alias("body")).alias("c")).groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("c"))
    return ordered.select(key, F.array_join(F.transform("c", lambda c, i: F.concat(i + 1, c["body"])), "\n").alias("srt"))


def to_ass(cues: DataFrame, key: str, width: int, height: int, text: str = "content", **style) -> DataFrame:
    """One styled subtitle document per key: cues by time, those without text left out."""
    line = ass_dialogue(F.col("start"), F.col("end"), F.col(text))
    ordered = cues.select(key, F.struct("idx", line.alias("body")).alias("c")).filter("c.body is not null").groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("c"))
    return ordered.select(key, F.concat(ass_head(width, height, **style), F.array_join(F.transform("c", lambda c: c["body"]), "\n"), F.lit("\n")).alias("ass"))


def captions_in(words: Column) -> Column:
    """A row's words ``start, end, word`` as captions ``caption, start, end, text`` that end with punctuation."""

    def cut(w: Column) -> Column:
        last = F.filter(places(w), lambda i: (i == F.size(w) - 1) | has_punctuation(F.get(w, i)["word"]))

        def captions(ends: Column) -> Column:
            begin = lambda k: F.coalesce(F.get(ends, k - 1) + 1, F.lit(0))
            text = lambda e, k: F.array_join(F.transform(F.slice(w, begin(k) + 1, e - begin(k) + 1), lambda x: x["word"]), " ")
            return F.transform(ends, lambda e, k: F.struct(k.cast("long").alias("caption"), F.get(w, begin(k))["start"].alias("start"), F.get(w, e)["end"].alias("end"), text(e, k).alias("text")))

        return let(last, captions)

    return let(words, cut)


def word_captions(words: DataFrame, key: str) -> DataFrame:
    """Words with ``seq, start, end, word`` into captions that end with punctuation."""
    held = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "word"))).alias("w"))
    return held.select(key, F.inline(captions_in(F.transform("w", lambda x: x.dropFields("seq")))))
