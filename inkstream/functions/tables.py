"""Parsers as table functions, for SQL: ``SELECT * FROM srt_cues(TABLE(lines) PARTITION BY file ORDER BY n)``.

Each takes a table whose last column is what is parsed; the columns before it
are handed through, so a result can be joined back.  What a function gives is
told by its input (``analyze``), whatever the key columns are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: A subtitle's timing line and its times, fixed patterns of the format.
TIMING = re.compile(r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)")


def _shape(rows: AnalyzeArgument, *more: StructField) -> AnalyzeResult:
    if not rows.isTable or not isinstance(rows.dataType, StructType) or not rows.dataType.fields:
        raise ValueError("the first argument is a table: TABLE(...)")
    last = rows.dataType.fields[-1]
    if not isinstance(last.dataType, StringType):
        raise ValueError(f"the last column, {last.name}, is parsed and must be a string")
    keys = rows.dataType.fields[:-1]
    clash = {f.name.lower() for f in keys} & {f.name.lower() for f in more}
    if clash:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    return AnalyzeResult(StructType([*keys, *more]))


class VoiceChunks:
    """``place, chunk``: a text in parts of at most so many characters that a voice reads at once."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        if most is not None and (most.isTable or not isinstance(most.value, int) or most.value < 1):
            raise ValueError("the second argument is a number of characters from 1")
        return _shape(rows, StructField("place", IntegerType()), StructField("chunk", StringType()))

    def eval(self, row, most: int = 1200) -> Iterator[tuple]:
        from ..operators.narration import voice_chunks

        *keys, text = row
        for place, chunk in enumerate(voice_chunks(text or "", most)):
            yield (*keys, place, chunk)


class HtmlBlocks:
    """``pos, kind, level, text``: a page's blocks."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        return _shape(rows, StructField("pos", IntegerType()), StructField("kind", StringType()), StructField("level", IntegerType()), StructField("text", StringType()))

    def eval(self, row) -> Iterator[tuple]:
        from ..sources.html import parse

        *keys, page = row
        for pos, block in enumerate(parse(page or "")):
            yield (*keys, pos, *block)


class SrtCues:
    """``idx, start, end, text``: cues of lines that come in order, one file to a partition.

    A timing line begins a cue even without a blank line before it, a number
    before a timing line is none of the text, and a cue without text keeps its
    number and goes.  The keys are those of the cue's timing line, so columns
    that tell lines apart say where a cue begins.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        return _shape(rows, StructField("idx", IntegerType()), StructField("start", DoubleType()), StructField("end", DoubleType()), StructField("text", StringType()))

    def __init__(self) -> None:
        self.idx, self.cue, self.text, self.number = 0, None, [], None

    def _done(self) -> list[tuple]:
        if self.cue is None or not self.text:
            return []
        keys, start, end = self.cue
        return [(*keys, self.idx, start, end, "\n".join(self.text))]

    def eval(self, row) -> Iterator[tuple]:
        *keys, line = row
        yield from self._line(keys, line or "")

    def _line(self, keys: list, line: str) -> Iterator[tuple]:
        """What a line gives out: at a timing line, the cue before it."""
        line = line.strip()
        at = TIMING.search(line) if "-->" in line else None
        if at:  # the number before it was its own
            done = self._done()
            t = [int(x) for x in at.groups()]
            self.idx += 1
            self.cue, self.text, self.number = (keys, _seconds(*t[:4]), _seconds(*t[4:])), [], None
            return done
        if self.number is not None:
            self.text.append(self.number)
        self.number = None
        if line.isdecimal() and line.isascii():
            self.number = line
        elif line:
            self.text.append(line)
        return ()

    def terminate(self) -> Iterator[tuple]:
        if self.number is not None:
            self.text.append(self.number)
        yield from self._done()


class SrtFiles:
    """``idx, start, end, text``: cues of whole subtitle files, one to a row, as :class:`SrtCues` reads their lines; files need not be dealt or sorted."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        return SrtCues.analyze(rows)

    def eval(self, row) -> Iterator[tuple]:
        *keys, text = row
        reader = SrtCues()
        for line in (text or "").split("\n"):
            yield from reader._line(keys, line)
        yield from reader.terminate()


def _seconds(h: int, m: int, s: int, ms: int) -> float:
    return h * 3600 + m * 60 + s + ms / 1000


FUNCTIONS = {"voice_chunks": VoiceChunks, "html_blocks": HtmlBlocks, "srt_cues": SrtCues, "srt_files": SrtFiles}


def register(spark: SparkSession) -> list[str]:
    """Makes the table functions known to SQL."""
    for name, cls in FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(cls))
    return list(FUNCTIONS)
