"""Substring dedup by sliding sentence spans.

Words are runs of bytes that are no ASCII white space, and single characters
of scripts that are written without spaces.  A sentence ends after a word that
ends in ``. ! ? ; :`` or an ideographic stop, and before a line break; where
``WINDOW`` words in a row have no such end, it ends after the one with the
least hash, the last of equals.  So every ``WINDOW`` words hold an end, and
which words of a passage are ends depends on fewer than ``WINDOW`` words
around them: a passage of 50 words has a span that is the same wherever it
stands, whatever its words.  A span starts at each sentence
and runs over the fewest sentences, two or more, that hold ``SPAN_WORDS``
words.  Spans meet by a 64-bit hash of their small-lettered words, and an
occurrence loses its sentences only where 36 bits of a second one agree with
the first occurrence's.  Every occurrence but the first by (doc_id, position) loses its
sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buffers as B

U64 = np.uint64
SPAN_WORDS = 16
WINDOW = 8
_END = np.zeros(256, dtype=bool)
_END[list(b".!?;:")] = True
_WIDE_END = np.array(sorted(int.from_bytes(c.encode(), "big") for c in "。！？；：｡．"))
#: A place in a text and the second hash are one number: sentences above, this many bits of hash below.
CHECK_BITS = 36
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[10, 11, 12, 13]] = True


def _unspaced(low: np.ndarray) -> np.ndarray:
    """Where characters begin that are words of their own: Thai, Lao, Tibetan, Burmese, Khmer, Chinese and Japanese ones and wide forms."""
    lead = np.flatnonzero(low[:-2] >= 0xE0) if len(low) > 2 else np.zeros(0, dtype=np.int64)
    a, b = low[lead], low[lead + 1]
    own = (a == 0xE0) & (b >= 0xB8) | (a == 0xE1) & ((b <= 0x81) | (b == 0x9E) | (b == 0x9F)) | (a == 0xE2) & (b >= 0xBA) | (a > 0xE2) & (a < 0xEA)
    own |= (a == 0xEF) & ((b >= 0xA4) & (b <= 0xAB) | (b >= 0xBC) & (b <= 0xBE)) | (a == 0xF0) & (b >= 0xA0) & (b <= 0xB3)
    return lead[own]


def _split(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts words before and after each character that is a word of its own."""
    lead = _unspaced(low)
    if not len(lead):
        return starts, ends
    new = np.unique(np.concatenate((starts, lead, lead + np.where(low[lead] >= 0xF0, 4, 3))))
    run = np.searchsorted(starts, new, side="right") - 1
    inside = (run >= 0) & (new < ends[run])
    new, run = new[inside], run[inside]
    return new, np.minimum(np.concatenate((new[1:], [len(low)])), ends[run])


def _least(words: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The word with the least hash, the last of equals, of each ``WINDOW`` words that hold no end; rows end in ends."""
    windows = len(words) - WINDOW + 1
    if windows < 1:
        return np.zeros(0, dtype=np.int64)
    ended = np.concatenate(([0], np.cumsum(last)))
    at = np.flatnonzero(ended[WINDOW:] == ended[:-WINDOW])
    best, place = words[at], at.copy()
    for d in range(1, WINDOW):
        own = words[at + d]
        less = own <= best
        best[less], place[less] = own[less], at[less] + d
    return place


def sentences(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, byte starts of words, each sentence's first word with the end as last, and sentence bounds of rows."""
    low = B.LOWER[buf]
    starts, ends = _split(low, *B.runs(low, offs, B.SPACED))
    words = B.RunHash(low)(starts, ends)
    first = B.counts_in(starts, offs)
    lines = np.concatenate(([0], np.cumsum(_BREAK[low]))) if len(low) else np.zeros(1, dtype=np.int64)
    last = np.zeros(len(words), dtype=bool)
    if len(words):
        last = _END[low[ends - 1]]
        wide = np.flatnonzero((low[ends - 1] >= 0x80) & (ends - starts >= 3))
        tail = ends[wide, None] + np.arange(-3, 0)
        last[wide] = np.isin(low[tail].astype(np.int64) @ np.array([1 << 16, 1 << 8, 1]), _WIDE_END)
        last[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
        row_ends = first[1:][np.diff(first) > 0] - 1
        last[row_ends] = True
        last[_least(words, last)] = True
    bounds = np.concatenate(([0], np.flatnonzero(last) + 1))
    return words, starts, bounds, np.searchsorted(bounds, first, side="left")


def spans_of(words: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first sentence, end and hash of every span, and whether its row has it before."""
    at = np.arange(len(bounds) - 1)
    row = np.searchsorted(rows, at, side="right") - 1
    to = np.searchsorted(bounds, bounds[:-1] + SPAN_WORDS, side="left")
    to = np.maximum(to, at + 2)
    ok = to <= rows[row + 1]
    at, to, row = at[ok], to[ok], row[ok]
    h = B.RunHash(words)(bounds[at], bounds[to])
    order = np.lexsort((h, row))
    again = np.zeros(len(at), dtype=bool)
    again[order[1:]] = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
    return row, at, to, h, again


def checks_of(words: np.ndarray, bounds: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The second hash of spans, as many bits of it as are kept."""
    return (B.RunHash(B.mix(words))(bounds[at], bounds[to]) >> U64(64 - CHECK_BITS)).astype(np.int64)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first occurrence in its text of every span; later ones are repeats without asking others."""
    for batch in batches:
        for a, b, buf, offs in B.pieces(batch.column(1)):
            words, _, bounds, rows = sentences(buf, offs)
            row, at, to, h, again = spans_of(words, bounds, rows)
            row, at, to, h = (x[~again] for x in (row, at, to, h))
            ids = batch.column(0).slice(a, b - a).take(pa.array(row))
            spot = (at - rows[row]) << CHECK_BITS | checks_of(words, bounds, at, to)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids, pa.array(spot)], names=["span", "doc", "spot"])
            del words, bounds, rows, row, at, to, h, again, ids, spot
        pa.default_memory_pool().release_unused()  # a worker lives on, and what it keeps adds up over stages


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, cuts`` for each document that holds a non-first repeat.

    A cut is the first sentence of a span and the second hash of the span's
    first occurrence.  A text sends each of its spans once: what it holds
    again is a repeat whatever others hold, and is found when the text is cut.
    The occurrences of a span are counted before the shuffle as far as they
    meet in one task, and a span that a third of all documents hold is one
    row of the small side of a join whose large side Spark splits.
    """
    narrow = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc"].dataType.simpleString()
    spans = narrow.mapInArrow(_spans, f"span long, doc {kind}, spot long")
    place = lambda c: F.shiftright(c, CHECK_BITS).cast("int")
    least = spans.groupBy("span").agg(F.count("*").alias("times"), F.min(F.struct("doc", "spot")).alias("first")).filter("times > 1").select("span", "first")
    again = spans.select("span", "doc", place("spot").alias("at")).join(least, "span").filter((F.col("doc") != F.col("first.doc")) | (F.col("at") != place("first.spot")))
    check = F.col("first.spot").bitwiseAND(F.lit((1 << CHECK_BITS) - 1))
    # rows that repeat an id send the same cuts, which are held once
    return again.groupBy("doc").agg(F.collect_set(F.struct("at", check.alias("check"))).alias("cuts"))


def _cutter(ident: int, text: int, columns: list[str], report: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = len(columns)
            column, cuts = batch.column(text), batch.column(width)
            places, first_checks = (cuts.values.field(k).to_numpy() for k in (0, 1))
            held = cuts.offsets.to_numpy()
            known = cuts.is_valid().to_numpy(zero_copy_only=False)
            total, gone, kept = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            for a, b, buf, offs in B.pieces(column):
                words, starts, bounds, rows = sentences(buf, offs)
                row, at, to, _, again = spans_of(words, bounds, rows)
                check = checks_of(words, bounds, at, to)
                within: dict[int, list[int]] = {}
                for r, s in zip(row[again].tolist(), np.flatnonzero(again).tolist()):
                    within.setdefault(r, []).append(s)
                for i in range(b - a):
                    lo, n = int(rows[i]), int(rows[i + 1] - rows[i])
                    total[a + i] = n
                    mine = slice(held[a + i], held[a + i + 1] if known[a + i] else held[a + i])
                    # a repeated id with another text may not have the span, nor need a span of equal hash be the same
                    k = np.minimum(np.searchsorted(at, lo + places[mine]), max(len(at) - 1, 0))
                    k = k[(at[k] == lo + places[mine]) & (row[k] == i) & (check[k] == first_checks[mine])] if len(at) else k[:0]
                    if batch.column(ident)[a + i].is_valid:
                        k = np.concatenate((k, within.get(i, []))).astype(np.int64)
                    if not column[a + i].is_valid:
                        kept.append(None)
                        continue
                    raw = buf[offs[i] : offs[i + 1]]
                    if len(k):
                        cover = np.zeros(n + 1, dtype=np.int64)
                        np.add.at(cover, at[k] - lo, 1)
                        np.add.at(cover, to[k] - lo, -1)
                        drop = np.cumsum(cover)[:-1] > 0
                        gone[a + i] = drop.sum()
                        edges = np.concatenate((starts[bounds[lo : lo + n]] - offs[i], [len(raw)]))
                        stay = np.ones(len(raw), dtype=bool)
                        for j in np.flatnonzero(drop):
                            stay[edges[j] : edges[j + 1]] = False
                        raw = raw[stay]
                    kept.append(raw.tobytes().decode("utf-8", "replace"))
            new = pa.array(kept, type=pa.string())
            if report:
                yield pa.RecordBatch.from_arrays([*batch.columns[:text], pa.array(total), pa.array(gone), new], names=[*columns[:text], "n_sentences", "n_removed", "text"])
            else:
                stays = (gone == 0) | (gone < total)
                cells = [new if j == text else c for j, c in enumerate(batch.columns[:width])]
                if "n_chars" in columns and pa.types.is_integer(batch.schema.field("n_chars").type):
                    j = columns.index("n_chars")
                    size = [len(t) if g and t is not None else n for t, g, n in zip(kept, gone, cells[j].to_pylist())]
                    cells[j] = pa.array(size, type=cells[j].type)
                yield pa.RecordBatch.from_arrays(cells, names=columns).filter(pa.array(stays))
                del cells
            del column, cuts, places, first_checks, held, known, kept, new
            pa.default_memory_pool().release_unused()

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_sentences, n_removed, text`` for every row.

    Null texts stay null; empty and short texts have no spans and stay.  Rows
    without an id take no part and stay as they are.  Rows that repeat a
    ``doc_id`` with the same text are one occurrence, so none loses to the
    other; rows of one id with other texts are one document too, and a passage
    that begins at the same sentence of both stays in both.  An empty table gives an empty one; other columns are ignored.  A
    very long text is worked on alone, at some 60 times its bytes.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = narrow.join(repeated(docs, id_col, text_col).withColumnRenamed("doc", "doc_id"), "doc_id", "left").select("doc_id", "text", "cuts")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_cutter(0, 1, ["doc_id", "text"], True), f"doc_id {kind}, n_sentences long, n_removed long, text string")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, without repeated sentences; rows that lose all their sentences go.

    An integer column ``n_chars`` is set again where a text was shortened.
    """
    doc, cuts = B.unused(docs.columns, "cut_doc", "cuts")
    found = repeated(docs, id_col, text_col).withColumnsRenamed({"doc": doc, "cuts": cuts})
    joined = docs.join(found, F.col(f"`{id_col}`") == F.col(doc), "left").select(*[F.col(f"`{c}`") for c in docs.columns], cuts)
    return joined.mapInArrow(_cutter(docs.columns.index(id_col), docs.columns.index(text_col), docs.columns, False), docs.schema)
