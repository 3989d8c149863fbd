"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of consecutive words of the benchmark's items.  The
tables hold, for the hash of each block of two words, how far a search may
move on; where it may not move, the suffix-hash bucket, ordered by a hash of
the whole window, names the patterns to compare, and their words are compared
byte by byte.  All texts of a batch are searched in step: a text is cut into
lanes of end positions and every lane moves by its own shift, so most words
are never looked at.

A block of items is about its text in words, hashes and places: some ten
times its bytes.  Each block is one more step of the same scan, which carries
what it found from block to block in the row itself, so rows are answered one
by one at any size of the benchmark, without a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import buffers as B
from .store import Scratch

U64 = np.uint64
WINDOW = 13
#: A text is contaminated if it has hit words and they are one in so many or more.
RATIO = 20
#: Items go to executors in blocks of about this many bytes of text.
BLOCK_BYTES = 8 << 20
#: Blocks that one pass over the documents holds; after so many, what was found is written and read again.
PASS_BLOCKS = 4
_LANE = 256
_TABLE_BITS = range(12, 25)
_A, _C = (int(x) | 1 for x in B.stream(41, 2))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPANS_SQL = "array<struct<start:long,end:long>>"


def _pairs(before: np.ndarray | None, last: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return B.mix(last * U64(_A) + (before * U64(_C) if before is not None else U64(0)))


@dataclass
class Words:
    """The words of some texts: small-lettered bytes, places, hashes, and the bounds of texts."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, buf: np.ndarray, offs: np.ndarray) -> Words:
        low = B.LOWER[buf]
        starts, ends = B.runs(low, offs, B.ALNUM)
        return cls(low, starts, ends, B.RunHash(low)(starts, ends), B.counts_in(starts, offs))

    @classmethod
    def of_column(cls, column: pa.Array) -> Words:
        """All texts of a column at once; hashes are made piece by piece."""
        parts, at, n = [], 0, 0
        for _, _, buf, offs in B.pieces(column):
            w = cls.of(buf, offs)
            parts.append((w.low, w.starts + at, w.ends + at, w.hashes, w.first[1:] + n))
            at, n = at + len(buf), n + len(w.starts)
        if not parts:
            none = np.zeros(0, dtype=np.int64)
            return cls(np.zeros(0, np.uint8), none, none, np.zeros(0, dtype=U64), np.zeros(1, dtype=np.int64))
        low, starts, ends, hashes, first = (np.concatenate(x) for x in zip(*parts))
        return cls(low, starts, ends, hashes, np.concatenate(([0], first)))


def same_words(x: Words, i: np.ndarray, y: Words, j: np.ndarray) -> np.ndarray:
    """Whether words ``i`` of one and ``j`` of the other are the same bytes."""
    size = x.ends[i] - x.starts[i]
    same = size == y.ends[j] - y.starts[j]
    for a in range(0, len(i), 1 << 16):
        own = np.flatnonzero(same[a : a + (1 << 16)]) + a
        if not len(own):
            continue
        n = size[own]
        begin = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(begin, n)
        differ = x.low[np.repeat(x.starts[i[own]], n) + step] != y.low[np.repeat(y.starts[j[own]], n) + step]
        same[own] = ~np.logical_or.reduceat(differ, begin)
    return same


@dataclass
class Tables:
    """Search tables for the distinct windows of one length of a block's items."""

    length: int
    shift: np.ndarray
    suffix: np.ndarray  # hash of each window's last two words, sorted
    whole: np.ndarray  # hash of each window, sorted among those of one suffix
    at: np.ndarray  # where in the items' words the window stands
    bound: np.ndarray  # the items of each window
    item: np.ndarray

    @classmethod
    def build(cls, words: np.ndarray, at: np.ndarray, item: np.ndarray, m: int) -> Tables:
        """``at`` are the first words of windows of ``m`` words, ``item`` the item that each belongs to."""
        block = min(2, m)
        hashes = B.RunHash(words)(at, at + m)
        again = B.RunHash(B.mix(words))(at, at + m)  # distinct windows are told apart by 128 bits
        suffix = _pairs(words[at + m - 2] if block == 2 else None, words[at + m - 1])
        order = np.lexsort((item, again, hashes, suffix))
        at, item, hashes, again, suffix = (x[order] for x in (at, item, hashes, again, suffix))
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (again[1:] != again[:-1]) | (suffix[1:] != suffix[:-1])))
        held = new.copy()
        held[1:] |= item[1:] != item[:-1]
        bound = np.concatenate((np.cumsum(held)[new] - 1, [held.sum()]))
        bits = int(np.clip(np.ceil(np.log2(8 * len(at))), _TABLE_BITS[0], _TABLE_BITS[-1]))
        shift = np.full(1 << bits, m - block + 1, dtype=np.uint8 if m < 256 else np.int32)
        first = at[new]
        for j in range(block - 1, m):  # smaller shifts last
            h = _pairs(words[first + j - 1] if block == 2 else None, words[first + j])
            shift[(h & U64(len(shift) - 1)).astype(np.int64)] = m - 1 - j
        return cls(m, shift, suffix[new], hashes[new], first.astype(np.int32), bound.astype(np.int32), item[held].astype(np.int32))

    def search(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and window numbers of all candidates of equal hashes; ``first`` bounds the texts' words."""
        m = self.length
        begin, stop = first[:-1] + m - 1, first[1:]
        lanes = np.maximum(-(-(stop - begin) // _LANE), 0)
        text = np.repeat(np.arange(len(lanes)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = begin[text] + nth * _LANE
        end = np.minimum(at + _LANE, stop[text])
        found = []
        while len(at):
            h = _pairs(words[at - 1] if m > 1 else None, words[at])
            step = self.shift[(h & U64(len(self.shift) - 1)).astype(np.int64)].astype(np.int64)
            stay = step == 0
            if stay.any():
                found.append((at[stay], h[stay]))
            at = at + np.maximum(step, 1)
            going = at < end
            at, end = at[going], end[going]
        none = np.zeros(0, dtype=np.int64)
        if not found:
            return none, none
        ends, h = (np.concatenate(x) for x in zip(*found))
        lo, hi = np.searchsorted(self.suffix, h, "left"), np.searchsorted(self.suffix, h, "right")
        ends, lo, hi = (x[lo < hi] for x in (ends, lo, hi))
        if not len(ends):
            return none, none
        starts = ends - m + 1
        whole = B.RunHash(words)(starts, ends + 1)
        # first window of the bucket whose hash is not less
        a, b = lo, hi
        while (a < b).any():
            mid = (a + b) // 2
            less = (a < b) & (self.whole[np.minimum(mid, len(self.whole) - 1)] < whole)
            a, b = np.where(less, mid + 1, a), np.where(less, b, np.minimum(b, mid))
        got = [(none, none)]
        while len(a):
            ok = a < hi
            ok[ok] = self.whole[a[ok]] == whole[ok]
            starts, a, hi, whole = starts[ok], a[ok], hi[ok], whole[ok]
            got.append((starts, a))
            a = a + 1
        return np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])


@dataclass
class Block:
    """A block of items ready to be searched for."""

    ids: np.ndarray
    words: Words
    tables: list[Tables]

    @classmethod
    def build(cls, rows: list[tuple[str, str]], window: int) -> Block:
        names, item = np.unique(np.array([i for i, _ in rows], dtype=object), return_inverse=True) if rows else (np.zeros(0, dtype=object), np.zeros(0, dtype=np.int64))
        words = Words.of_column(pa.array([t for _, t in rows], type=pa.large_string()))
        size = np.diff(words.first)
        length = np.minimum(size, window)
        tables = []
        for m in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == m)
            n = size[own] - m + 1
            at = np.repeat(words.first[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            tables.append(Tables.build(words.hashes, at, np.repeat(item[own], n), m))
        # what is sent along needs the words' places and bytes only
        small = words.low.size < 1 << 31
        slim = Words(words.low, *(x.astype(np.int32 if small else np.int64) for x in (words.starts, words.ends)), np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64))
        return cls(names, slim, tables)

    def find(self, text: Words) -> tuple[np.ndarray, list[set[str]]]:
        """Which words lie in an occurrence of a window, and the items found in each text."""
        cover = np.zeros(len(text.starts) + 1, dtype=np.int64)
        items: list[set[str]] = [set() for _ in range(len(text.first) - 1)]
        for t in self.tables:
            at, window = t.search(text.hashes, text.first)
            if not len(at):
                continue
            step = np.arange(t.length)
            ok = same_words(text, (at[:, None] + step).ravel(), self.words, (t.at[window][:, None] + step).ravel()).reshape(-1, t.length).all(axis=1)
            at, window = at[ok], window[ok]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + t.length, -1)
            row = np.searchsorted(text.first, at, "right") - 1
            for r, k in np.unique(np.stack([row, window], axis=1), axis=0).tolist():
                items[r].update(self.ids[t.item[t.bound[k] : t.bound[k + 1]]])
        return np.cumsum(cover)[:-1] > 0, items


def spans_in(inside: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """The maximal runs of hit words of each text."""
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    spans: list[list[dict]] = [[] for _ in range(len(first) - 1)]
    for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        r = int(np.searchsorted(first, s, "right")) - 1
        while s < e:  # runs are cut where texts meet
            to = min(e, int(first[r + 1]))
            if to > s:
                spans[r].append({"start": s - int(first[r]), "end": to - int(first[r])})
            s, r = to, r + 1
    return spans


def _scanner(shared, text: int):
    """Adds what a block finds to the last three columns: number of words, spans and items."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches:
            names, width = batch.schema.names, batch.num_columns - 3
            for a, b, buf, offs in B.pieces(batch.column(text)):
                words = Words.of(buf, offs)
                inside, items = block.find(words)
                spans, found = batch.column(width + 1).slice(a, b - a), batch.column(width + 2).slice(a, b - a)
                for r in np.flatnonzero(pa.compute.list_value_length(spans).to_numpy(zero_copy_only=False) > 0).tolist():
                    for x in spans[r].as_py():
                        inside[words.first[r] + x["start"] : words.first[r] + x["end"]] = True
                    items[r].update(found[r].as_py())
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns[:width]), pa.array(np.diff(words.first)), pa.array(spans_in(inside, words.first), type=_SPANS), pa.array([sorted(x) for x in items], type=pa.list_(pa.string()))],
                    names=names,
                )

    return scan


def _scan(docs: DataFrame, text: int, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_bytes: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with three further columns, and their names: number of words, spans of hit words, sorted ids of items."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).dropna()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 if size <= block_bytes else -(-2 * size // block_bytes)
    new = B.unused(docs.columns, "n_words", "spans", "items")
    out = docs.select("*", F.lit(0).cast("long").alias(new[0]), F.array().cast(_SPANS_SQL).alias(new[1]), F.array().cast("array<string>").alias(new[2]))
    context, disk = docs.sparkSession.sparkContext, Scratch(docs.sparkSession)
    for k in range(blocks):
        if k and k % PASS_BLOCKS == 0:
            out = disk.keep(out)
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        rows = [(r["item"], r["text"]) for r in part.collect()]  # about half of block_bytes of text
        out = out.mapInArrow(_scanner(context.broadcast(Block.build(rows, window)), text), out.schema)
    return out, new


def _hits(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def _contaminated(hits: Column, words: Column) -> Column:
    return (hits > 0) & (RATIO * hits >= words)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_words, spans, items``.

    ``spans`` are the maximal runs of hit words (word numbers, end excluded),
    ``items`` the sorted ids, as strings, of items with an occurring window.
    Null and wordless texts have no words, spans or items; items without an
    id or a word are no patterns; repeated rows and rows without an id are
    answered one by one; an empty benchmark hits nothing and empty documents
    give an empty table; further columns are left, whatever their names.  Texts are searched about a megabyte at a time, a
    longer one alone at some 60 times its bytes.

    The benchmark is measured first and dealt by hash into blocks of about
    half of ``block_bytes``, or one block if it is no larger than that; only
    one block's text at a time passes through the driver.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found, (words, spans, items) = _scan(narrow, 1, benchmark, item_col, item_text_col, window, block_bytes)
    return found.select("doc_id", F.col(words).alias("n_words"), F.col(spans).alias("spans"), F.col(items).alias("items"))


def report(found: DataFrame) -> DataFrame:
    """The contract's digest columns of :func:`contamination`."""
    out = found.select("doc_id", "n_words", _hits("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", _contaminated(F.col("n_hit"), F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; ids play no part."""
    found, (words, spans, _) = _scan(docs, docs.columns.index(text_col), benchmark, item_col, item_text_col, WINDOW, block_bytes)
    return found.filter(~_contaminated(_hits(spans), F.col(words))).select(*[F.col(f"`{c}`") for c in docs.columns])
