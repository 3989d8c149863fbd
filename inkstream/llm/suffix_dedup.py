"""Exact byte-level dedup of strings of a fixed length with suffix arrays.

Every window of ``LENGTH`` bytes owns its anchor: the leftmost of its 32-byte
strings with the least hash.  Equal windows have equal anchors at equal
places, so a string that starts twice is found among the texts around the
anchors that occur twice.  These segments meet by anchor, equal ones as one
row with a count.  The segments of an anchor are read as blocks of 16 bytes
counted from the anchor; the suffix array of their blocks (see ``lyndon``)
brings suffixes together that share all whole blocks of a window, and those
windows are compared byte by byte.

An anchor at the edge of a passage that very many texts hold has another
segment in each of them.  Anchors of more than ``HOT_SEGMENTS`` distinct
segments reach no suffix array: each of their windows is a row, named by a
128-bit BLAKE2 digest of its bytes and its place from the anchor, and rows of
one name are counted by an aggregate that combines before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buffers as B
from .lyndon import suffix_array
from .near_dup import whole_groups
from .store import Scratch

U64 = np.uint64
LENGTH = 200
GRAM = 32
BLOCK = 16
#: Blocks that any window holds whole.
WHOLE = (LENGTH - BLOCK + 1) // BLOCK
_POS_BITS = 24
#: A text is searched for anchors in parts of so many windows.
_PART = 1 << 22
#: Distinct segments of an anchor that one suffix array takes.
HOT_SEGMENTS = 4096
#: Blocks whose suffixes are sorted at once.
_SORT_BLOCKS = 40_000


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: place of the anchor, first and last window, and the anchor's hash."""
    none = np.zeros(0, dtype=np.int64)
    if len(buf) < LENGTH:
        return none, none, none, np.zeros(0, dtype=U64)
    at = np.arange(len(buf) - GRAM + 1)
    h = B.RunHash(buf)(at, at + GRAM)
    mask = U64((1 << _POS_BITS) - 1)
    least = (h & ~mask) | at.astype(U64)
    span, width = LENGTH - GRAM + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    anchor = (least & mask).astype(np.int64)
    windows = np.zeros(len(buf) + 1, dtype=np.int64)  # windows that lie in one row
    long = np.diff(offs) >= LENGTH
    np.add.at(windows, offs[:-1][long], 1)
    np.add.at(windows, offs[1:][long] - LENGTH + 1, -1)
    good = np.cumsum(windows)[: len(anchor)] > 0
    new = good.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~good[:-1]
    starts = offs[:-1][long]
    new[starts] = True
    first = np.flatnonzero(new)
    ends = good.copy()
    ends[:-1] &= new[1:] | ~good[1:]
    last = np.flatnonzero(ends)
    return anchor[first], first, last, h[anchor[first]]


def _pack(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (place << 16) | ((place - first) << 8) | (last - first)


def _parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """First row, bytes and offsets of pieces; a very long text comes in overlapping parts with their place in it."""
    for a, b, buf, offs in B.pieces(column):
        if b - a == 1 and len(buf) > _PART + LENGTH:
            for s in range(0, len(buf) - LENGTH + 1, _PART):
                part = buf[s : s + _PART + LENGTH - 1]
                yield a, part, np.array([0, len(part)]), s
        else:
            yield a, buf, offs, 0


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, buf, offs, shift in _parts(batch.column(2)):
            place, first, last, h = anchors(buf, offs)
            row = np.searchsorted(offs, first, side="right") - 1
            take = pa.array(row + a)
            base = offs[row] - shift
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(_pack(place - base, first - base, last - base))], names=["h", "c1", "c2", "spot"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the text around each anchor: from its first window to the end of its last."""
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column(2)[i].as_buffer().to_pybytes()
            spots = batch.column(3)[i].values
            h, spot = spots.field(0).slice(0), spots.field(1).to_numpy()
            place, back, run = spot >> 16, (spot >> 8) & 255, spot & 255
            first = place - back
            cuts = [text[s : s + r + LENGTH] for s, r in zip(first.tolist(), run.tolist())]
            same = [int.from_bytes(hashlib.blake2b(c, digest_size=8).digest(), "little", signed=True) for c in cuts]
            n = len(cuts)
            yield pa.RecordBatch.from_arrays(
                [h, pa.array(same, type=pa.int64()), batch.column(0).slice(i, 1).take(pa.array([0] * n)), batch.column(1).slice(i, 1).take(pa.array([0] * n)), pa.array(first), pa.array(back.astype(np.int32)), pa.array(cuts, type=pa.binary())],
                names=["h", "s", "c1", "c2", "first", "back", "segment"],
            )


def repeats(segments: list[bytes], back: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """For each segment, which of its windows also start in another segment of its group at the same place from the anchor."""
    size = np.array([len(x) for x in segments])
    bound = np.concatenate(([0], np.cumsum(size)))
    flat = np.frombuffer(b"".join(segments), dtype=np.uint8)
    skip = back % BLOCK  # blocks are counted from the anchor
    n_blocks = np.maximum((size - skip) // BLOCK, 0)
    owner = np.repeat(np.arange(len(segments)), n_blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    start = bound[owner] + skip[owner] + nth * BLOCK
    # a block's symbol stands for its bytes and its anchor, so anchors never mix
    halves = np.lib.stride_tricks.sliding_window_view(flat, BLOCK)[start].copy().view(U64).reshape(-1, 2)
    key = np.empty(len(start), dtype=[("g", "i8"), ("x", "u8"), ("y", "u8")])
    key["g"], key["x"], key["y"] = group[owner], halves[:, 0], halves[:, 1]
    order = np.lexsort((key["y"], key["x"], key["g"]))
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate(([True], key[order][1:] != key[order][:-1]))) + 1
    # one string of all segments, each ended by a low symbol; the last symbol is the lowest
    string = np.ones(len(key) + len(segments) + 1, dtype=np.int64)
    where = np.arange(len(key)) + owner
    string[where] = rank
    string[-1] = 0
    block_of = np.full(len(string) + WHOLE, -1)
    block_of[where] = np.arange(len(key))
    sa = suffix_array(string)
    padded = np.concatenate((string, np.zeros(WHOLE, dtype=np.int64)))
    equal = np.ones(len(sa) - 1, dtype=bool)
    for d in range(WHOLE):
        equal &= padded[sa[:-1] + d] == padded[sa[1:] + d]
    left = np.zeros(len(string), dtype=np.int64)
    left[where] = n_blocks[owner] - nth
    enough = left[sa] >= WHOLE
    equal &= enough[:-1] & enough[1:]
    classes = np.cumsum(np.concatenate(([True], ~equal)))
    mate = np.zeros(len(sa), dtype=bool)
    mate[1:] |= equal
    mate[:-1] |= equal
    block, cls = block_of[sa[mate]], classes[mate]
    found = [np.zeros(max(n - LENGTH + 1, 0), dtype=bool) for n in size]
    if not len(block):
        return found
    hashes = B.RunHash(flat)
    seg = owner[block]
    for p in range(BLOCK):
        w = start[block] - p
        ok = (w >= bound[seg]) & (w + LENGTH <= bound[seg + 1])
        w, c, s = w[ok], cls[ok], seg[ok]
        if len(w) < 2:
            continue
        h = hashes(w, w + LENGTH)
        o = np.lexsort((w - bound[s] - back[s], h, c))
        same = (c[o][1:] == c[o][:-1]) & (h[o][1:] == h[o][:-1])
        place = w - bound[s] - back[s]
        same &= place[o][1:] == place[o][:-1]
        k = np.flatnonzero(same)
        for lo in range(0, len(k), 20_000):
            x, y = w[o][k[lo : lo + 20_000]], w[o][k[lo : lo + 20_000] + 1]
            view = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)
            same[k[lo : lo + 20_000]] = (view[x] == view[y]).all(axis=1)
        twice = np.zeros(len(w), dtype=bool)
        twice[o[1:][same]] = True
        twice[o[:-1][same]] = True
        for i, at in zip(s[twice].tolist(), (w[twice] - bound[s[twice]]).tolist()):
            found[i][at] = True
    return found


def _digests(segment: bytes, back: int) -> list[bytes]:
    """Names of a segment's windows: their bytes and their place from the anchor."""
    return [hashlib.blake2b(segment[i : i + LENGTH], digest_size=16, salt=(back - i).to_bytes(8, "little", signed=True)).digest() for i in range(len(segment) - LENGTH + 1)]


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered byte ranges of each distinct segment, as starts and ends within it; of hot anchors the names of windows."""
    kind = pa.list_(pa.int32())
    for table, at in whole_groups(batches, 2):
        count, back = table.column("m").to_numpy(), table.column("back").to_numpy().astype(np.int64)
        hot = table.column("hot").to_numpy(zero_copy_only=False)
        text = table.column("segment").combine_chunks() if isinstance(table.column("segment"), pa.ChunkedArray) else table.column("segment")
        segments = text.to_pylist()
        window: list[np.ndarray] = [np.ones(max(len(x) - LENGTH + 1, 0), dtype=bool) for x in segments]
        group = np.repeat(np.arange(len(at) - 1), np.diff(at))
        # a group of one segment, or of copied segments only, has nothing to compare
        single = np.add.reduceat(count == 1, at[:-1])
        todo = np.flatnonzero((np.diff(at) > 1) & (single > 0) & ~hot[at[:-1]])
        held: list[int] = []
        blocks = 0
        for k, g in enumerate(todo):
            held.extend(range(at[g], at[g + 1]))
            blocks += sum(len(segments[i]) for i in range(at[g], at[g + 1])) // BLOCK
            if blocks >= _SORT_BLOCKS or k == len(todo) - 1:
                rows = np.array(held)
                for i, hit in zip(held, repeats([segments[i] for i in held], back[rows], group[rows])):
                    if count[i] == 1:
                        window[i] = hit
                held, blocks = [], 0
        for g in np.flatnonzero((np.diff(at) == 1) & (count[at[:-1]] == 1)):
            window[at[g]][:] = False
        for i in np.flatnonzero(hot):
            window[i][:] = False
        starts, ends = [], []
        for hit in window:
            edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
            starts.append(np.flatnonzero(edge == 1))
            ends.append(np.flatnonzero(edge == -1) + LENGTH - 1)
        keys = [_digests(segments[i], int(back[i])) if hot[i] else None for i in range(len(segments))]
        some = pa.array([len(x) > 0 or k is not None for x, k in zip(starts, keys)])
        out = pa.RecordBatch.from_arrays(
            [pa.array(table.column("h").to_numpy()), pa.array(table.column("s").to_numpy()), pa.array(count), pa.array(starts, type=kind), pa.array(ends, type=kind), pa.array(keys, type=pa.list_(pa.binary()))],
            names=["h", "s", "m", "starts", "ends", "keys"],
        )
        yield out.filter(some)


def _covered(distinct: DataFrame, hot: DataFrame, disk: Scratch) -> DataFrame:
    """``h, s, starts, ends`` of the distinct segments ``h, s, m, back, segment`` that hold repeats."""
    marked = distinct.join(hot.select("h", F.lit(True).alias("hot")), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    dealt = marked.select("h", F.when(F.col("hot"), F.col("s")).otherwise(0).alias("sub"), "s", "m", "back", "segment", "hot").repartition("h", "sub").sortWithinPartitions("h", "sub", "s")
    found = disk.keep(dealt.mapInArrow(_match, "h long, s long, m long, starts array<int>, ends array<int>, keys array<binary>"))
    windows = found.select("h", "s", "m", F.posexplode("keys").alias("at", "key"))
    twice = disk.keep(windows.groupBy("h", "key").agg(F.sum("m").alias("m")).filter("m > 1").select("h", "key"))
    late = windows.join(twice, ["h", "key"]).groupBy("h", "s").agg(F.collect_list("at").alias("starts"))
    late = late.withColumn("ends", F.transform("starts", lambda x: x + LENGTH))
    return found.filter("keys is null").select("h", "s", "starts", "ends").unionByName(late)


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed spans and what is kept, from a text, its copies and its covered ranges."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        sizes, spans, kept = [], [], []
        for i in range(batch.num_rows):
            raw = np.frombuffer(batch.column(1)[i].as_buffer(), dtype=np.uint8)
            n = len(raw)
            sizes.append(n)
            cover = np.zeros(n + 1, dtype=np.int64)
            if (batch.column(2)[i].as_py() or 1) > 1 and n >= LENGTH:
                cover[0], cover[n] = 1, -1
            else:
                for part in batch.column(3)[i].as_py() or ():
                    for s, e in zip(part["starts"], part["ends"]):
                        cover[part["first"] + s] += 1
                        cover[part["first"] + e] -= 1
            gone = np.cumsum(cover)[:-1] > 0
            edge = np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
            kept.append(raw[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, type=pa.int64()), pa.array(spans, type=kind), pa.array(kept, type=pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for every row: removed byte ranges and the bytes that remain.

    A null text is empty; texts of fewer than ``LENGTH`` bytes lose nothing.
    Rows are texts of their own even where they repeat a ``doc_id``: the
    copies of a text of ``LENGTH`` bytes or more all lose all of it.  Texts
    are named by 128 bits of their md5, so null and repeated ids do no harm;
    ids are integers.  No occurrence is the first, so there are no ties.  An
    empty table gives an empty one; further columns are left.
    A very long text is searched for anchors in parts of 4 MB.
    """
    disk = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    half = lambda k: F.conv(F.substring(F.md5(text), k, 16), 16, -10).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), half(1).alias("c1"), half(17).alias("c2"), text.cast("binary").alias("text"))
    # one row per text; of its copies, one is read again below
    copies = disk.keep(rows.withColumn("row", F.struct(F.col("doc_id").cast("long").alias("id"))).groupBy("c1", "c2").agg(F.count("*").alias("m"), F.min("row.id").alias("one")))

    found = rows.select("c1", "c2", "text").filter(F.octet_length("text") >= LENGTH).mapInArrow(_find, "h long, c1 long, c2 long, spot long")
    occurrence = F.struct("c1", "c2", "spot")
    # small sides are written first, so that Spark may split the large side of a join where an anchor is hot
    twice = disk.keep(found.groupBy("h").agg(F.min(occurrence).alias("a"), F.max(occurrence).alias("b")).filter("a != b").select("h"))
    spots = found.join(twice, "h").groupBy("c1", "c2").agg(F.collect_set(F.struct("h", "spot")).alias("spots"))
    spots = spots.join(copies, ["c1", "c2"])
    read = rows.withColumn("one", F.col("doc_id").cast("long")).drop("doc_id")
    named = read.join(spots, (read.c1 == spots.c1) & (read.c2 == spots.c2) & read.one.eqNullSafe(spots.one)).select(read.c1, read.c2, "text", "spots")
    segments = disk.keep(named.mapInArrow(_segments, "h long, s long, c1 long, c2 long, first long, back int, segment binary"))

    # (c1, c2, first) once, should a row repeat its id and its text
    places = segments.select("h", "s", "c1", "c2", "first").distinct()
    several = disk.keep(places.groupBy("h", "s").agg(F.count("*").alias("m")))
    distinct = segments.groupBy("h", "s").agg(F.first("back").alias("back"), F.first("segment").alias("segment")).join(several, ["h", "s"]).select("h", "s", "m", "back", "segment")
    hot = disk.keep(several.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_SEGMENTS))
    covered = _covered(distinct, hot, disk)
    parts = places.join(covered, ["h", "s"]).groupBy("c1", "c2").agg(F.collect_list(F.struct("first", "starts", "ends")).alias("parts"))
    info = disk.keep(copies.filter("m > 1").select("c1", "c2", "m").join(parts, ["c1", "c2"], "full_outer"))
    out = rows.join(info, ["c1", "c2"], "left").select("doc_id", "text", "m", "parts")
    return out.mapInArrow(_remover, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def report(found: DataFrame) -> DataFrame:
    """The contract's digest columns of :func:`remove_repeated_strings`."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
