"""MinHash near-duplicates by a multi-index Hamming join.

A document's set holds the hashes of its distinct five-word shingles.  Equal
sets are one class.  A class has a signature of ``SYMBOLS`` MinHash values of
16 bits.  The signature is cut into chunks of four values; two signatures that
differ in at most ``MAX_DISTANCE`` values have, by pigeonhole, a chunk with at
most one differing value.  Each chunk is therefore indexed once for every
place where that one error may be, and such a pair meets under at least one
key.  Sets of similarity 0.75 exceed that distance with a chance of about
1e-5.  What meets is confirmed on the full sets; nothing is capped.

No step makes a row per pair.  Within a key, and then within a cluster of
classes whose signatures are close, a task walks from class to class and
compares only with those not reached yet; it returns a spanning forest.  A key
or cluster of more than a block of classes is dealt over pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buffers as B
from .components import components
from .store import Scratch

U64 = np.uint64
SYMBOLS = 64
CHUNK = 4
#: Classes of a key, or of a cluster, that one task compares; more are dealt over pairs of blocks of this size.
KEY_BLOCK = 4096
CLUSTER_BLOCK = 512
MAX_DISTANCE = 2 * (SYMBOLS // CHUNK) - 1
_ODD = B.stream(7, SYMBOLS) | U64(1)
_PLACE = B.stream(11, 8)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, with row bounds."""
    low = B.LOWER[buf]
    starts, ends = B.runs(low, offs, B.SPACED)
    words = B.RunHash(low)(starts, ends)
    first = B.counts_in(starts, offs)
    n_words = np.diff(first)
    sets = []
    with np.errstate(over="ignore"):
        joined = np.zeros(max(len(words) - size + 1, 0), dtype=U64)
        for k in range(size if len(joined) else 0):
            joined += words[k : k + len(joined)] * (_PLACE[k] | U64(1))
        joined = B.mix(joined)
        for r in range(len(n_words)):
            n, a = n_words[r], first[r]
            if n >= size:
                h = joined[a : a + n - size + 1].copy()
                h.sort()
                sets.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
            elif n:
                whole = (words[a : a + n] * (_PLACE[:n] | U64(1))).sum(dtype=U64)
                sets.append(B.mix(np.array([whole + U64(n)], dtype=U64)))
            else:
                sets.append(np.zeros(0, dtype=U64))
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, dtype=U64)), bounds


def signatures(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16-bit MinHash values, a row of ``SYMBOLS`` for each non-empty set."""
    begins = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(begins), SYMBOLS), dtype=np.uint16)
    with np.errstate(over="ignore"):
        for j in range(SYMBOLS if len(begins) else 0):
            least = np.minimum.reduceat(flat * _ODD[j], begins)
            out[:, j] = (B.mix(least) >> U64(48)).astype(np.uint16)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offs in B.pieces(batch.column(2)):
            flat, bounds = shingle_sets(buf, offs)
            sizes = np.diff(bounds)
            full = sizes > 0
            digests = np.zeros((2, b - a), dtype=U64)
            if full.any():
                begins = bounds[:-1][full]
                with np.errstate(over="ignore"):
                    for i, salt in enumerate(B.stream(23, 2)):
                        digests[i, full] = B.mix(np.add.reduceat(B.mix(flat ^ salt), begins) + sizes[full].astype(U64))
            sigs = signatures(flat, bounds)
            data = np.concatenate(([0], np.cumsum(full * (SYMBOLS * 2)))).astype(np.int32)
            sig = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(data), pa.py_buffer(np.ascontiguousarray(sigs))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sizes.astype(np.int64)), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), sig],
                names=["doc_id", "same", "n_shingles", "d1", "d2", "sig"],
            )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hash of the text, set size, 128-bit set digest and signature of every row."""
    return _rows(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, same long, n_shingles long, d1 long, d2 long, sig binary")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, same, text``: a hash of the text tells rows of one id apart."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("same"), text.alias("text"))


def _sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)


def _index_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = B.stream(31, SYMBOLS) | U64(1)
    n_keys = SYMBOLS
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            with np.errstate(over="ignore"):
                v = (_sig_matrix(part.column(1)).astype(U64) + U64(1)) * weights
                v = B.mix(v).reshape(len(part), SYMBOLS // CHUNK, CHUNK)
                # without the value at one place, for each place where an error may be
                keys = B.mix(v.sum(axis=2, dtype=U64)[:, :, None] - v + B.stream(37, n_keys).reshape(SYMBOLS // CHUNK, CHUNK))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), n_keys))],
                names=["key", "node"],
            )


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each node once; rows that repeat an id and a text meet in one task."""
    done: set[int] = set()
    for batch in batches:
        new = [n not in done and not done.add(n) for n in batch.column(0).to_pylist()]
        batch = batch.filter(pa.array(new, type=pa.bool_()))
        for a, b, buf, offs in B.pieces(batch.column(1)):
            flat, bounds = shingle_sets(buf, offs)
            data = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(bounds * 8), pa.py_buffer(np.ascontiguousarray(flat))])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), data.cast(pa.binary())], names=["node", "shingles"])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups with group bounds; the first ``keys`` columns name a group."""
    held: list[pa.RecordBatch] = []

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        for c in table.columns[:keys]:
            v = c.to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.concatenate((np.flatnonzero(np.concatenate(([True], new[1:]))), [table.num_rows]))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        same = len(held) > 1 and all(held[0].column(k)[0] == batch.column(k)[batch.num_rows - 1] for k in range(keys))
        if same:
            continue
        table = pa.Table.from_batches(held)
        at = bounds(table)
        held = table.slice(int(at[-2])).combine_chunks().to_batches()
        if len(at) > 2:
            yield table.slice(0, int(at[-2])).combine_chunks(), at[:-1]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, bounds(table)


def forest(n: int, near) -> np.ndarray:
    """For each of ``n`` items the first item of its component; ``near(i, rest)`` tells which of ``rest`` link with i."""
    root = np.arange(n)
    rest = np.arange(1, n)
    first, stack = 0, [0]
    while len(rest):
        if not stack:
            first, rest = int(rest[0]), rest[1:]
            stack = [first]
            continue
        hit = near(stack.pop(), rest)
        if hit.any():
            root[rest[hit]] = first
            stack.extend(rest[hit].tolist())
            rest = rest[~hit]
    return root


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the pairs of a key whose signatures are within ``MAX_DISTANCE``."""
    for table, at in whole_groups(batches, 3):
        node = table.column("node").to_numpy()
        size = table.column("n").to_numpy()
        sig = _sig_matrix(table.column("sig"))
        begin = np.repeat(at[:-1], np.diff(at))
        fits = 100 * np.minimum(size, size[begin]) >= 75 * np.maximum(size, size[begin])
        linked = fits & ((sig != sig[begin]).sum(axis=1) <= MAX_DISTANCE)
        root = np.where(linked, begin, -1)
        for g in np.flatnonzero(np.add.reduceat(~linked, at[:-1]) > 0) if len(at) > 1 else []:
            lo, hi = at[g], at[g + 1]
            own, n = sig[lo:hi], size[lo:hi]

            def near(i, rest):
                ok = 100 * np.minimum(n[rest], n[i]) >= 75 * np.maximum(n[rest], n[i])
                ok[ok] = (own[rest[ok]] != own[i]).sum(axis=1) <= MAX_DISTANCE
                return ok

            root[lo:hi] = lo + forest(hi - lo, near)
        out = root != np.arange(len(root))
        yield pa.RecordBatch.from_arrays([pa.array(node[root[out]]), pa.array(node[out])], names=["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the links of a cluster, by whole sets."""
    for table, at in whole_groups(batches, 3):
        node = table.column("node").to_numpy()
        column = table.column("shingles")
        ends_a, ends_b = [], []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            sets = [np.frombuffer(column[i].as_buffer(), dtype=U64) for i in range(lo, hi)]
            size = np.array([len(x) for x in sets])
            flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
            bound = np.concatenate(([0], np.cumsum(size)))
            mark = np.zeros(int(flat.max()) + 1, dtype=bool)

            def near(i, rest):
                ok = 100 * np.minimum(size[rest], size[i]) >= 75 * np.maximum(size[rest], size[i])
                some = rest[ok]
                if len(some):
                    mine = flat[bound[i] : bound[i + 1]]
                    mark[mine] = True
                    theirs = np.concatenate([flat[bound[j] : bound[j + 1]] for j in some])
                    starts = np.concatenate(([0], np.cumsum(size[some])[:-1]))
                    common = np.add.reduceat(mark[theirs].astype(np.int64), starts)
                    mark[mine] = False
                    ok[ok] = 100 * common >= 75 * (size[some] + size[i] - common)
                return ok

            root = lo + forest(hi - lo, near)
            out = np.flatnonzero(root != np.arange(lo, hi))
            ends_a.append(node[root[out]])
            ends_b.append(node[lo + out])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ends_a)), pa.array(np.concatenate(ends_b))], names=["a", "b"])


def _blocks(rows: DataFrame, group: str, count: str, block: int) -> DataFrame:
    """Adds ``i, j``: groups of at most ``block`` rows are one; of larger ones each pair of blocks is a group."""
    n = F.ceil(F.col(count) / F.lit(block))
    own = F.pmod(F.xxhash64("node", F.lit("block")), n)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    dealt = rows.withColumn("_pair", F.explode(F.when(F.col(count) <= block, F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))).otherwise(pairs)))
    dealt = dealt.withColumns({"i": F.col("_pair.i"), "j": F.col("_pair.j")}).drop("_pair", count)
    return dealt.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Null, empty and blank texts have empty sets, which link with nothing.
    Every row is returned; rows that repeat a ``doc_id`` each get what their
    own text's class gets.  A null ``doc_id`` has a null component and is
    kept; other ids are integers.  An empty table gives an empty result; other columns are ignored.
    A very long text is worked on alone, at some 60 times its bytes.
    """
    return _judged(docs, id_col, text_col).drop("same")


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """:func:`near_duplicates` with the hash of each row's text."""
    disk = Scratch(docs.sparkSession)
    prints = disk.keep(fingerprints(docs, id_col, text_col))
    classes = (
        prints.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("d1", "d2")
        .agg(F.min(F.struct("doc_id", "same")).alias("one"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    )
    # a class is a set of shingles, so its name is its own: written with the table, it stays the same
    classes = disk.keep(classes.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "one", "n", "sig"))
    keys = classes.select("node", "sig").mapInArrow(_index_keys, "key long, node long")
    # small sides are written first, so that Spark may split the large side of a join where a key is hot
    several = disk.keep(keys.groupBy("key").agg(F.count("*").alias("met")).filter("met > 1"))
    shared = keys.join(several, "key").join(classes.select("node", "n", "sig"), "node").select("key", "node", "n", "sig", "met")
    shared = _blocks(shared, "key", "met", KEY_BLOCK).select("key", "i", "j", "node", "n", "sig")
    close = disk.keep(shared.mapInArrow(_close, "a long, b long").distinct())
    clusters = disk.keep(components(close, disk))

    # the text of each class that is in a cluster: the one its first row has
    linked = classes.join(clusters.select("node"), "node").select("node", F.col("one.doc_id").alias("doc_id"), F.col("one.same").alias("same"))
    sets = _rows(docs, id_col, text_col).join(linked, ["doc_id", "same"]).select("node", "text").mapInArrow(_sets_of, "node long, shingles binary")
    sizes = disk.keep(clusters.groupBy("component").agg(F.count("*").alias("met")))
    members = clusters.join(sizes, "component").withColumnRenamed("component", "cluster").join(sets, "node")
    members = _blocks(members, "cluster", "met", CLUSTER_BLOCK).select("cluster", "i", "j", "node", "shingles")
    links = disk.keep(members.mapInArrow(_confirm, "a long, b long").distinct())
    groups = disk.keep(components(links, disk))

    # a group is named by the smallest id that has one of its classes
    least = classes.select("node", F.col("one.doc_id").alias("least"))
    grouped = groups.join(least, "node")
    smallest = disk.keep(grouped.groupBy("component").agg(F.min("least").alias("smallest")))
    named = grouped.join(smallest, "component").select("node", "smallest")
    of_class = disk.keep(classes.select("d1", "d2", "node").join(least, "node").join(named, "node", "left").select("d1", "d2", F.coalesce("smallest", "least").alias("smallest")))
    member = prints.select("doc_id", "same", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    component = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("smallest", "doc_id"))
    return member.select("doc_id", "n_shingles", component.alias("component_id"), "same").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component those with its smallest id.

    A row goes by its id and its own text, so another text under the id of a
    copy stays; rows without an id stay.
    """
    ident, same, own = B.unused(docs.columns, "gone_id", "gone_text", "own_text")
    gone = _judged(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias(ident), F.col("same").alias(same)).distinct()
    marked = docs.withColumn(own, F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    return marked.join(gone, (F.col(f"`{id_col}`").cast("long") == F.col(ident)) & (F.col(own) == F.col(same)), "left_anti").drop(own)
