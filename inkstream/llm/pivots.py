"""Near-duplicate vectors by a pivot-permutation index.

A sample of bounded size gives reference points (pivots), and a vector is
described by its nearest pivots in order.  Inverted lists hold the vectors of
each pivot; two that share enough pivots are candidates and are verified with
their whole vectors, once, in the list of the first pivot they share.

Vectors so close to their nearest pivot that any two of them must be linked (at
most half the linking angle away) form the pivot's *core*.  Links inside a core
are counted and not looked for, so a group of near copies costs what its rows
cost; from outside, a vector asks those cores in its own list of pivots that
the triangle inequality leaves open.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import buffers as B
from .components import components
from .store import Scratch
from .vptree import usable

LINK = 0.95
#: Pivots that describe a vector, and those that two candidates share at least.
PREFIX, SHARED = 8, 3
#: Pivots: so many times the root of the number of vectors, between these bounds; the sample holds twice as many, in so many bytes at most.
PIVOTS_PER_ROOT, FEWEST, MOST, SAMPLE_BYTES = 4, 64, 16384, 64 << 20
#: Sampled vectors as close as this stand for one pivot, their mean.
APART = 0.9
#: Rows of a list or a core that one task compares with as many others.
BLOCK = 2048
#: Angles are compared with this margin, well above their rounding.
MARGIN = 1e-7


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision, whatever their size."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def matrix(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _named(batches):
    """Rows with two hashes of their vectors; vectors that take no part have none."""
    for batch in batches:
        ids, vectors = batch.columns
        n = len(batch)
        ok = usable(vectors) & ~np.asarray(ids.is_null())
        size = np.array(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        marks = np.zeros((2, n), dtype=np.uint64)
        own = vectors.filter(pa.array(ok))
        flat = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        if ok.any():
            starts = np.concatenate(([0], np.cumsum(size[ok])[:-1]))
            place = np.arange(len(flat)) - np.repeat(starts, size[ok])
            with np.errstate(over="ignore"):
                for k in (0, 1):
                    salt = B.stream(40 + k, int(size[ok].max()))
                    marks[k, ok] = B.mix(np.add.reduceat(B.mix(flat.view(np.uint64) + salt[place]) * (salt[place] | np.uint64(1)), starts) + size[ok].astype(np.uint64))
        yield pa.RecordBatch.from_arrays([ids, vectors, pa.array(size.astype(np.int32), mask=~ok), *(pa.array(m.view(np.int64), mask=~ok) for m in marks)], names=["id", "v", "dim", "d1", "d2"])


def fit(sample: np.ndarray, most: int) -> np.ndarray:
    """Pivots of a sample of unit vectors: groups of close ones give their mean, those of most members first."""
    leaders = np.zeros((0, sample.shape[1]))
    for a in range(0, len(sample), 512):
        part = sample[a : a + 512]
        part = part[(part @ leaders.T).max(axis=1, initial=-1) < APART]
        fresh = []
        near = part @ part.T >= APART
        free = np.ones(len(part), dtype=bool)
        for i in range(len(part)):
            if free[i]:
                fresh.append(i)
                free &= ~near[i]
        leaders = np.concatenate((leaders, part[fresh]))
    sums, members = np.zeros_like(leaders), np.zeros(len(leaders), dtype=np.int64)
    for a in range(0, len(sample), 512):
        part = sample[a : a + 512]
        cos = part @ leaders.T
        best = cos.argmax(axis=1)
        near = cos[np.arange(len(part)), best] >= APART
        np.add.at(sums, best[near], part[near])
        members += np.bincount(best[near], minlength=len(leaders))
    order = np.argsort(-members, kind="stable")[:most]
    return unit(sums[order]) if len(order) else leaders


def _places(pivots, half: float):
    """Each vector's nearest pivots, the core it is in (or -1) and the cores that it must ask."""

    def run(batches):
        for batch in batches:
            n = len(batch)
            dims = batch.column(2).to_numpy()
            prefix, probes, core = [None] * n, [None] * n, np.full(n, -1, dtype=np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                known = pivots.value.get(dim)
                if known is None:
                    for i in at:
                        prefix[i], probes[i] = [], []
                    continue
                for a in range(0, len(at), 1024):
                    rows = at[a : a + 1024]
                    cos = unit(matrix(batch.column(1).take(pa.array(rows)), dim)) @ known.T
                    k = min(PREFIX, len(known))
                    first = np.argsort(-cos, axis=1, kind="stable")[:, :k] if k == len(known) else np.argpartition(-cos, k - 1, axis=1)[:, :k]
                    angle = np.arccos(np.clip(np.take_along_axis(cos, first, axis=1), -1, 1))
                    by = np.lexsort((first, angle), axis=1)
                    first, angle = np.take_along_axis(first, by, axis=1), np.take_along_axis(angle, by, axis=1)
                    core[rows] = np.where(angle[:, 0] <= half - MARGIN, first[:, 0], -1)
                    asks = angle <= 3 * half + MARGIN
                    asks[core[rows] >= 0, 0] = False
                    for i, f, q in zip(rows, first, asks):
                        prefix[i], probes[i] = f, f[q]
            arrays = [pa.array(x, type=pa.list_(pa.int32())) for x in (prefix, probes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(core), *arrays], names=[*batch.schema.names, "core", "prefix", "probes"])

    return run


def _padded(column: pa.ChunkedArray, width: int, fill: int) -> np.ndarray:
    out = np.full((len(column), width), fill, dtype=np.int32)
    for i, x in enumerate(column.to_pylist()):
        out[i, : len(x)] = x
    return out


_LINKS = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("rep", pa.int64()), ("root", pa.int64())])


def _told(table: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.Table:
    """For links ``i, j`` of a group's rows: what each row's links weigh, and a forest over their representatives."""
    weight = table["copies"].to_numpy()
    links = np.bincount(i, weights=weight[j], minlength=len(weight)) + np.bincount(j, weights=weight[i], minlength=len(weight))
    root = np.arange(len(weight))
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    out = np.flatnonzero(links > 0)
    rep = table["rep"].to_numpy()
    return pa.Table.from_arrays([pa.array(table["node"].to_numpy()[out]), pa.array(np.rint(links[out]).astype(np.int64)), pa.array(rep[out]), pa.array(rep[root[out]])], schema=_LINKS)


def _verified(u: np.ndarray, i: np.ndarray, j: np.ndarray, link: float) -> np.ndarray:
    ok = np.zeros(len(i), dtype=bool)
    for a in range(0, len(i), 1 << 16):
        ok[a : a + (1 << 16)] = np.einsum("ij,ij->i", u[i[a : a + (1 << 16)]], u[j[a : a + (1 << 16)]]) >= link
    return ok


def _listed(link: float):
    """Links of a pair of blocks of a pivot's list: rows that share pivots enough, this one first, verified."""

    def run(table: pa.Table) -> pa.Table:
        dim, pivot, i, j = (table[c][0].as_py() for c in ("dim", "pivot", "i", "j"))
        u, block = unit(matrix(table["v"], dim)), table["block"].to_numpy()
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        prefix = _padded(table["prefix"], PREFIX, -1)
        ends_i, ends_j = [], []
        for a in range(0, len(left), 512):
            rows = left[a : a + 512]
            shared, lower = np.zeros((len(rows), len(right)), dtype=np.uint8), np.zeros((len(rows), len(right)), dtype=bool)
            for x in range(PREFIX):
                for y in range(PREFIX):
                    same = (prefix[rows, x][:, None] == prefix[right, y][None]) & (prefix[rows, x] >= 0)[:, None]
                    shared += same
                    lower |= same & (prefix[rows, x] < pivot)[:, None]
            enough = np.minimum(SHARED, (prefix[rows] >= 0).sum(axis=1))[:, None]
            fits = (shared >= enough) & ~lower
            if i == j:
                fits &= rows[:, None] < right[None]
            p, q = np.nonzero(fits)
            ok = _verified(u, rows[p], right[q], link)
            ends_i.append(rows[p[ok]])
            ends_j.append(right[q[ok]])
        return _told(table, *(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (ends_i, ends_j)))

    return run


def _asked(link: float):
    """Links between some members of a core and some rows that ask it."""

    def run(table: pa.Table) -> pa.Table:
        dim, pivot = (table[c][0].as_py() for c in ("dim", "pivot"))
        u, core = unit(matrix(table["v"], dim)), table["core"].to_numpy()
        asks = table["asks"].to_numpy(zero_copy_only=False)
        members, others = np.flatnonzero(~asks), np.flatnonzero(asks)
        probes = _padded(table["probes"], PREFIX, -1)
        ends_i, ends_j = [], []
        for a in range(0, len(members), 512):
            rows = members[a : a + 512]
            fits = u[rows] @ u[others].T >= link - 1e-9
            # members that ask the other's core too have the pair there, if that core comes first
            early = (core[others] >= 0) & (core[others] < pivot)
            for x in range(PREFIX):
                fits &= ~((probes[rows, x][:, None] == core[others][None]) & early[None])
            p, q = np.nonzero(fits)
            ok = _verified(u, rows[p], others[q], link)
            ends_i.append(rows[p[ok]])
            ends_j.append(others[q[ok]])
        return _told(table, *(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (ends_i, ends_j)))

    return run


def _blocks(n: str) -> Column:
    return F.ceil(F.col(n) / F.lit(BLOCK))


def _own_block(n: str) -> Column:
    return F.pmod(F.xxhash64("node", F.lit("block")), _blocks(n))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", link: float = LINK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Rows are linked if the cosine of their vectors, in double precision, is
    ``link`` or more; equal vectors are.  Vectors that are null, zero or hold a
    null or non-finite component link with nothing, as do null ids (which are
    kept, without a component); vectors of different lengths have no cosine.
    ``n_links`` counts rows, so rows that repeat an id and a vector count each
    other.  One id on several vectors: each row has its own vector's links.
    The index is exact but for pairs outside cores that share fewer than
    ``SHARED`` of their ``PREFIX`` nearest pivots, and vectors whose core's
    pivot is not among those ``PREFIX``.  An empty table gives an empty one;
    further columns are left.
    """
    spark = vectors.sparkSession
    disk = Scratch(spark)
    half = math.acos(link) / 2
    kind, element = vectors.schema[id_col].dataType.simpleString(), vectors.schema[vec_col].dataType.elementType.simpleString()
    element = element if element in ("float", "double") else "double"
    narrow = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast(f"array<{element}>").alias("v"))
    rows = disk.keep(narrow.mapInArrow(_named, f"id {kind}, v array<{element}>, dim int, d1 long, d2 long"))
    classes = rows.filter("dim is not null").groupBy("d1", "d2").agg(F.first("v").alias("v"), F.first("dim").alias("dim"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = disk.keep(classes.select(F.monotonically_increasing_id().alias("node"), "v", "dim", "d1", "d2", "least", "copies"))

    # the sample is chosen by a hash and bounded in rows and bytes
    n, widest = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    most = int(min(MOST, max(FEWEST, PIVOTS_PER_ROOT * math.sqrt(n))))
    wanted = min(2 * most, SAMPLE_BYTES // (8 * (widest or 1)))
    drawn = classes.filter(F.pmod(F.xxhash64("d1", "d2"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / max(1, n)))).select("v", "dim", "d1", "d2").toArrow()
    pivots = {}
    for dim in sorted(set(drawn["dim"].to_pylist())):
        own = drawn.filter(pc.equal(drawn["dim"], dim)).sort_by([("d1", "ascending"), ("d2", "ascending")])
        pivots[dim] = fit(unit(matrix(own["v"], dim)), most)
    known = spark.sparkContext.broadcast(pivots)

    placed = classes.select("node", "v", "dim", "copies").mapInArrow(_places(known, half), f"node long, v array<{element}>, dim int, copies long, core int, prefix array<int>, probes array<int>")
    placed = disk.keep(placed)
    cores = placed.filter("core >= 0").groupBy("dim", "core").agg(F.sum("copies").alias("weight"), F.min("node").alias("head"), F.count(F.lit(1)).alias("members"))
    cores = disk.keep(cores)
    placed = placed.join(cores.select("dim", "core", "weight", "head"), ["dim", "core"], "left")
    placed = disk.keep(placed.withColumn("rep", F.coalesce("head", "node")).withColumn("inside", F.coalesce("weight", "copies") - 1).drop("head", "weight"))
    schema = "node long, links long, rep long, root long"

    # lists of what is in no core
    lists = placed.filter("core < 0").select("node", "v", "dim", "copies", "rep", "prefix", F.explode(F.when(F.size("prefix") > 0, F.col("prefix")).otherwise(F.array(F.lit(-1)))).alias("pivot"))
    met = disk.keep(lists.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("met")).filter("met > 1"))
    own = F.col("block")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), _blocks("met") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    dealt = lists.join(met, ["dim", "pivot"]).withColumn("block", _own_block("met")).withColumn("pair", F.explode(pairs)).select("*", "pair.i", "pair.j").drop("pair", "met")
    listed = dealt.groupBy("dim", "pivot", "i", "j").applyInArrow(_listed(link), schema)

    # cores that are asked
    asking = placed.select("node", "v", "dim", "copies", "rep", "core", "probes", F.explode("probes").alias("pivot"))
    asked = asking.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("asking"))
    asked = disk.keep(asked.join(cores.select("dim", F.col("core").alias("pivot"), "members"), ["dim", "pivot"]))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), _blocks(n) - 1))
    columns = ["node", "v", "dim", "copies", "rep", "core", "probes", "pivot"]
    others = asking.join(asked, ["dim", "pivot"]).select(*columns, F.lit(True).alias("asks"), _own_block("asking").alias("j"), every("members").alias("i"))
    inner = placed.filter("core >= 0").withColumn("pivot", F.col("core")).join(asked, ["dim", "pivot"]).select(*columns, F.lit(False).alias("asks"), _own_block("members").alias("i"), every("asking").alias("j"))
    across = inner.unionByName(others).groupBy("dim", "pivot", "i", "j").applyInArrow(_asked(link), schema)

    found = disk.keep(listed.unionByName(across))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = disk.keep(found.filter("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    groups = disk.keep(components(edges, disk)).withColumnRenamed("node", "rep")
    counted = placed.select("node", "rep", "inside").join(links, "node", "left").join(groups, "rep", "left")
    counted = counted.select("node", (F.col("inside") + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    counted = disk.keep(counted.join(classes.select("node", "d1", "d2", "least"), "node"))
    smallest = disk.keep(counted.groupBy("component").agg(F.min("least").alias("smallest")))
    judged = disk.keep(counted.join(smallest, "component").select("d1", "d2", "n_links", "smallest"))
    out = rows.select("id", "d1", "d2").join(judged, ["d1", "d2"], "left")
    component = F.coalesce("smallest", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
