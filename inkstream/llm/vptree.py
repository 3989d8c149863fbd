"""Nearest neighbours by vantage-point trees, one per shard of rows.

The largest inner product is made a nearest Euclidean neighbour: with M the
largest norm, a row gets the further coordinate sqrt(M^2 - |x|^2) and a query
0, so distances order as inner products do.  A shard's tree splits its points
at the median distance from a vantage point.  A query leaves out a side that
the triangle inequality rules out; the query's radius is multiplied by
``factor`` for that test, so 1 is exact and less looks at less.

A task holds a shard's rows, builds its tree once and lets the queries pass by
batch after batch.  All queries of a batch walk the tree together: a node holds
the numbers of the queries that reach it, and a leaf is one matrix product.
What the shards find is cut to the best of each query before and after the
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

K = 20
#: Part of the radius that must be reached before a side is left out; 1 is exact.
FACTOR = 0.85
LEAF = 96
#: Rows of a shard, in expectation, and queries that one task lets pass a tree.
SHARD_ROWS = 8192
BLOCK_QUERIES = 65536
#: Partitions that shards are dealt over, at most.
MOST_TASKS = 10_000


def usable(vectors: pa.Array) -> np.ndarray:
    """Rows that are not null or zero and hold no null or non-finite component."""
    ok = np.zeros(len(vectors), dtype=bool)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.array([n or 0 for n in vectors.value_lengths().to_pylist()])
    bound = np.concatenate(([0], np.cumsum(size)))
    full = size > 0
    if full.any():
        begins = bound[:-1][full]
        finite = np.logical_and.reduceat(np.isfinite(flat), begins)
        nonzero = np.logical_or.reduceat(flat != 0, begins)
        ok[full] = finite & nonzero
    return ok


class Nearest:
    """The best ``k`` candidates of each query so far, with ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """``score`` has a row for each of ``rows``; -inf takes no part."""
        k = self.score.shape[1]
        every = np.concatenate((self.score[rows], score), axis=1)
        names = np.concatenate((self.ids[rows], np.broadcast_to(ids, score.shape)), axis=1)
        order = np.lexsort((names, -every), axis=1)[:, :k]
        self.score[rows] = np.take_along_axis(every, order, axis=1)
        self.ids[rows] = np.take_along_axis(names, order, axis=1)


class Tree:
    """A vantage-point tree over the distinct vectors of a shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, k: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        distinct, which = np.unique(vectors, axis=0, return_inverse=True)
        which = which.ravel()
        # of equal vectors only the k+1 smallest ids can be among a query's k nearest, one of them its own; of rows of one id, k
        by = np.argsort(which, kind="stable")
        place = np.arange(len(by))
        fresh = np.concatenate(([True], which[by][1:] != which[by][:-1]))
        named = fresh | np.concatenate(([True], ids[by][1:] != ids[by][:-1]))
        seen = np.cumsum(named)
        nth_id = seen - seen[np.maximum.accumulate(np.where(fresh, place, 0))]
        nth_row = place - np.maximum.accumulate(np.where(named, place, 0))
        stays = by[(nth_id <= k) & (nth_row < k)]
        self.ids, self.point = ids[stays], which[stays]
        self.first = np.searchsorted(self.point, np.arange(len(distinct) + 1))
        self.vectors = distinct
        self.lifted = np.hstack([distinct, np.sqrt(np.maximum(top**2 - (distinct**2).sum(axis=1), 0))[:, None]])
        self.root = self._build(np.arange(len(distinct)))

    def _build(self, points: np.ndarray):
        if len(points) <= LEAF:
            return points
        # the point farthest from the middle is a fixed, well spread choice
        middle = self.lifted[points].mean(axis=0)
        vantage = points[((self.lifted[points] - middle) ** 2).sum(axis=1).argmax()]
        d = np.sqrt(((self.lifted[points] - self.lifted[vantage]) ** 2).sum(axis=1))
        radius = np.median(d)
        near = d <= radius
        if near.all():
            return points
        return vantage, radius, self._build(points[near]), self._build(points[~near])

    def search(self, queries: np.ndarray, names: np.ndarray, top: float, best: Nearest, factor: float) -> None:
        lifted = np.hstack([queries, np.zeros((len(queries), 1))])
        norm = (queries**2).sum(axis=1)

        def radius(rows: np.ndarray) -> np.ndarray:
            # distance of the worst of the k best, from its inner product
            worst = best.score[rows, -1]
            return np.sqrt(np.maximum(top**2 + norm[rows] - 2 * worst, 0))

        def walk(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                entries = np.concatenate([np.arange(self.first[p], self.first[p + 1]) for p in node])
                ids = self.ids[entries]
                for a in range(0, len(rows), 2048):
                    own = rows[a : a + 2048]
                    # einsum adds each product's terms in one order, so equal vectors tie exactly in any shard
                    score = np.einsum("ij,kj->ik", queries[own], self.vectors[node])[:, np.searchsorted(node, self.point[entries])]
                    score[ids[None] == names[own][:, None]] = -np.inf
                    good = (score >= best.score[own, -1][:, None]).any(axis=1)
                    if good.any():
                        best.add(own[good], score[good], ids)
                return
            vantage, split, inner, outer = node
            d = np.sqrt(((lifted[rows] - self.lifted[vantage]) ** 2).sum(axis=1))
            inside = d <= split
            for mine, side, other in ((inside, inner, outer), (~inside, outer, inner)):
                own, gap = rows[mine], np.abs(d[mine] - split)
                walk(side, own)
                walk(other, own[gap <= factor * radius(own)])

        walk(self.root, np.arange(len(queries)))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = pa.array(usable(batch.column(1)))
        part = batch.filter(ok)
        flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        size = part.column(1).value_lengths().to_numpy()
        norm = np.sqrt(np.add.reduceat(flat**2, np.concatenate(([0], np.cumsum(size)[:-1])))) if len(part) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(norm), pa.array(size.astype(np.int32))], names=["id", "v", "norm", "dim"])


def _searcher(k: int, factor: float):
    """From rows sorted by shard, its points before its queries: each query's best of the shard."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, points, tree, top = None, [], None, 0.0
        for batch in batches:
            keys = np.stack([c.to_numpy() for c in batch.columns[:3]] + [batch.column(3).to_numpy(zero_copy_only=False)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if group != tuple(keys[a, :3]):
                    group, points, tree, top = tuple(keys[a, :3]), [], None, float(batch.column(6)[a].as_py())
                ids = batch.column(4).slice(a, b - a).to_numpy()
                vectors = batch.column(5).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if not keys[a, 3]:
                    points.append((ids, vectors))
                    continue
                if tree is None and points:
                    tree = Tree(*(np.concatenate(x) for x in zip(*points)), top, k)
                    points = []
                if tree is None:
                    continue
                found = Nearest(b - a, k)
                tree.search(vectors, ids, top, found, factor)
                r, j = np.nonzero(found.score > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(found.ids[r, j]), pa.array(found.score[r, j])], names=["query_id", "vec_id", "score"])

    return search


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` rows of largest inner product.

    ``is_query`` is a condition on the id column.  Vectors that are null, zero
    or hold a null or non-finite component take no part, nor do null ids.  A
    product needs two vectors of one length, so a query's candidates are the
    rows of its own length.  A query is never its own candidate.  Ties go to
    the smaller id; repeated rows are one candidate per row, and a query that
    repeats gets its answer once (one id with several vectors: the best of all
    of them).  Ids are integers; an empty table, or one without queries, gives
    an empty one, and further columns are left.  Rows are dealt by hash into shards; every
    query asks every shard of its length.
    """
    disk = Scratch(vectors.sparkSession)
    narrow = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    rows = disk.keep(narrow.mapInArrow(_checked, "id long, v array<double>, norm double, dim int")).withColumn("query", is_query(F.col("id")))
    lengths = rows.groupBy("dim").agg(F.max("norm").alias("top"), F.ceil(F.count("*") / shard_rows).alias("shards"), F.greatest(F.ceil(F.count_if("query") / block_queries), F.lit(1)).alias("blocks"))
    lengths = disk.keep(lengths)
    groups = lengths.agg(F.sum(F.col("shards") * F.col("blocks"))).first()[0] or 1
    known = rows.join(lengths, "dim")
    shard, block = (F.pmod(F.xxhash64("id", F.lit(name)), F.col(f"{name}s")) for name in ("shard", "block"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    points = known.select("dim", shard.alias("shard"), every("blocks").alias("block"), F.lit(False).alias("query"), "id", "v", "top")
    asked = known.filter("query").dropDuplicates(["id", "v"]).select("dim", every("shards").alias("shard"), block.alias("block"), F.lit(True).alias("query"), "id", "v", "top")
    dealt = points.unionByName(asked).repartition(min(3 * groups, MOST_TASKS), "dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "query", "id")
    found = dealt.mapInArrow(_searcher(k, factor), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
