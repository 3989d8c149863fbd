"""Merkle manifest of a table: a hash tree per group of rows and one over the groups.

Rows need their exact rank within their group, which a histogram of digits
gives without any sort of the whole: a row's key is its id as digits (then its
digest, so that rows of one id have an order too), rows are counted by a
prefix of it, counts are summed from the digits' first levels down, and only
the rows of one prefix, a bounded number, are numbered by a window.  Prefixes
that many rows share are counted again by further digits.

The digits of a rank, with the fanout as their base, are the path of a leaf in
a trie.  Nodes are reduced by their longest proper prefix, so a reduction never
holds more than ``fanout`` nodes, however large a group is.  Proofs come back
down the same levels: a node hands its children what its own proof holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

FANOUT = 16
#: Rows that a window numbers at most in expectation; prefixes of four times as many are divided again.
BUCKET_ROWS = 1024
#: Digits (of base 16) that one level of a histogram divides by.
LEVEL_DIGITS = 3
#: Copies of one row that are numbered in one step.
COPIES = 4096


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def id_digits(value: Column) -> Column:
    """Seventeen digits that order like the integers, null first."""
    return F.coalesce(F.concat(F.lit("1"), F.lpad(F.lower(F.hex(value.cast("long").bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")), F.lit("0"))


def _common(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _digits(n: int, bucket: int) -> int:
    return max(1, math.ceil(math.log(max(1.0, n / bucket), 16)))


def _bases(counts: DataFrame, group: list[str], shared: int, depth: int) -> DataFrame:
    """Adds to counts by prefix the weight of what precedes it in the group, and the group's, level by level."""
    cuts = [*range(depth, max(shared, depth - 60), -LEVEL_DIGITS)]
    coarse, finer = counts, []
    for cut in cuts[1:]:
        finer.append((coarse, cut))
        coarse = coarse.groupBy(*group, F.substring("prefix", 1, cut).alias("prefix")).agg(F.sum("weight").alias("weight"))
    before = lambda *by: F.coalesce(F.sum("weight").over(Window.partitionBy(*by).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = coarse.withColumn("base", before(*group)).withColumn("total", F.sum("weight").over(Window.partitionBy(*group)))
    for fine, cut in reversed(finer):
        above = found.select(*group, F.col("prefix").alias("above"), F.col("base").alias("base_above"), "total")
        fine = fine.withColumn("above", F.substring("prefix", 1, cut)).join(above, [*group, "above"])
        found = fine.withColumn("base", F.col("base_above") + before(*group, "above")).drop("above", "base_above")
    return found


def ranked(rows: DataFrame, group: list[str], key: Column, disk: Scratch, weight: Column | None = None, bucket: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``rank``, the weight of the rows of the group with a smaller key, and ``total``, the group's weight.

    ``key`` is a string of hexadecimal digits, one row of a group to a key;
    ``group`` columns hold no nulls.  The rows are read several times, so they
    should come from a written table.
    """
    own = F.lit(1).cast("long") if weight is None else weight
    n, low, high = rows.agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
    if n <= bucket:
        w = Window.partitionBy(*group)
        return rows.withColumn("rank", F.coalesce(F.sum(own).over(w.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum(own).over(w))
    shared = _common(low, high)
    return _ranked(rows, group, key, disk, own, bucket, shared, shared + _digits(n, bucket), "p")


def _ranked(rows: DataFrame, group: list[str], key: Column, disk: Scratch, own: Column, bucket: int, shared: int, depth: int, name: str) -> DataFrame:
    counts = rows.groupBy(*group, F.substring(key, 1, depth).alias("prefix")).agg(F.sum(own).alias("weight"), F.count(F.lit(1)).alias("rows"), F.min(key).alias("low"), F.max(key).alias("high"))
    counts = disk.keep(counts)
    places = F.sequence(F.lit(depth + 1), F.greatest(F.length("low"), F.length("high"), F.lit(depth + 1)))
    differ = F.array_position(F.transform(places, lambda i: F.substring("low", i, 1) == F.substring("high", i, 1)), False)
    most, further = counts.filter(F.col("rows") > 4 * bucket).agg(F.max("rows"), F.max(differ)).first()
    sums = _bases(counts.select(*group, "prefix", "weight"), group, shared, depth)
    sums = counts.select(*group, "prefix", "rows").join(sums.drop("weight"), [*group, "prefix"])
    known = rows.withColumn("prefix", F.substring(key, 1, depth)).join(sums, [*group, "prefix"])
    within = F.sum(own).over(Window.partitionBy(*group, "prefix").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    done = known.filter(F.col("rows") <= 4 * bucket).withColumn("rank", F.col("base") + F.coalesce(within, F.lit(0))).drop("prefix", "rows", "base")
    if most is None:
        return done
    inner = [f"{name}_prefix", f"{name}_base", f"{name}_total"]
    deep = known.filter(F.col("rows") > 4 * bucket).drop("rows")
    deep = disk.keep(deep.withColumnsRenamed(dict(zip(("prefix", "base", "total"), inner))))
    again = _ranked(deep, [*group, inner[0]], key, disk, own, bucket, depth, depth + int(further) + _digits(most, bucket) - 1, name + "p")
    again = again.withColumn("rank", F.col("rank") + F.col(inner[1])).withColumn("total", F.col(inner[2])).drop(*inner)
    return done.unionByName(again)


def climb(leaves: DataFrame, disk: Scratch, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """The levels above leaves ``grp, total, rank, hash, load``, and ``grp, depth, hash, load`` of each group's top node.

    A level's rows are nodes: ``grp``, the number ``n`` of the group's nodes
    there, ``idx`` and ``kids``, up to ``fanout`` structs in order.  ``depth``
    counts levels; a lone leaf is its group's top at depth 0.
    """
    most = leaves.agg(F.max("total")).first()[0] or 0
    tops = leaves.filter("total = 1").select("grp", F.lit(0).alias("depth"), "hash", "load")
    levels, nodes, load = [], leaves.filter("total > 1"), leaves.schema["load"].dataType
    while most > 1:
        up = nodes.groupBy("grp", F.ceil(F.col("total") / fanout).alias("n"), F.expr(f"rank div {fanout}").alias("idx"))
        made = up.agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("place"), "hash", "load"))).alias("kids"))
        made = disk.keep(made.withColumn("hash", F.sha2(F.array_join("kids.hash", ""), 256)))
        levels.append(made)
        tops = tops.unionByName(made.filter("n = 1").select("grp", F.lit(len(levels)).alias("depth"), "hash", F.lit(None).cast(load).alias("load")))
        nodes = made.filter("n > 1").select("grp", F.col("n").alias("total"), F.col("idx").alias("rank"), "hash", F.lit(None).cast("string").alias("load"))
        most = -(-most // fanout)
    return levels, tops


def descend(levels: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """``hash, load, path`` and the carried columns of every leaf; ``tops`` are ``grp, depth, path`` and these.

    ``path`` holds, from a leaf's own run up, what lies left and right of it.
    A lone leaf has its top's path and its own ``hash`` and ``load`` there.
    """
    given = None
    for k in range(len(levels), 0, -1):
        start = tops.filter(F.col("depth") == k).select("grp", F.lit(0).cast("long").alias("idx"), "path", *carried)
        given = start if given is None else given.unionByName(start)
        nodes = levels[k - 1].select("grp", "idx", "kids").join(given, ["grp", "idx"])
        hashes = F.col("kids.hash")
        kid = nodes.select("grp", hashes.alias("hashes"), F.posexplode("kids").alias("pos", "kid"), "path", *carried)
        step = F.struct(F.array_join(F.slice("hashes", F.lit(1), F.col("pos")), "").alias("l"), F.array_join(F.slice("hashes", F.col("pos") + 2, F.size("hashes")), "").alias("r"))
        path = F.concat(F.array(step), "path").alias("path")
        if k > 1:
            given = kid.select("grp", F.col("kid.place").alias("idx"), path, *carried)
        else:
            given = kid.select(F.col("kid.hash").alias("hash"), F.col("kid.load").alias("load"), path, *carried)
    lone = tops.filter("depth = 0").select("hash", "load", "path", *carried)
    return lone if given is None else lone.unionByName(given)


def _copies(rows: DataFrame) -> DataFrame:
    """A row for each copy of a leaf, with ranks that follow one another; very many copies are dealt over tasks first."""
    fields = [c for c in rows.columns if c not in ("rank", "copies")]
    few = rows.filter(F.col("copies") <= COPIES)
    many = rows.filter(F.col("copies") > COPIES).select(*fields, "rank", "copies", F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES}L)")).alias("first"))
    many = many.repartition("grp", "rank", "first").select(*fields, (F.col("rank") + F.col("first")).alias("rank"), F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("first")).alias("copies"))
    return few.unionByName(many).select(*fields, F.explode(F.expr("sequence(rank, rank + copies - 1)")).alias("rank"))


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source", altered: dict[str, Column] | None = None, fanout: int = FANOUT, bucket: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    A leaf hashes the ``fields``; ``altered`` gives what some of them hold when
    the table is verified, so ``folded_root`` is the root that such a row leads
    to along its proof.  Ids are integers.  Null ids come first, null groups
    too; rows that share an id are ordered by their leaves, and equal rows each
    have a place (and proof) of their own.  Columns beyond the fields are not
    read; an empty table gives an empty one.  Texts of any length are hashed
    in their own row.
    """
    disk = Scratch(docs.sparkSession)
    leaf = digest(*(field(F.col(c)) for c in fields))
    changed = digest(*(field((altered or {}).get(c, F.col(c))) for c in fields)) if altered else F.lit(None).cast("string")
    grp = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))
    rows = docs.select(grp.alias("grp"), F.col(id_col).alias("doc_id"), leaf.alias("leaf"), changed.alias("changed"))
    rows = disk.keep(rows.groupBy("grp", "doc_id", "leaf", "changed").agg(F.count(F.lit(1)).alias("copies")))
    placed = ranked(rows, ["grp"], F.concat(id_digits(F.col("doc_id")), "leaf"), disk, F.col("copies"), bucket)
    # one string beside the hash: what the leaf becomes, and its id
    load = F.struct("doc_id", "changed")
    leaves = disk.keep(_copies(placed).select("grp", "total", "rank", F.col("leaf").alias("hash"), load.alias("load")))
    levels, tops = climb(leaves, disk, fanout)
    tops = disk.keep(tops)

    groups = tops.select(F.lit(0).alias("all"), F.lower(F.hex(F.col("grp").cast("binary"))).alias("digits"), "hash", F.struct("grp", "depth", "hash", "load").alias("load"))
    groups = ranked(groups, ["all"], F.col("digits"), disk, None, bucket)
    groups = disk.keep(groups.select(F.col("all").cast("string").alias("grp"), "total", "rank", "hash", "load"))
    over, root = climb(groups, disk, fanout)
    root = disk.keep(root)
    top = root.first()
    if top is None:
        return rows.select("doc_id", *(F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), F.lit(False).alias("verified"))
    start = root.select("grp", "depth", "hash", "load", F.expr("cast(array() as array<struct<l: string, r: string>>)").alias("path"))
    paths = descend(over, start, [])
    paths = disk.keep(paths.select(F.col("load.grp").alias("grp"), F.col("load.depth").alias("depth"), F.col("load.hash").alias("hash"), F.col("load.load").alias("load"), "path", F.col("load.hash").alias("subroot")))
    found = descend(levels, paths, ["subroot"])

    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s.l, s.r)), ""), 256)
    folded = F.aggregate("path", F.coalesce("load.changed", "hash"), lambda acc, s: F.sha2(F.concat(s.l, acc, s.r), 256))
    out = found.select(F.col("load.doc_id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", F.lit(top["hash"]).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
