"""Numbers and running totals within a few large groups.

A window puts a whole group into one task.  Here a group's rows are cut into
pieces by where they stand in the order: the cuts are quantiles over the table,
so no piece of any group holds more than its share of all rows (rows of one
value stay together).  Pieces are counted with partial sums, what precedes each
piece is added up over the pieces, and only the rows of one piece meet in a
window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces for each shuffle partition, so that partitions are alike although pieces are dealt by hash; and at most.
PIECES_PER_PARTITION, MOST_PIECES = 16, 8192


def preceding(rows: DataFrame, group: list[str], by: Column, order: list, value: Column | None = None, name: str = "before", pieces: int | None = None) -> DataFrame:
    """Adds ``name``: what the rows of the group before this one sum up to in ``value``, or how many they are.

    ``order`` is the whole order, ascending or not, and ``by`` a number (or
    what casts to one) that never falls along it; null comes first.  Rows that
    are equal in ``order`` are summed up in no fixed order.
    """
    spark = rows.sparkSession
    pieces = pieces or min(MOST_PIECES, PIECES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    depth = max(1, math.ceil(math.log2(pieces)))
    n = 1 << depth
    by = by.cast("double")
    cuts = rows.select(F.percentile_approx(by, [k / n for k in range(1, n)], 8 * n).alias("cuts")).first()["cuts"]
    own = F.lit(1).cast("long") if value is None else value
    piece = F.lit(-1)
    if cuts:
        known, at = F.array(*map(F.lit, cuts)), F.lit(0)
        # how many cuts lie below: a search in so many halvings
        steps = F.array(*[F.lit(n >> k) for k in range(1, depth + 1)])
        at = F.aggregate(steps, F.lit(0), lambda low, half: F.when(F.get(known, low + half - 1) < by, low + half).otherwise(low))
        piece = F.when(by.isNull(), F.lit(-1)).otherwise(at)
    names = [f"_g{i}" for i in range(len(group))]
    counts = rows.groupBy(*[F.col(g).alias(a) for g, a in zip(group, names)], piece.alias("_piece_")).agg(F.sum(own).alias("_own"))
    earlier = F.sum("_own").over(Window.partitionBy(*names).orderBy("_piece_").rowsBetween(Window.unboundedPreceding, -1))
    sums = counts.select(*names, "_piece_", F.coalesce(earlier, F.lit(0)).alias("_base"))
    met = rows.withColumn("_piece", piece)
    on = (F.col("_piece") == F.col("_piece_")) & F.lit(True)
    for g, a in zip(group, names):
        on = on & F.col(g).eqNullSafe(F.col(a))
    met = met.join(sums, on)
    within = F.sum(own).over(Window.partitionBy(*group, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return met.withColumn(name, F.col("_base") + F.coalesce(within, F.lit(0))).drop("_piece", "_piece_", "_base", *names)


def numbered(rows: DataFrame, group: list[str], by: Column, order: list, name: str = "place", pieces: int | None = None) -> DataFrame:
    """Adds ``name``: the rows of each group numbered from 1."""
    return preceding(rows, group, by, order, None, name, pieces).withColumn(name, (F.col(name) + 1).cast("int"))
