"""The fixed split into rows that may be learned from and held-out rows, and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRAIN = 1 << 30


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5, is 0.  A row without an id is never learned from, so it is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def at_most(df: DataFrame, id_col: str, rows: int, by: str, values: int = 256) -> tuple[DataFrame, dict]:
    """About ``rows`` rows of each value of ``by`` at most, chosen by a hash of the id; with the counts before.

    The ``values`` most frequent values take part, of equals the smaller ones,
    so a column of many stray values does not reach the driver.
    """
    counts = {r[0]: r[1] for r in df.groupBy(by).count().orderBy(F.desc("count"), by).limit(values).collect()}
    if not counts:
        return df.filter("false"), counts
    least = F.create_map(*[F.lit(x) for value, n in counts.items() for x in (value, int(_GRAIN * min(1.0, rows / n)))])
    return df.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(_GRAIN)) < least[F.col(by)]), counts
