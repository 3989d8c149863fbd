"""Tables kept up to date by streams: upserts, patches, replaced groups and deletions, once per micro-batch.

A table lies in buckets of its keys' hash.  A micro-batch rewrites the buckets
it touches beside the old ones and then swaps the list of buckets by renaming
one small file, which also records the micro-batch.  So a reader sees all of a
micro-batch or nothing of it, a batch that is replayed after a failure changes
nothing, and a batch that died half-way leaves only files that no list names.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import state as S

BUCKETS = 64
_CURRENT = "_current"


class KeyedTable:
    """A table of ``keys`` under ``folder``, for use in ``foreachBatch``.

    ``buckets`` bounds what a micro-batch rewrites and is fixed when a table is
    made.  ``group`` names the leading key whose rows are replaced or deleted
    together; buckets go by it, so a group lies in one bucket.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, keys: list[str], buckets: int = BUCKETS, group: str | None = None):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets
        self.group = group or keys[0]
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # the list of buckets: {"batch": n, "paths": {bucket: path}}
    def _state(self) -> dict:
        at = self._path(f"{self.folder}/{_CURRENT}")
        if not self._fs.exists(at):
            return {"batch": -1, "paths": {}}
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        aside = self._path(f"{self.folder}/{_CURRENT}-{state['batch']}")
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(aside, self._path(f"{self.folder}/{_CURRENT}"), overwrite)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.group), F.lit(self.buckets)).cast("int")

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The table as the last committed micro-batch left it."""
        return self._read(sorted(self._state()["paths"].values()))

    def last_batch(self) -> int:
        """The number of the last committed micro-batch, -1 before the first; a further stream into the table counts on from it."""
        return self._state()["batch"]

    def apply(self, rows: DataFrame, batch: int, change: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """``change(old, rows)`` on the buckets that ``rows`` touch; False if this micro-batch was applied before."""
        state = self._state()
        if batch <= state["batch"]:
            return False
        rows = rows.persist()
        try:
            touched = [r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()]
            if touched:
                old = self._read([state["paths"][str(b)] for b in touched if str(b) in state["paths"]])
                new = change(old, rows).select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
                at = f"{self.folder}/batch-{batch}"
                new.withColumn("_b", self._bucket()).repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(at)
                for b in touched:
                    path = f"{at}/_b={b}"
                    if self._fs.exists(self._path(path)):
                        state["paths"][str(b)] = path
                    else:
                        state["paths"].pop(str(b), None)
            self._commit(state | {"batch": batch})
        finally:
            rows.unpersist()
        return True

    # what a micro-batch may do; ``order`` tells which of several rows of a key in it is the last

    def upsert(self, order: str) -> Callable[[DataFrame, int], None]:
        """The last row of each key replaces the one that is there."""

        def run(rows: DataFrame, batch: int) -> None:
            self.apply(last_of(rows, self.keys, order), batch, lambda old, new: S.upsert(old, new.select(*old.columns), self.keys))

        return run

    def patch(self, order: str, cleared: str = "cleared") -> Callable[[DataFrame, int], None]:
        """Sets what the rows of a key set, later ones over earlier ones; never adds a row."""

        def run(rows: DataFrame, batch: int) -> None:
            self.apply(merged_patches(rows, self.keys, order, cleared), batch, lambda old, new: S.patch(old, new, self.keys, cleared))

        return run

    def replace(self, version: str) -> Callable[[DataFrame, int], None]:
        """The rows of a group's newest version take the place of all its rows; one with a null in a further key empties it."""
        rest = [k for k in self.keys if k != self.group]

        def run(rows: DataFrame, batch: int) -> None:
            newest = rows.groupBy(self.group).agg(F.max(version).alias("_newest"))
            last = rows.join(newest, self.group).filter(F.col(version) == F.col("_newest"))

            def change(old: DataFrame, new: DataFrame) -> DataFrame:
                filled = new.dropna(subset=rest) if rest else new
                return old.join(new.select(self.group).distinct(), self.group, "left_anti").select(*old.columns).unionByName(filled.select(*old.columns))

            self.apply(last, batch, change)

        return run

    def delete(self) -> Callable[[DataFrame, int], None]:
        """All rows of the groups that are named go."""

        def run(rows: DataFrame, batch: int) -> None:
            self.apply(rows.select(self.group).distinct(), batch, lambda old, new: old.join(new, self.group, "left_anti").select(*old.columns))

        return run


def cascade(tables: list[KeyedTable]) -> Callable[[DataFrame, int], None]:
    """Deletes the groups that are named from several tables.

    Each table remembers its own micro-batches, so one that failed between two
    of them goes on where it stopped when the batch comes again.
    """

    def run(rows: DataFrame, batch: int) -> None:
        for table in tables:
            table.delete()(rows, batch)

    return run


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; the aggregate combines before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def merged_patches(rows: DataFrame, keys: list[str], order: str, cleared: str = "cleared") -> DataFrame:
    """One patch for the patches of a key: of each column what was set, or cleared, last."""
    columns = [c for c in rows.columns if c not in (*keys, order, cleared)]
    names = F.coalesce(F.col(cleared), F.array().cast("array<string>"))

    def last(c: str) -> Column:
        gone = F.array_contains(names, c)
        return F.max_by(F.when(gone, F.struct(F.lit(None).cast(rows.schema[c].dataType).alias("v"), F.lit(True).alias("gone"))).otherwise(F.struct(F.col(c).alias("v"), F.lit(False).alias("gone"))), F.when(gone | F.col(c).isNotNull(), F.col(order))).alias(c)

    merged = rows.groupBy(*keys).agg(*[last(c) for c in columns])
    return merged.select(*keys, *[F.col(f"{c}.v").alias(c) for c in columns], F.filter(F.array(*[F.when(F.col(f"{c}.gone"), F.lit(c)) for c in columns]), lambda x: x.isNotNull()).alias(cleared))
