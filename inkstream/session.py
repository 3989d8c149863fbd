"""Sessions, and making this package importable on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_attached: weakref.WeakSet = weakref.WeakSet()
#: Bytes of an Arrow batch where the session has Spark's own default: a task holds several of them, inside and outside the JVM.
BATCH_BYTES = "8m"
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Bytes of a table that one task reads where the session sets none: texts cost their task far more than reading them does.
SPLIT_BYTES = 16 << 20
_SPLIT = "spark.sql.files.maxPartitionBytes"


def attach(spark: SparkSession) -> SparkSession:
    """Ships this package's modules to the executors of a session, once per Spark application, and bounds what tasks read and Arrow batches hold by bytes."""
    if spark.conf.get(_BATCH, None) == _DEFAULT:
        spark.conf.set(_BATCH, BATCH_BYTES)
    if spark.conf.get(_SPLIT, None) is None:
        spark.conf.set(_SPLIT, str(SPLIT_BYTES))
    context = spark.sparkContext
    if context not in _attached:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(), "inkstream.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(archive)
        _attached.add(context)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, which all executors see; a temporary folder only where there is none and all is one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="inkstream-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(table: DataFrame) -> DataFrame:
    """A table written to the shared folder and read again, so what it cost is paid once and an executor that is lost costs nothing."""
    path = f"{shared_folder(table.sparkSession)}/written-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


#: Tables of more bytes than this are dealt anew only if a task would read much more than its share: row groups are never split.
SPREAD_BYTES = 256 << 20


def spread(table: DataFrame) -> DataFrame:
    """A table as it lies, or dealt over all cores where its row groups are too few for them: a small file is often one of them, so one task."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= SPREAD_BYTES:
        return table.repartition(cores) if len(table.inputFiles()) < cores else table
    # reads footers alone
    most, rows = table.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count"), F.sum("count")).first()
    return table.repartition(max(cores, -(-size // SPLIT_BYTES))) if most and most * cores > 2 * rows else table
