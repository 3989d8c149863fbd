"""Streams that read what is there and stop."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import attach, shared_folder
from .stateful import STORE

#: Partitions of keyed state for a core: each holds a store of its own.
STATE_PER_CORE = 1


def session_for_state(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in the store that holds all kinds of variables."""
    own = attach(spark).newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set(*STORE)
    own.conf.set("spark.sql.shuffle.partitions", str(max(1, STATE_PER_CORE * spark.sparkContext.defaultParallelism)))
    return own


def read_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of a table's files, a bounded number to a micro-batch; the table may be one file."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).options(**({"maxFilesPerTrigger": "64"} | options))
    folder, name = path.rstrip("/").rsplit("/", 1)
    if [f.rsplit("/", 1)[1] for f in table.inputFiles()] == [name]:  # a stream reads folders
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def emitted(spark: SparkSession, make: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """All rows that a stream has emitted (append mode) once it has read what there is, from files in the shared folder."""
    own, folder = session_for_state(spark), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = make(own)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def applied(spark: SparkSession, make: Callable[[SparkSession], DataFrame], sink: Callable[[DataFrame, int], None], folder: str) -> None:
    """Lets a sink see every micro-batch of a stream that reads what there is."""
    make(session_for_state(spark)).writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
