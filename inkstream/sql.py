"""Tables and queries as views, for Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions import tables
from .plans import domain
from .plans import document_queries, job_queries, more_queries, page_queries, rule_queries, stream_queries, text_queries, title_queries  # noqa: F401  register further queries
from .plans import queries

TABLES = ["customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "part", "pages", "region", "supplier", "benchmark", "conversations"]


def register(spark: SparkSession, folder: str, names: list[str] | None = None) -> list[str]:
    """Registers the folder's tables, the book tables and the named queries (all, if none are named) as temporary views, and the table functions."""
    for name in TABLES:
        domain.table(spark, folder, name).createOrReplaceTempView(name)
    domain.blocks(spark, folder).createOrReplaceTempView("blocks")
    domain.chapters(spark, folder).createOrReplaceTempView("chapters")
    domain.segments(spark, folder).createOrReplaceTempView("segments")
    tables.register(spark)
    wanted = list(queries.QUERIES) if names is None else names
    for name in wanted:
        queries.QUERIES[name](spark, folder).createOrReplaceTempView(name)
    return wanted
