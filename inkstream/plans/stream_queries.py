"""Registered queries that run as streams over the tables' files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import runs, stateful
from ..streaming.sinks import KeyedTable
from .queries import query


#: Buckets of keys that share their state in a stream.
BUCKETS = 1024


def _stream(path: str, *columns):
    return lambda spark: runs.read_stream(spark, path).select(*columns)


@query("""WITH o AS (SELECT o_custkey AS key, o_orderdate AS ts, o_orderpriority AS payload, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderpriority) AS before FROM orders),
c AS (SELECT * FROM o WHERE before IS NULL OR before <> payload) SELECT key, ts, payload, row_number() OVER (PARTITION BY key ORDER BY ts, payload) AS change FROM c""")
def changed_states(spark, d):
    rows = _stream(f"{d}/orders.parquet", F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderpriority").alias("payload"))
    return runs.emitted(spark, lambda s: stateful.changes(rows(s)))


@query("""WITH o AS (SELECT o_custkey AS key, o_orderdate AS ts, o_orderkey AS seq, o_orderstatus <> 'O' AND o_orderkey % 3 = 0 AS done, o_orderpriority AS payload, list_transform(range(o_orderkey % 11), lambda i: 'line ' || i) AS logs FROM orders),
r AS (SELECT *, coalesce(sum(done::INT) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM o),
t AS (SELECT *, coalesce(max(len(logs)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS told, lag(payload) OVER w AS last FROM r WINDOW w AS (PARTITION BY key, run ORDER BY ts, seq))
SELECT key, ts, seq, 'logs' AS event, CAST(to_json(logs[told + 1:]) AS VARCHAR) AS data FROM t WHERE len(logs) > told
UNION ALL SELECT key, ts, seq, 'task', payload FROM t WHERE last IS NULL OR last <> payload UNION ALL SELECT key, ts, seq, 'done', payload FROM t WHERE done""")
def task_events(spark, d):
    """An order is a snapshot of its customer's task: its log grows and is cut, and some end the task."""
    state = F.when((F.col("o_orderstatus") != "O") & (F.col("o_orderkey") % 3 == 0), "complete").otherwise("processing")
    logs = F.transform(F.expr("slice(sequence(0, 10), 1, cast(o_orderkey % 11 as int))"), lambda i: F.concat(F.lit("line "), i))
    rows = _stream(f"{d}/orders.parquet", F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("seq"), state.alias("state"), F.col("o_orderpriority").alias("payload"), logs.alias("logs"))
    return runs.emitted(spark, lambda s: stateful.task_feed(rows(s)))


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS key, o_orderdate AS ts, o_orderkey AS seq, epoch(o_orderdate)::BIGINT AS sec, ['portrait', 'landscape', 'square'][o_orderkey % 3 + 1] AS aspect, o_orderkey % 4 > 0 AS found, o_orderkey % 5 AS w FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS n FROM o),
f AS (SELECT key, n, ts, seq, FALSE AS hit, CASE WHEN found THEN w END AS held, CASE WHEN found THEN sec + 8640000 ELSE 0 END AS expires FROM n WHERE n = 1
  UNION ALL SELECT key, n, ts, seq, hit, CASE WHEN NOT hit AND found THEN w ELSE held END, CASE WHEN NOT hit AND found THEN sec + 8640000 ELSE expires END
  FROM (SELECT n.*, f.held, f.expires, coalesce(f.expires > n.sec AND (aspect = 'square' OR (aspect = 'portrait' AND f.held < 2) OR (aspect = 'landscape' AND f.held > 2)), FALSE) AS hit FROM f JOIN n ON n.key = f.key AND n.n = f.n + 1))
SELECT key, ts, seq, hit FROM f""")
def streamed_cache_hits(spark, d):
    """Orders as searches, an entry kept for 100 days: its clip is as wide as the order's key says, and 2 high."""
    found = F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit('[{"width":'), F.col("o_orderkey") % 5, F.lit(',"height":2}]'))).otherwise("[]")
    aspect = F.get(F.array(F.lit("portrait"), F.lit("landscape"), F.lit("square")), (F.col("o_orderkey") % 3).cast("int"))
    rows = _stream(f"{d}/orders.parquet", F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("seq"), aspect.alias("aspect"), F.col("o_orderpriority").alias("term"), found.alias("found"))
    # files come in no order of time, so nothing is late
    return runs.emitted(spark, lambda s: stateful.search_cache(rows(s), keep_hours=2400, late="36500 days", buckets=BUCKETS)).select("key", "ts", "seq", "hit")


@query("""WITH RECURSIVE o AS (SELECT user_id AS key, ts, epoch_us(ts) / 1e6::DOUBLE AS sec, (value % 100) / 100.0::DOUBLE AS value FROM events WHERE value IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, value) AS n FROM o),
f AS (SELECT key, n, ts, value, sec AS t, value AS v, TRUE AS due FROM n WHERE n = 1
  UNION ALL SELECT key, n, ts, value, CASE WHEN due THEN sec ELSE t END, CASE WHEN due THEN value ELSE v END, due FROM (SELECT n.*, f.t, f.v, n.value > f.v AND (n.sec - f.t >= 1 OR n.value - f.v >= 0.02::DOUBLE OR n.value >= 1) AS due FROM f JOIN n ON n.key = f.key AND n.n = f.n + 1))
SELECT key, ts, value FROM f WHERE due""")
def streamed_progress(spark, d):
    rows = _stream(f"{d}/events.parquet", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), ((F.col("value") % 100) / 100.0).cast("double").alias("value"))
    return runs.emitted(spark, lambda s: stateful.throttle(rows(s).filter("value is not null"), late="36500 days"))


@query("SELECT user_id, arg_max(event_type, event_id) AS state, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_states(spark, d):
    """A stream of events into a table that holds each user's last one."""
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    rows = _stream(f"{d}/events.parquet", "user_id", F.col("event_type").alias("state"), "event_id")
    table = KeyedTable(spark, f"{folder}/rows", "user_id long, state string, event_id long", ["user_id"])
    runs.applied(spark, rows, table.upsert("event_id"), folder)
    return table.read()


@query("""WITH c AS (SELECT c_custkey AS book_id, 'ready' AS state, 0 AS progress FROM customer), p AS (SELECT o_custkey AS book_id, arg_max(o_orderpriority, o_orderkey) AS state, arg_max(o_orderkey % 250 - 50, o_orderkey) AS progress FROM orders GROUP BY 1)
SELECT book_id, coalesce(p.state, c.state) AS state, CAST(least(100, greatest(0, coalesce(p.progress, c.progress))) AS INT) AS progress FROM c LEFT JOIN p USING (book_id)""")
def patched_states(spark, d):
    """Books upserted from one stream, then patched from another; progress is stored as a whole percentage."""
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    table = KeyedTable(spark, f"{folder}/rows", "book_id long, state string, progress int", ["book_id"])
    books = _stream(f"{d}/customer.parquet", F.col("c_custkey").alias("book_id"), F.lit("ready").alias("state"), F.lit(0).alias("progress"), F.lit(0).alias("n"))
    patches = _stream(f"{d}/orders.parquet", F.col("o_custkey").alias("book_id"), F.col("o_orderpriority").alias("state"), (F.col("o_orderkey") % 250 - 50).cast("double").alias("progress"), F.lit(None).cast("array<string>").alias("cleared"), F.col("o_orderkey").alias("n"))
    runs.applied(spark, books, table.upsert("n"), f"{folder}/books")
    after = table.last_batch() + 1
    runs.applied(spark, patches, lambda rows, batch: table.patch("n")(rows, after + batch), f"{folder}/patches")
    return table.read()
