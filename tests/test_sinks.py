"""Tables that streams keep up to date, replayed and half-done batches included."""

import random

import pytest
from pyspark.sql import functions as F

from inkstream.streaming.sinks import KeyedTable, cascade

SCHEMA = "book long, idx long, state string, progress int"


def rows_of(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def content(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def stream_into(spark, folder, rows, schema, sink, files):
    n = -(-len(rows) // files)
    for k in range(files):
        rows_of(spark, rows[k * n : (k + 1) * n], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(120)


@pytest.mark.parametrize("buckets", [1, 5])
def test_upserts_of_a_stream(spark, tmp_path, buckets):
    rng = random.Random(buckets)
    rows = [(rng.randrange(4), rng.randrange(5), f"s{n}", n % 101, n) for n in range(120)]
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["book", "idx"], buckets)
    assert content(table) == []
    stream_into(spark, tmp_path, rows, SCHEMA + ", n long", table.upsert("n"), 3)
    want = {(b, i): (b, i, s, p) for b, i, s, p, _ in rows}
    assert content(table) == sorted(want.values(), key=str)
    again = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["book", "idx"], buckets)
    again.upsert("n")(rows_of(spark, [(0, 0, "late", 1, 999)], SCHEMA + ", n long"), 2)  # the last batch once more
    assert content(again) == sorted(want.values(), key=str)


def test_patches_in_order(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["book", "idx"], 3)
    table.upsert("n")(rows_of(spark, [(b, i, "pending", 7, 0) for b in range(3) for i in range(2)], SCHEMA + ", n long"), 0)
    changes = [(0, 0, "rendering", None, None, 1), (0, 0, None, 40.6, None, 2), (0, 0, None, None, ["state"], 3), (1, 1, None, None, ["progress"], 1), (1, 1, "failed", 300.0, None, 2), (9, 9, "new", 1.0, None, 1)]
    table.patch("n")(rows_of(spark, changes, "book long, idx long, state string, progress double, cleared array<string>, n long"), 1)
    got = {(b, i): (s, p) for b, i, s, p in content(table)}
    assert got.pop((0, 0)) == (None, 41) and got.pop((1, 1)) == ("failed", 100)
    assert len(got) == 4 and set(got.values()) == {("pending", 7)}


def test_groups_are_replaced_and_deleted(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["book", "idx"], 4)
    other = KeyedTable(spark, f"{tmp_path}/o", "book long, name string", ["book"], 2)
    table.upsert("n")(rows_of(spark, [(b, i, "old", 0, 0) for b in range(5) for i in range(3)], SCHEMA + ", n long"), 0)
    other.upsert("n")(rows_of(spark, [(b, "x", 0) for b in range(5)], "book long, name string, n long"), 0)
    plan = [(1, 0, "first", 0, 1), (1, 0, "new", 0, 2), (1, 7, "new", 0, 2), (2, None, None, None, 1), (8, 1, "new", 0, 1)]
    table.replace("v")(rows_of(spark, plan, SCHEMA + ", v long"), 1)
    assert [r[:3] for r in content(table) if r[0] in (1, 2, 8)] == [(1, 0, "new"), (1, 7, "new"), (8, 1, "new")]
    gone = rows_of(spark, [(0,), (1,), (77,)], "book long")
    table.delete()(gone, 2)  # the cascade failed after its first table
    cascade([table, other])(gone, 2)
    assert {r[0] for r in content(table)} == {3, 4, 8} and {r[0] for r in content(other)} == {2, 3, 4}


def test_a_batch_that_died_is_not_seen(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["book", "idx"], 2)
    table.upsert("n")(rows_of(spark, [(1, 1, "a", 1, 0)], SCHEMA + ", n long"), 0)
    before = content(table)

    def broken(old, new):
        return old.unionByName(new.select(*old.columns)).withColumn("state", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        table.apply(rows_of(spark, [(1, 2, "b", 1)], SCHEMA), 1, broken)
    assert content(table) == before
    table.upsert("n")(rows_of(spark, [(1, 2, "b", 1, 0)], SCHEMA + ", n long"), 1)
    assert len(content(table)) == 2
