import datetime as dt

import pytest
from pyspark.sql import functions as F

from inkstream.operators import state as S
from inkstream.streaming import feeds


def test_progress_table(spark):
    cases = {1: "pending queued rendering complete failed complete", 2: "complete queued", 3: "complete failed", 4: "bogus", 5: "complete complete", 6: "failed"}
    rows = [(b, k, s) for b, states in cases.items() for k, s in enumerate(states.split())]
    got = {r.book_id: r for r in S.progress(spark.createDataFrame(rows, "book_id int, idx int, state string")).collect()}
    assert (got[1].total, got[1].pending, got[1].queued, got[1].rendering, got[1].complete, got[1].failed, got[1].progress) == (6, 1, 1, 1, 2, 1, 33)
    assert [got[k].state for k in range(1, 7)] == ["rendering", "rendering", "ready", "ready", "complete", "failed"]
    assert got[3].progress == 50 and (got[4].total, got[4].complete) == (1, 0)


def test_orphans(spark):
    segs = spark.createDataFrame([(1, 0, "rendering", "a"), (1, 1, "queued", "b"), (1, 2, "rendering", "c"), (1, 3, "rendering", "x"), (1, 4, "complete", "x")], "book_id int, idx int, state string, task_id string")
    tasks = spark.createDataFrame([("a", "processing", "o1"), ("b", "complete", "o1"), ("c", "processing", "gone")], "task_id string, state string, owner_id string")
    got = S.orphaned(segs, tasks, spark.createDataFrame([("o1",)], "owner_id string"))
    assert {r.idx: r.reason for r in got.collect()} == {1: "not processing", 2: "owner gone", 3: "missing"}


def test_mutations(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "B", 9), (4, "D", 4)], "k int, v string, n int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(S.upsert(old, new, ["k"])) == [(1, "a", 1), (2, "B", 9), (3, "c", 3), (4, "D", 4)]
    changes = spark.createDataFrame([(1, "z", None, None), (2, None, None, ["n"]), (9, "q", 1, None)], "k int, v string, n int, cleared array<string>")
    assert {tuple(r) for r in S.patch(old, changes, ["k"]).collect()} == {(1, "z", 1), (2, "b", None), (3, "c", 3)}
    assert rows(S.replace_group(old, new.filter("k = 2"), "k")) == [(1, "a", 1), (2, "B", 9), (3, "c", 3)]
    left = S.cascade_delete({"a": old, "b": new}, spark.createDataFrame([(2,)], "k int"), "k")
    assert rows(left["a"]) == [(1, "a", 1), (3, "c", 3)] and rows(left["b"]) == [(4, "D", 4)]


@pytest.mark.parametrize(("n", "most"), [(3, 5), (5, 5), (9, 5), (0, 5)])
def test_tail_of(spark, n, most):
    df = spark.createDataFrame([(list(range(n)),)], "a array<int>")
    assert df.select(S.tail_of(F.col("a"), most)).first()[0] == list(range(n))[-most:]


def test_pages_slots_and_cache(spark):
    rows = spark.createDataFrame([(1, k, float(k % 4)) for k in range(10)], "g int, k int, v double")
    assert [r.k for r in S.page(rows, [F.desc("v"), F.col("k")], 2, 3).collect()] == [6, 1, 5]
    slots = [r.slot for r in S.publish_slots(rows.filter("k < 3"), "g", ["k"], F.lit(100), F.lit(500), 60, 10).orderBy("k").collect()]
    assert slots == [560, 570, 580]
    cache = spark.createDataFrame([("a", 10, [1]), ("b", 5, [1]), ("c", 10, [])], "key string, expires_at int, items array<int>")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    assert {r.key: r.hit for r in S.cache_hits(asked, cache, "key", F.lit(7)).collect()} == {"a": True, "b": False, "c": False, "d": False}
    assert [r.k for r in S.monotone(rows, "g", ["k"], "v").orderBy("k").collect()] == [0, 1, 2, 3]
    assert [(r.k, r.line) for r in S.tail(rows, "g", ["k"], 3).orderBy("line").collect()] == [(7, 1), (8, 2), (9, 3)]


T0 = dt.datetime(2024, 1, 1)


def events(spark, folder):
    rows = [(k % 3, T0 + dt.timedelta(minutes=k), "p" + str(k // 6)) for k in range(36)]
    spark.createDataFrame(rows, "key long, ts timestamp, payload string").coalesce(1).write.parquet(folder)
    return rows


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_change_feed_equals_its_batch_twin(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events(spark, f"{tmp_path}/e")
    stream = spark.readStream.schema("key long, ts timestamp, payload string").parquet(f"{tmp_path}/e")
    got = run(feeds.changes(stream), "feed", "append")
    want, last = [], {}
    for key, ts, payload in rows:
        if last.get(key) != payload:
            last[key] = payload
            want.append((key, ts, payload))
    assert sorted((r.key, r.ts, r.payload) for r in got.collect()) == sorted(want)
    batch = feeds.changes_so_far(spark.read.parquet(f"{tmp_path}/e"))
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, got.collect()))


def test_roll_ups_on_a_stream(spark, tmp_path):
    events(spark, f"{tmp_path}/e")
    stream = spark.readStream.schema("key long, ts timestamp, payload string").parquet(f"{tmp_path}/e")
    batch = spark.read.parquet(f"{tmp_path}/e")
    got = run(feeds.progress_feed(stream.select(F.col("key").alias("book_id"), F.lit("complete").alias("state"))), "roll", "complete")
    assert sorted((r.book_id, r.total, r.complete) for r in got.collect()) == [(k, 12, 12) for k in range(3)]
    win = run(feeds.windowed(stream, "ts", "key", "10 minutes"), "win", "complete")
    assert sorted(map(str, win.collect())) == sorted(map(str, feeds.windowed(batch, "ts", "key", "10 minutes").collect()))
    last = S.debounced(batch.filter("payload in ('p0', 'p3')"), "key", "ts", "5 minutes").orderBy("key", "first_ts").collect()
    assert len(last) == 6 and all(r.n == 2 for r in last)
