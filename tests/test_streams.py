"""Streams of several micro-batches against their batch twins and plain Python."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from inkstream.operators import links as K
from inkstream.operators import state as S
from inkstream.streaming import feeds, stateful

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set(*stateful.STORE)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # a key's rows come in several chunks
    spark.conf.set("spark.sql.execution.arrow.transformWithStateInPySpark.maxRecordsPerBatch", "100")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def stream_of(spark, rows, schema, folder, parts):
    """Rows in files that come one micro-batch each, in the order of the rows."""
    n = -(-len(rows) // parts)
    for k in range(parts):
        own = rows[k * n : (k + 1) * n]
        random.Random(k).shuffle(own)
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def settled(stream, folder, mode="append"):
    name = "t" + str(abs(hash(str(folder))))
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return stream.sparkSession.table(name)


def both(stream, batch):
    assert sorted(stream.columns) == sorted(batch.columns)
    one, two = (sorted(map(str, t.select(*sorted(t.columns)).collect())) for t in (stream, batch))
    assert one == two
    return stream.collect()


def test_changes_of_one_key_beyond_an_arrow_chunk(spark, tmp_path):
    rows = [(1, T0 + dt.timedelta(seconds=k), "a" if k < 500 else "b") for k in range(1000)]
    schema = "key long, ts timestamp, payload string"
    got = settled(feeds.changes(stream_of(spark, rows, schema, tmp_path, 1)), tmp_path)
    assert len(both(got, feeds.changes_so_far(spark.createDataFrame(rows, schema)))) == 2


def test_task_feed(spark, tmp_path):
    rng, rows, seq = random.Random(1), [], 0
    for n in range(900):
        seq += 1
        key = "t%d" % min(rng.randrange(6), 3)
        lines = [f"{key} line {i}" for i in range(seq // 40)] if rng.random() < 0.9 else []
        state = "processing" if rng.random() < 0.97 else rng.choice(["complete", "failed"])
        rows.append((key, T0 + dt.timedelta(seconds=n // 3), seq, state, json.dumps({"at": seq // 25}), lines or (None if n % 2 else [])))
    schema = "key string, ts timestamp, seq long, state string, payload string, logs array<string>"
    got = both(settled(stateful.task_feed(stream_of(spark, rows, schema, tmp_path, 4)), tmp_path), stateful.task_feed_so_far(spark.createDataFrame(rows, schema)))
    want, told, last = [], {}, {}
    for key, ts, s, state, payload, logs in sorted(rows, key=lambda r: r[1:3]):
        if len(logs or []) > told.get(key, 0):
            want.append((key, ts, s, "logs", json.dumps(logs[told.get(key, 0) :], separators=(",", ":"))))
            told[key] = len(logs)
        if last.get(key) != payload:
            want.append((key, ts, s, "task", payload))
            last[key] = payload
        if state != "processing":
            want.append((key, ts, s, "done", payload))
            told.pop(key, 0)
            last.pop(key)
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r.event for r in got} == {"logs", "task", "done"}


def test_log_window(spark, tmp_path):
    rng, rows, seq = random.Random(2), [], 0
    jobs, logs = {}, []
    for n in range(700):
        seq += 1
        book, idx = rng.randrange(3), rng.randrange(-1, 9)
        ts = T0 + dt.timedelta(seconds=n)
        if n < 40 or rng.random() < 0.1:
            task = None if rng.random() < 0.2 else f"{book}/{idx}/{n}"
            state = "ocr" if idx < 0 else rng.choice(["queued", "rendering", "pending"])
            rows.append((book, ts, seq, idx, state, task, None))
            jobs[book, idx] = (state, task)
        else:
            known = [t for (b, _), (s, t) in jobs.items() if b == book and t and s != "pending"]
            if known:
                task = rng.choice(known)
                rows.append((book, ts, seq, None, None, task, f"line {n}"))
                logs.append((task, seq, f"line {n}"))
    schema = "key long, ts timestamp, seq long, idx long, state string, task_id string, line string"
    got = settled(stateful.log_window(stream_of(spark, rows, schema, tmp_path, 5)), tmp_path, "update")
    table = spark.createDataFrame([(b, i, s, t) for (b, i), (s, t) in jobs.items()], "key long, idx long, state string, task_id string")
    lines = spark.createDataFrame(logs, "task_id string, seq long, line string")
    batch = K.recent_lines(table.filter("idx >= 0"), lines, "key", table.filter("idx < 0").select("key", "task_id"))
    shown = both(stateful.latest(got), batch)
    assert any(r.idx == -1 for r in shown) and max(sum(r.key == b for r in shown) for b in range(3)) == 25
    versions = [(r.key, r.version) for r in got.collect()]
    assert len(set(versions)) == len(versions) > 6


def test_search_cache(spark, tmp_path):
    rng, rows = random.Random(3), []
    for n in range(800):
        items = [{"url": f"u{n}.{i}", "width": rng.choice([9, 16]), "height": 12} for i in range(rng.randrange(3))]
        found = None if rng.random() < 0.1 else json.dumps(items)
        rows.append((rng.choice("abcd"), T0 + dt.timedelta(hours=n // 4), n, rng.choice(["portrait", "landscape", "square"]), rng.choice(["Sea", "SEA"]), found))
    schema = "key string, ts timestamp, seq long, aspect string, term string, found string"
    stream = stateful.search_cache(stream_of(spark, rows, schema, tmp_path, 4), keep_hours=30)
    got = both(settled(stream, tmp_path), stateful.search_cache_so_far(spark.createDataFrame(rows, schema), keep_hours=30))
    assert 100 < sum(r.hit for r in got) < 700 and all(json.loads(r.items)[0]["term"] in ("Sea", "SEA") for r in got if r.hit)
    # a row's answer by the batch operator, from the entry that the stream then held
    entry = {}
    for key, ts, seq, aspect, _, found in rows:
        held = entry.get(key)
        fits = held and held[0] > ts and all(aspect == "square" or (x["height"] > x["width"]) == (aspect == "portrait") and x["height"] != x["width"] for x in held[1])
        assert bool(fits) == next(r.hit for r in got if r.seq == seq)
        if not fits and found and json.loads(found):
            entry[key] = (ts + dt.timedelta(hours=30), json.loads(found))


def test_throttle(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), T0 + dt.timedelta(milliseconds=143 * n), min(1.0, max(0.0, n / 600 + rng.uniform(-0.05, 0.05)))) for n in range(600)]
    schema = "key string, ts timestamp, value double"
    table = spark.createDataFrame(rows, schema).withColumn("at", F.unix_micros("ts") / 1e6)
    batch = S.throttled(table, "key", "at", "value").select("key", F.timestamp_micros(F.round(F.col("at") * 1e6).cast("long")).alias("ts"), "value")
    got = both(settled(stateful.throttle(stream_of(spark, rows, schema, tmp_path, 5)), tmp_path), batch)
    last = {}
    for key, ts, value in rows:
        at = ts.replace(tzinfo=dt.UTC).timestamp()
        t, v = last.get(key, (0.0, -1.0))
        passed = value > v and (at - t >= 1 or value - v >= 0.02 or value >= 1)
        assert passed == any((r.key, r.ts, r.value) == (key, ts, value) for r in got)
        if passed:
            last[key] = (at, value)


def test_stored_progress_is_a_whole_percentage(spark):
    old = spark.createDataFrame([(k, 5) for k in range(6)], "k int, progress int")
    changes = spark.createDataFrame([(0, -3.0, None), (1, 41.5, None), (2, 250.0, None), (3, None, None), (4, None, ["progress"])], "k int, progress double, cleared array<string>")
    assert {r.k: r.progress for r in S.patch(old, changes, ["k"]).collect()} == {0: 0, 1: 42, 2: 100, 3: 5, 4: None, 5: 5}
    assert spark.range(1).select(S.whole_percent(F.lit(99.49))).first()[0] == 99


def test_expired_entries_leave_the_state(spark, tmp_path):
    item = json.dumps([{"width": 1, "height": 1}])
    rows = [("old", T0, 1, "square", "x", item)] + [("new", T0 + dt.timedelta(hours=h), 1 + h, "square", "x", item) for h in (40, 80, 81)]
    schema = "key string, ts timestamp, seq long, aspect string, term string, found string"
    settled(stateful.search_cache(stream_of(spark, rows, schema, tmp_path, 4), keep_hours=30), tmp_path)
    held = spark.read.format("statestore").option("stateVarName", "entry").load(str(tmp_path / "ck"))
    assert [r.key.key for r in held.select("key").collect()] == ["new"]


def test_search_cache_of_keys_that_share_their_state(spark, tmp_path):
    """Every key cost a frame, an output batch and four calls; a bucket's keys share them, in any number of micro-batches."""
    rng, rows = random.Random(13), []
    for n in range(1200):
        items = [{"url": f"u{n}.{i}", "width": rng.choice([9, 16]), "height": 12} for i in range(rng.randrange(3))]
        rows.append((rng.choice(["é", "b", *map(str, range(30))]), T0 + dt.timedelta(hours=n // 4), n, rng.choice(["portrait", "landscape", "square", None]), rng.choice(["Sea", None]), None if rng.random() < 0.1 else json.dumps(items)))
    schema = "key string, ts timestamp, seq long, aspect string, term string, found string"
    stream = stateful.search_cache(stream_of(spark, rows, schema, tmp_path, 4), keep_hours=30, buckets=5)
    got = both(settled(stream, tmp_path), stateful.search_cache_so_far(spark.createDataFrame(rows, schema), keep_hours=30))
    assert 20 < sum(r.hit for r in got) < 1000
    held = spark.read.format("statestore").option("stateVarName", "entries").load(str(tmp_path / "ck"))
    last = T0 + dt.timedelta(hours=299)
    ends = [r.e.expires for r in held.select(F.col("list_element").alias("e")).collect()]
    assert 0 < len(ends) and min(ends) / 1000 > (last - dt.timedelta(hours=1)).replace(tzinfo=dt.UTC).timestamp()
