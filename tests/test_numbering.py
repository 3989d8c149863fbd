"""Numbers and running totals of large groups against plain sorting."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkstream.operators import numbering as N


def plain(rows, key):
    sums = {}
    for r in sorted(rows, key=key):
        before = sums.get(r[0], 0)
        yield (r, before)
        sums[r[0]] = before + r[3]


@pytest.mark.parametrize("pieces", [1, 2, 7, 64, None])
def test_totals_before_a_row(spark, pieces):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(20), *range(1000, 1005)]), k, rng.randrange(9)) for k in range(700)]
    table = spark.createDataFrame(rows, "g string, t int, k int, v int")
    got = {(r.g, r.t, r.k, r.v): r.before for r in N.preceding(table, ["g"], F.col("t"), ["t", "k"], F.col("v"), pieces=pieces).collect()}
    assert got == dict(plain(rows, lambda r: (r[1] is not None, r[1] or 0, r[2])))
    down = {(r.g, r.t, r.k, r.v): r.before for r in N.preceding(table.filter("t is not null"), ["g"], -F.col("t"), [F.desc("t"), "k"], F.col("v"), pieces=pieces).collect()}
    assert down == dict(plain([r for r in rows if r[1] is not None], lambda r: (-r[1], r[2])))


def test_equal_values_one_group_and_no_rows(spark):
    same = spark.createDataFrame([("x", 5, k) for k in range(300)], "g string, t int, k int")
    assert {(r.k, r.place) for r in N.numbered(same, ["g"], F.col("t"), ["t", "k"]).collect()} == {(k, k + 1) for k in range(300)}
    assert N.numbered(same.filter("false"), ["g"], F.col("t"), ["t", "k"]).count() == 0
    assert N.numbered(same.withColumn("t", F.lit(None).cast("int")), ["g"], F.col("t"), ["t", "k"]).agg(F.max("place")).first()[0] == 300


def test_three_groups_over_many_partitions_are_even(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(200_000).select((F.col("id") % 10).alias("g"), F.col("id").alias("t")).withColumn("g", F.when(F.col("g") < 6, 0).when(F.col("g") < 9, 1).otherwise(2))
        out = N.numbered(rows, ["g"], F.col("t"), ["t"])
        tasks = Counter({r[0]: r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()})
        sizes = sorted(tasks.values())
        assert len(sizes) > 200 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        assert out.groupBy("g").agg(F.max("place"), F.count_distinct("place"), F.count("*")).filter("max(place) != `count(1)` or `count(DISTINCT place)` != `count(1)`").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
