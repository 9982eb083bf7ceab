"""Event-time timers: rows that only time brings, in a stream and from a whole table."""

import os
import random

import pytest
from pyspark.sql import functions as F

from strideframe.streaming import timers


def streamed(spark, tmp_path, name, batches, schema, make):
    """The rows of a query over one file a trigger, which each batch is."""
    src = tmp_path / name
    src.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(later(rows), schema).coalesce(1).write.parquet(str(src / f"b{i:03}"))
        for f in (src / f"b{i:03}").iterdir():
            os.utime(f, (1e9 + 60 * i, 1e9 + 60 * i))  # the source takes files by their times
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.PROVIDER)
    try:
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*").withColumn("ts", F.timestamp_millis("t_ms"))
        q = make(s).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
        assert q.awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return sorted(tuple(r) for r in spark.table(name).collect())


T0 = 1_700_000_000_000  # rows at the watermark's start, 0, would be late


def later(rows):
    return [(r[0], r[1] + T0, *r[2:]) for r in rows]


DWELL = "k string, t_ms long, inside boolean"


def test_dwell_completes_by_a_timer_alone(spark, tmp_path):
    """Only `z` has later rows; `a` is done because time passes, `b` left in time."""
    batches = [[("a", 0, True), ("b", 0, True)], [("a", 60_000, True), ("b", 60_000, False)], [("z", 900_000, False)], [("z", 1_000_000, False)]]
    got = streamed(spark, tmp_path, "dwell_alone", batches, DWELL, lambda s: timers.dwell_stream(s, "k", 300_000))
    assert got == later([("a", 300_000)])
    whole = spark.createDataFrame(later([r for b in batches for r in b]), DWELL)
    assert sorted(tuple(r) for r in timers.dwell_times(whole, "k", 300_000, F.col("inside")).collect()) == got


def slow_dwell(rows, need, newest):
    done, since = {}, {}
    for k, t, inside in sorted(rows, key=lambda r: (r[1], r[2])):
        if k in since and t >= since[k] + need:
            done.setdefault(k, since.pop(k) + need)
        if inside:
            since.setdefault(k, t)
        else:
            since.pop(k, None)
    for k, t in since.items():
        if t + need <= newest:
            done.setdefault(k, t + need)
    return sorted(done.items())


def test_dwell_of_tables_equals_brute_force(spark):
    rng = random.Random(3)
    for _ in range(3):
        rows = [(rng.choice("abcdef"), rng.randrange(400) * 1000, rng.random() < 0.8) for _ in range(150)]
        df = spark.createDataFrame(rows, DWELL)
        got = sorted(tuple(r) for r in timers.dwell_times(df, "k", 25_000, F.col("inside")).collect())
        assert got == slow_dwell(rows, 25_000, max(t for _, t, _ in rows))
    assert timers.dwell_times(df.limit(0), "k", 1, F.col("inside")).count() == 0


PICKS = "k string, t_ms long, picked long"


def test_refills_come_from_timers_and_from_tables_alike(spark, tmp_path):
    batches = [[("a", 0, 2), ("b", 5_000, 1)], [("a", 20_000, 1)], [("a", 45_000, 9), ("z", 70_000, 0)], [("z", 200_000, 0)], [("z", 300_000, 0), ("a", 290_000, 1)], [("z", 400_000, 0)]]
    got = streamed(spark, tmp_path, "refills_by_timer", batches, PICKS, lambda s: timers.respawn_stream(s, "k", 5, 40_000, late="0 seconds"))
    want = [("a", 0, 3, "picked"), ("a", 20_000, 2, "picked"), ("a", 40_000, 5, "refilled"), ("a", 45_000, 0, "picked"), ("a", 85_000, 5, "refilled"), ("a", 290_000, 4, "picked"), ("a", 330_000, 5, "refilled"), ("b", 5_000, 4, "picked"), ("b", 45_000, 5, "refilled")]
    want = later(want)
    assert got == want
    whole = spark.createDataFrame(later([r for b in batches for r in b]), PICKS)
    assert sorted(tuple(r) for r in timers.refills(whole, "k", 5, 40_000).collect()) == want


@pytest.mark.parametrize("rows", [[], [("a", 5, 0)]])
def test_nothing_picked_refills_nothing(spark, rows):
    assert timers.refills(spark.createDataFrame(rows, PICKS), "k", 5).count() == 0
