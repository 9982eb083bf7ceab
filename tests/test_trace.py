"""Online simplification and the change feed."""

import os
import random

from pyspark.sql import functions as F

from strideframe.functions.lines import simplified
from strideframe.streaming import trace
from strideframe.streaming.fold import fold_stream

FIX = "game long, t_ms long, lat double, lon double"


def track(rng, n, game=1, gap_at=()):
    lat, lon, t, out = 40.0, -111.0, 1_700_000_000_000, []
    turn = (0.0, 1e-5)
    for i in range(n):
        if rng.random() < 0.05:
            turn = (rng.uniform(-1e-5, 1e-5), rng.uniform(-1e-5, 1e-5))
        lat, lon, t = lat + turn[0] + rng.gauss(0, 3e-6), lon + turn[1] + rng.gauss(0, 3e-6), t + (1000 if i not in gap_at else 500_000)
        out.append((game, t, lat, lon))
    return out


def test_every_point_stays_within_two_metres(spark):
    rng = random.Random(1)
    rows = track(rng, 1500, gap_at={400, 401, 900}) + track(rng, 300, game=2)
    df = spark.createDataFrame(rows, FIX)
    feed = trace.traces(df, "game").collect()
    assert {r.epoch for r in feed} == {0}
    for g, n_runs in ((1, 4), (2, 1)):
        own = sorted((r.seq, r.run, r.lat, r.lon) for r in feed if r.game == g)
        assert [x[0] for x in own] == list(range(len(own))) and {x[1] for x in own} == set(range(n_runs))
        points = [(a, b) for k, _, a, b in rows if k == g]
        kept = {(a, b) for _, _, a, b in own}
        # Each input point between two kept ones of its run is near their line; kept points are input points, in order.
        last, between, before = None, [], None
        for t, p in [(t, (a, b)) for k, t, a, b in rows if k == g]:
            if before is not None and t - before > 120_000:
                assert not between  # a run's last point is kept
                last = None
            before = t
            between.append(p)
            if p in kept:
                assert all(trace.off_line_m(q, last or p, p) <= 2.0 + 1e-6 for q in between)
                last, between = p, []
        assert not between and len(own) < 0.6 * len(points)
        if n_runs == 1:
            assert len(own) <= 4 * len(simplified(points, 2.0))  # not far from what the whole line allows


def test_window_and_cap_bound_the_state():
    m = trace.TraceSimplifier(within_m=2.0, window=8, cap=50)
    s, out, t = m.start(), [], 0
    for i in range(4000):
        t += 1000
        out += m.step(s, {"t_ms": t, "lat": 40 + i * 1e-6, "lon": -111 + (i % 2) * 1e-4})
        assert len(s["wait"]) <= 8 and len(s["kept"]) < 50
    newest = max(r[0] for r in out)
    assert newest > 10 and sorted(r[1] for r in out if r[0] == newest) == list(range(len(s["kept"])))
    assert out[0][3:] == (40.0, -111.0) and s["kept"][0][1:] == [40.0, -111.0]  # a run's first point stays


def test_readers_take_what_is_new_or_all(spark):
    feed = [(1, 0, i, 0, 1.0 * i, 0.0) for i in range(5)] + [(1, 0, 4, 0, 4.0, 0.0)] + [(2, e, i, 0, 1.0, 2.0) for e, n in ((0, 9), (1, 4)) for i in range(n)] + [(3, 0, 0, 0, 0.0, 0.0)]
    df = spark.createDataFrame(feed, "game long, epoch long, seq long, run long, lat double, lon double")
    cursors = spark.createDataFrame([(1, 0, 3), (2, 0, 9), (4, 0, 1)], "game long, epoch long, have long")
    got = sorted((r.game, r.epoch, r.seq, r.reset) for r in trace.since(df, cursors, "game").collect())
    assert got == [(1, 0, 3, False), (1, 0, 4, False), *((2, 1, i, True) for i in range(4)), (3, 0, 0, True)]
    beyond = spark.createDataFrame([(1, 0, 7)], "game long, epoch long, have long")
    assert all(r.reset for r in trace.since(df, beyond, "game").where("game = 1").collect())


def test_replayed_and_dropped_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = track(rng, 240) + track(rng, 240, game=2)
    rows.sort(key=lambda r: r[1])
    src = tmp_path / "src"
    for i in range(4):
        spark.createDataFrame(rows[i * 120 : (i + 1) * 120], FIX).coalesce(1).write.parquet(str(src / f"b{i}"))
        for f in (src / f"b{i}").iterdir():
            os.utime(f, (1e9 + 60 * i, 1e9 + 60 * i))
    out, sink = str(tmp_path / "feed"), None
    sink = trace.feed_sink(out)

    def twice(batch, batch_id):
        sink(batch, batch_id)
        sink(batch, batch_id)  # as after a failure before the commit

    s = spark.readStream.schema(FIX).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = fold_stream(s, "game", ["t_ms"], trace.TraceSimplifier()).writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    plain = lambda df: sorted((r.game, r.epoch, r.seq, r.lat, r.lon) for r in df.collect())
    feed = trace.received(spark, out)
    whole = spark.createDataFrame(rows, FIX)
    batch = trace.traces(whole, "game")
    ends = {g: max(r.seq for r in batch.collect() if r.game == g) for g in (1, 2)}
    assert plain(trace.current(feed, "game")) == [x for x in plain(batch) if x[2] < ends[x[0]]]  # but for the window, which the end of the rows settles
    assert trace.incomplete(feed, "game").count() == 0
    assert trace.current(feed.unionByName(feed), "game").count() == feed.count()
    first = spark.read.parquet(f"{out}/batch=1")
    lost = feed.join(first.select("game", "epoch", "seq"), ["game", "epoch", "seq"], "left_anti")
    assert {r.game for r in trace.incomplete(lost, "game").collect()} == {r.game for r in first.select("game").distinct().collect()}
