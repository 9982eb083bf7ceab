import math
import random

from strideframe.streaming.fold import fold, fold_stream
from strideframe.streaming.imm import ImmFilter
from strideframe.streaming.machines import Debounce, HomeWatch, JournalThrottle, PlainFilter, QuestTracker, Throttle, TrapTimer, metres

FIX = "game int, id long, t_ms long, lat double, lon double, accuracy_m double, mock boolean"


def walk(n=120, seed=1, speed=1.4, noise=4.0, games=2):
    rng = random.Random(seed)
    out = []
    for g in range(games):
        for i in range(n):
            north = speed * 5 * i + rng.gauss(0, noise)
            out.append((g, g * 1000 + i, 1_700_000_000_000 + 5000 * i, 40 + north / 111195, -111 + rng.gauss(0, noise) / (111195 * math.cos(math.radians(40))), 8.0, False))
    return out


def run(machine, rows):
    s, out = machine.start(), []
    for r in rows:
        out += machine.step(s, r)
    return out


def at(north, t_s, acc=5.0, i=0):
    return {"id": i, "t_ms": t_s * 1000, "lat": 40 + north / 111195, "lon": -111.0, "accuracy_m": acc, "mock": False}


def test_stream_equals_batch_equals_replay(spark, tmp_path):
    rows = walk()
    df = spark.createDataFrame(rows, FIX)
    for k in range(3):  # three files in order of time, one a trigger
        df.where(f"id % 1000 div 40 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for machine in (PlainFilter(), JournalThrottle(9_000, 40.0), ImmFilter()):
        want = sorted((g, *x) for g in (0, 1) for x in run(machine, [dict(zip("game id t_ms lat lon accuracy_m mock".split(), r)) for r in rows if r[0] == g]))
        assert sorted(tuple(r) for r in fold(df, "game", ["t_ms", "id"], machine).collect()) == want
        name = type(machine).__name__.lower()
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
        q = fold_stream(stream, "game", ["t_ms", "id"], machine).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(tuple(r) for r in spark.table(name).collect()) == want


def test_states_of_idle_keys_go(spark, tmp_path):
    # Key 1 is idle for ten days while key 0 goes on; its second row starts anew, so it passes the throttle again.
    day = 86_400_000
    path = tmp_path / "in"
    for k, rows in enumerate([[(0, 0, 0), (1, 1, 0)], [(0, 2, 5 * day)], [(0, 3, 10 * day)], [(0, 4, 10 * day + 1), (1, 5, 10 * day + 1)]]):
        df = spark.createDataFrame(rows, "game int, id long, t_ms long").selectExpr("*", "timestamp_millis(t_ms + 1700000000000) as at")
        df.coalesce(1).write.mode("append").parquet(str(path))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    for name, how in (("kept_states", {}), ("dropped_states", {"event_time": "at", "idle_ms": day})):
        q = fold_stream(stream, "game", ["t_ms"], Throttle(100 * day), **how).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = sorted(r.id for r in spark.table(name).collect())
        assert got == ([0, 1] if name == "kept_states" else [0, 1, 5])


def test_the_filter_beats_raw_fixes_and_gates_jumps():
    rows = [dict(zip("game id t_ms lat lon accuracy_m mock".split(), r)) for r in walk(300, games=1)]
    out = run(ImmFilter(), rows)
    true = {i: 40 + 1.4 * 5 * i / 111195 for i in range(300)}
    err = lambda pairs: math.sqrt(sum(metres(true[i], -111, a, b) ** 2 for i, a, b in pairs) / len(pairs))
    assert err([(o[0], o[2], o[3]) for o in out[20:]]) < err([(r["id"], r["lat"], r["lon"]) for r in rows[20:]])
    assert all(abs(sum(o[6:9]) - 1) < 1e-9 for o in out) and out[-1][7] + out[-1][8] > 0.5
    far = at(5_000, rows[-1]["t_ms"] // 1000 + 5, 5.0, 999)
    verdicts = [x[1] for x in run(ImmFilter(), rows + [far, {**far, "t_ms": far["t_ms"] + 5000}, {**far, "t_ms": far["t_ms"] + 10000}])[-3:]]
    assert verdicts == ["gated", "gated", "relocated"]
    assert run(ImmFilter(), [at(0, 10), at(0, 10), at(0, 9), at(0, 11, 500.0)])[0][1] == "used" and len(run(ImmFilter(), [at(0, 10), at(0, 10), at(0, 9), at(0, 11, 500.0)])) == 1


def test_standing_still_is_seen():
    rng = random.Random(4)
    out = run(ImmFilter(), [at(rng.gauss(0, 2), 5 * i, 6.0, i) for i in range(80)])
    assert out[-1][6] > 0.6 and out[-1][5] < 0.5


def test_plain_filter():
    v = [x[1] for x in run(PlainFilter(), [at(0, 1000), at(0, 1001, 40.0), at(5000, 1003), at(5000, 1006), at(5000, 1009)])]
    assert v == ["used", "blurry", "gated", "gated", "used"]
    assert run(PlainFilter(), [at(3 * (i % 2), 1000 + 5 * i) for i in range(60)])[-1][2] < 12


def test_quests():
    p = (40.0, -111.0)
    dwell = QuestTracker("dwell", target=p, r=20, minutes=1)
    assert [x[2] for x in run(dwell, [at(0, 0), at(0, 30), at(99, 40), at(0, 50), at(0, 100), at(0, 111)])] == [False] * 5 + [True]
    courier = QuestTracker("courier", target=p, to=(40 + 500 / 111195, -111.0), r=20, limit_min=10)
    assert [x[1] for x in run(courier, [at(0, 0), at(500, 900), at(0, 1000), at(500, 1100)])] == [0.5, 0.0, 0.5, 1.0]
    trip = QuestTracker("round_trip", target=(40 + 300 / 111195, -111.0), home=p, r=20)
    assert [x[1] for x in run(trip, [at(0, 0), at(100, 1), at(300, 2), at(0, 3), at(0, 4)])] == [0.0, 0.1, 0.5, 1.0]
    line = QuestTracker("line", line=[(40 + i * 50 / 111195, -111.0) for i in range(11)], r=15, coverage=0.8)
    assert run(line, [at(50 * i, i) for i in range(9)])[-1][2] and run(line, [at(0, 0), at(500, 1)])[-1][1] < 0.3
    assert run(QuestTracker("reach", target=p, r=20), [at(0, 0, 50.0)]) == []


def test_timers():
    d = [{"t_ms": t * 1000, "value": v} for t, v in [(0, True), (1, False), (3, True), (10, False), (16, False), (20, True), (70, True)]]
    assert run(Debounce(), d) == [(0, True), (15000, False), (65000, True)]
    traps = [{"t_ms": 0, "kind": "a", "duration_ms": 10}, {"t_ms": 5, "kind": "a", "duration_ms": 10}, {"t_ms": 12, "kind": None, "duration_ms": None}, {"t_ms": 15, "kind": None, "duration_ms": None}]
    assert run(TrapTimer(), traps) == [(15, "a")]
    home = HomeWatch((40.0, -111.0))
    assert [x[1] for x in run(home, [at(0, 0), at(60, 10, 30.0), at(200, 20), at(0, 30), at(0, 40)])] == ["home", "away", "home"]


def test_smoother_and_turns():
    import numpy as np

    from strideframe.operators.tracks import smoothed, turns

    rng = np.random.default_rng(3)
    t = np.arange(0, 600, 5.0)
    true = np.column_stack([1.4 * t, 0.5 * t])
    x = smoothed(t, true + rng.normal(0, 5, true.shape), np.full(len(t), 5.0), 0.05)
    assert np.sqrt(((x[:, :2] - true) ** 2).sum(1).mean()) < 3.5 and abs(np.hypot(x[60, 2], x[60, 3]) - math.hypot(1.4, 0.5)) < 0.3
    north = [(i * 1000, 40 + 5 * i / 111195, -111.0) for i in range(20)]
    east = [((20 + i) * 1000, north[-1][1], -111 + 5 * (i + 1) / (111195 * math.cos(math.radians(40)))) for i in range(20)]
    found = turns(*zip(*(north + east)))
    assert len(found) == 1 and abs(found[0][0] - 19_000) <= 1000 and 80 < found[0][1] < 100
