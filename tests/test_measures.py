"""Jitter, loose ends, throttles, step histories and points inside rings against plain replays and hand-made cases."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from strideframe.functions import documents, geo
from strideframe.operators import measures as M
from strideframe.sources import files
from strideframe.streaming.fold import fold
from strideframe.streaming.machines import NearMissLog, SavePolicy, Throttle

SF = "/root/testdata/sf0.001"


def inside(lat, lon, ring):
    odd = False
    for (a, b), (c, d) in zip(ring, ring[-1:] + ring[:-1]):
        if (a > lat) != (c > lat) and lon < (d - b) * (lat - a) / (c - a) + b:
            odd = not odd
    return odd


def expected_inside(ring):
    mean = lambda *ps: (sum(p[0] for p in ps) / len(ps), sum(p[1] for p in ps) / len(ps))
    n, c = len(ring), mean(*ring)
    if n < 3 or inside(*c, ring):
        return [c]
    tried = [mean(ring[i], ring[(i + max(s, 1)) % n]) for s in (n // 2, n // 3, n // 4, 1) for i in range(n)] + [mean(ring[i], ring[(i + 1) % n], ring[(i + 2) % n]) for i in range(n)]
    # The midpoint of an edge is on the ring: rounding decides whether it counts.
    may = []
    for m in tried:
        if any(on_edge(m, a, b) for a, b in zip(ring, ring[1:] + ring[:1])):
            may.append(m)
        elif inside(*m, ring):
            return [*may, m]
    return [*may, ring[0]]


def on_edge(p, a, b):
    (x, y), (u, v) = (p[0] - a[0], p[1] - a[1]), (b[0] - a[0], b[1] - a[1])
    t = max(0.0, min(1.0, (x * u + y * v) / (u * u + v * v or 1.0)))
    return math.hypot(x - t * u, y - t * v) < 1e-9


def test_points_are_inside(spark):
    rng = random.Random(6)
    # Crescents and stars: the mean of the vertices is often outside.
    rings = [[(40 + rng.random() / 50, -111 + rng.random() / 50) for _ in range(rng.randint(1, 9))] for _ in range(150)]
    rings.append([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (9.0, 1.0), (1.0, 1.0), (0.0, 10.0)])
    df = spark.createDataFrame(list(enumerate(rings)), "k int, ring array<struct<lat:double,lon:double>>")
    outside = 0
    for r in df.select("k", geo.point_inside(F.col("ring")).alias("p")).collect():
        assert any(math.isclose(r.p.lat, lat, abs_tol=1e-9) and math.isclose(r.p.lon, lon, abs_tol=1e-9) for lat, lon in expected_inside(rings[r.k])), r.k
        outside += len(rings[r.k]) > 2 and not inside(*(sum(p[i] for p in rings[r.k]) / len(rings[r.k]) for i in (0, 1)), rings[r.k])
    assert outside > 5
    assert spark.createDataFrame([([],), (None,)], "ring array<struct<lat:double,lon:double>>").select(geo.point_inside(F.col("ring")).alias("p")).count() == 2


def test_jitter_of_one_window(spark):
    windows = spark.createDataFrame([("a", 0, 60_000), ("b", 0, 60_000)], "g string, from_ms bigint, to_ms bigint")
    step = 1 / geo.M_PER_DEG
    shown = [("a", 0, 1, 0.0, 0.0), ("a", 20_000, 2, 0.0, 0.0), ("a", 60_000, 3, 0.0, 3 * step), ("a", 60_001, 4, 1.0, 1.0), ("b", 5, 5, 0.0, 0.0)]
    (r,) = M.stationary_jitter(windows, spark.createDataFrame(shown, "g string, t bigint, id int, lat double, lon double"), "g", "t", "id").collect()
    assert r.g == "a" and r.held_share == 0.5 and all(math.isclose(x, y, rel_tol=1e-4) for x, y in ((r.rms_m, math.sqrt(3)), (r.path_m_per_min, 3.0), (r.drift_m_per_min, 3.0)))


def test_loose_ends_skip_their_own_other_end(spark):
    m = 1 / geo.M_PER_DEG
    rows = [("p", 0.0, 0.0, "q", 0.0, 8 * m, True), ("r", 0.0, 10 * m, "s", 0.0, 500 * m, False), ("u", 1.0, 1.0, "v", 1.0, 1.0 + 5 * m, True)]
    got = M.loose_ends(spark.createDataFrame(rows, "a string, a_lat double, a_lon double, b string, b_lat double, b_lon double, loose boolean")).collect()
    assert sorted((r.node, r.to_node, round(r.dist_m)) for r in got) == [("p", "r", 10), ("q", "r", 2)]


def test_goals_are_reached_once(spark):
    done = spark.createDataFrame([("a", 1, 10, 1), ("a", 1, 20, 2), ("a", 2, 30, 3), ("a", 3, 40, 4), ("a", 2, 50, 5), ("b", 1, 5, 6)], "g string, item int, t int, id int")
    assert [tuple(r) for r in M.goals_reached(done, "g", "item", "t", "id", 2).collect()] == [("a", 30, 3)]


def test_documents_that_cannot_be_played(spark):
    texts = [None, "", "[]", '{"schema_version":5}', '{"schema_version":9}', '{"schema_version":5,"goals":["all_trips"],"zones":[{"name":"z"}]}']
    got = [r.e for r in spark.createDataFrame([(t,) for t in texts], "t string").select(documents.slot_error(F.col("t")).alias("e")).collect()]
    assert got == ["bad document"] * 4 + ["unsupported version 9", None]


def run(machine, rows):
    state = machine.start()
    return [x for r in rows for x in machine.step(state, r)]


def test_throttles():
    rows = [{"id": i, "t_ms": t, "eventful": e} for i, (t, e) in enumerate([(0, False), (500, False), (600, True), (1_550, False), (1_600, False), (900, False), (100, False)])]
    assert [x[0] for x in run(SavePolicy(1_000), rows)] == [0, 2, 4, 6]
    assert [x[0] for x in run(Throttle(1_000), rows)] == [0, 3, 5, 6]


def test_near_misses_are_logged_again_after_a_while_or_for_another_reason():
    rows = [{"id": i, "t_ms": t, "place": p, "reason": r} for i, (t, p, r) in enumerate([(0, "x", "far"), (1, "x", "far"), (2, "y", "far"), (3, "x", "fast"), (30_002, "x", "fast"), (30_003, "x", "fast")])]
    assert [x[0] for x in run(NearMissLog(), rows)] == [0, 2, 3, 5]


def test_step_history_equals_a_replay(spark):
    rng = random.Random(11)
    rows, t = [], 0
    for i in range(400):
        t += rng.choice([0, 1000, 20_000, 70_000])
        rows.append((rng.choice("ab"), t, i, rng.choice([i, i, i, i, 3]), rng.random() < 0.5))
    want = []
    for g in "ab":
        at = {}
        for _, t, i, total, event in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], not r[4], r[2])):
            at.setdefault(t, (total, event))
        kept, last, event_ms = [], None, None
        for t, (total, event) in sorted(at.items()):
            kept = [k for k in kept if t - k[0] <= 120_000] if last is None or total >= last else []
            kept.append((t, total))
            last, event_ms = total, t if event else event_ms
            want.append((g, t, len(kept), total - kept[0][1], event_ms))
    df = spark.createDataFrame(rows + [("c", None, 1, 1, True), ("c", 5, 2, None, True)], "g string, t_ms long, id long, total long, event boolean")
    assert sorted(tuple(r) for r in M.step_history(df, "g").collect()) == sorted(want)
    assert M.step_history(df.limit(0), "g").count() == 0



def test_machines_by_key(spark):
    rows = spark.createDataFrame([(g, i, i * 400) for g in "ab" for i in range(6)], "g string, id bigint, t_ms bigint")
    assert sorted((r.g, r.id) for r in fold(rows, "g", ["t_ms"], Throttle(1_000)).collect()) == [("a", 0), ("a", 3), ("b", 0), ("b", 3)]


def test_documents_replace_their_own_kind(spark, tmp_path):
    path = str(tmp_path / "documents")
    write = lambda rows: files.write_documents(spark.createDataFrame(rows, "kind string, id string, n int"), path, "kind")
    write([("realm", "a", 1), ("realm", "b", 2), ("mark", "c", 3)])
    write([("realm", "a", 9)])
    got = spark.read.json(path).collect()
    assert sorted((r.kind, r.id, r.n) for r in got) == [("mark", "c", 3), ("realm", "a", 9)]


def test_logs_grow_in_files_of_bounded_length(spark, tmp_path):
    path = tmp_path / "log"
    for _ in range(2):
        files.append_log(spark.range(7).coalesce(1), str(path), 3)
    assert sorted(len(f.read_text().splitlines()) for f in path.glob("part-*")) == [1, 1, 3, 3, 3, 3]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["d15_stationary_jitter", "d21_matching_stats", "n03_loose_ends", "i26_sources", "i28_goal_once", "k12_slot_errors"])
def test_queries_have_rows(spark, name):
    from strideframe.plans import catalog

    assert catalog.queries()[name](spark, SF).count() > 0
