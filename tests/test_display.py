"""Held positions and the display at a time that is asked for."""

import random

import pytest

from strideframe.functions.geo import M_PER_DEG
from strideframe.streaming import display
from strideframe.streaming.fold import fold
from strideframe.streaming.machines import metres

EST = "game string, id long, t_ms long, lat double, lon double, uncertainty_m double, speed_mps double, p_still double, steps long"


def rows_of(spots, steps=None, p=0.95):
    return [("g", i, 1000 * i, 40 + n / M_PER_DEG, -111 + e / (M_PER_DEG * 0.766), 4.0, 0.1, p, (steps or {}).get(i)) for i, (e, n) in enumerate(spots)]


def held(spark, rows):
    return sorted((r.id, r.held, r.lat, r.lon) for r in fold(spark.createDataFrame(rows, EST), "game", ["t_ms", "id"], display.Hold()).collect())


def test_standing_is_still_and_leaving_ends_it(spark):
    rng = random.Random(1)
    spots = [(rng.gauss(0, 1.5), rng.gauss(0, 1.5)) for _ in range(60)] + [(20 + 2 * i, 0) for i in range(6)]
    got = held(spark, rows_of(spots))
    first = got[0][2:]
    assert all(h and metres(a, b, *first) <= 2 for _, h, a, b in got[:61])  # jitter within 2 m, one far row alone changes nothing
    assert not got[61][1] and got[62][1]  # the second far row ends it; where standing is still likely the next one begins a new hold
    assert metres(*got[62][2:], *first) > 20


def test_steps_end_a_hold_and_moving_begins_none(spark):
    got = held(spark, rows_of([(0, 0)] * 30, {10: 2}))
    assert [h for _, h, _, _ in got] == [True] * 10 + [False] * 10 + [True] * 10
    assert not any(h for _, h, _, _ in held(spark, rows_of([(0, 0)] * 5, p=0.5)))
    far = [(0, 0)] * 21 + [(10, 0)] * 5  # a counter that is quiet: 10 m is drift
    assert all(h for _, h, _, _ in held(spark, rows_of(far, {0: 1}))[11:])


def test_display_at_a_time(spark):
    est = [("g", 10_000, 1, 40.0, -111.0, 5.0, 2.0, 90.0, False), ("g", 50_000, 2, 40.001, -111.0, 6.0, 2.0, None, False), ("g", 90_000, 3, 40.002, -111.0, 7.0, 2.0, 0.0, True)]
    e = spark.createDataFrame(est, "game string, t_ms long, id long, lat double, lon double, uncertainty_m double, speed_mps double, course_deg double, standing boolean")
    a = spark.createDataFrame([("g", t) for t in (5_000, 10_000, 12_000, 17_000, 45_000, 51_000, 92_000)] + [("h", 1)], "game string, t_ms long")
    got = {(r.game, r.t_ms): r for r in display.shown(a, e, "game").collect()}
    assert got["g", 5_000].source is None and got["h", 1].lat is None
    moved = lambda t: metres(40.0, -111.0, got["g", t].lat, got["g", t].lon)
    assert moved(10_000) == pytest.approx(0, abs=1e-6) and moved(12_000) == pytest.approx(4, abs=1e-3) and moved(17_000) == moved(45_000) == pytest.approx(6, abs=1e-3)
    assert [got["g", t].source for t in (12_000, 17_000, 45_000)] == ["fresh", "predicted", "stale"]
    assert got["g", 17_000].uncertainty_m == pytest.approx(8.5) and got["g", 51_000].lat == pytest.approx(40.001) and got["g", 92_000].lat == pytest.approx(40.002)
    assert display.shown(a.limit(0), e, "game").count() == 0
