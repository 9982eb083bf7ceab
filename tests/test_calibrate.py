"""The step calibrator relearns a planted change."""

import random

from strideframe.functions.geo import M_PER_DEG
from strideframe.streaming.bridge import step_metres
from strideframe.streaming.calibrate import StepCalibrator
from strideframe.streaming.fold import fold

ROWS = "game long, id long, t_ms long, lat double, lon double, uncertainty_m double, good boolean, steps long"


def walk(game, scales, rng, noise=1.5):
    """A straight walk, two steps a second; scales: (seconds, metres a step over the model's)."""
    north, out, t = 0.0, [], 0
    for seconds, k in scales:
        for _ in range(seconds):
            t += 1
            north += k * step_metres(2, 1.0)
            out.append((game, t, 1000 * t, 40 + (north + rng.gauss(0, noise)) / M_PER_DEG, -111.0 + rng.gauss(0, noise) / 85_000, 4.0, True, 2))
    return out


def test_relearns_after_a_planted_change(spark):
    rng = random.Random(2)
    rows = [x for g in range(10) for x in walk(g, [(1200, 0.9), (1200, 1.2)], rng)]
    got = {}
    for r in fold(spark.createDataFrame(rows, ROWS), "game", ["t_ms"], StepCalibrator()).collect():
        got.setdefault(r.game, []).append((r.id, r.scale, r.changed))
    assert len(got) == 10
    for own in got.values():
        own.sort()
        before, after = [k for i, k, _ in own if i <= 1200][-1], own[-1][1]
        assert abs(before - 0.9) <= 0.07 and abs(after - 1.2) <= 0.07
        assert any(c for i, _, c in own if 1200 < i <= 1600)  # noticed within a few stretches
        relearned = [i for i, k, _ in own if i > 1200 and abs(k - 1.2) <= 0.07]
        assert relearned and relearned[0] <= 1600


def test_gaps_and_bad_rows_break_a_stretch():
    m, s, out = StepCalibrator(), StepCalibrator().start(), []
    for g, i, t, lat, lon, unc, good, n in walk(0, [(400, 1.0)], random.Random(1)):
        out += m.step(s, {"id": i, "t_ms": t + (60_000 * (i // 50)), "lat": lat, "lon": lon, "uncertainty_m": unc, "good": good, "steps": n})
    assert out == []  # no stretch of 60 s
    for i in range(200):
        out += m.step(s, {"id": i, "t_ms": 10**7 + 1000 * i, "lat": 40.0, "lon": -111.0, "uncertainty_m": 4.0, "good": i % 30 > 0, "steps": 2})
    assert out == []  # standing, and broken by bad rows
