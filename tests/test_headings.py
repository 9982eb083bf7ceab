"""Courses, maneuvers and how a phone is carried, on planted walks."""

import random

from strideframe.functions.geo import M_PER_DEG
from strideframe.operators import heading
from strideframe.streaming.carry import CarryOffset, turned
from strideframe.streaming.fold import fold
from strideframe.streaming.imm import CourseFilter, ImmFilter, agreeing

FIX = "game long, id long, t_ms long, lat double, lon double, accuracy_m double, mock boolean"
K = 85_180.0  # metres in a degree of longitude at 40 north


def corner(speed, noise, accuracy, rng, at_s=30, seconds=60, game=1):
    """East, then north from at_s on."""
    for k in range(seconds):
        e, n = speed * min(k, at_s), speed * max(0, k - at_s)
        yield game, k, 1000 * k, 40 + (n + rng.gauss(0, noise)) / M_PER_DEG, -111 + (e + rng.gauss(0, noise)) / K, accuracy, False


def apart(a, b):
    return abs(turned(a - b))


def test_course_and_maneuver_follow_a_corner(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([*corner(1.4, 1.5, 5.0, rng), *corner(3.5, 0.0, 3.0, rng, game=2)], FIX)
    used = fold(df, "game", ["t_ms"], CourseFilter()).where("verdict in ('used', 'soft')").selectExpr("*", "cast(null as boolean) as held")
    rows = heading.maneuvers(used, "game", ["t_ms", "id"]).orderBy("game", "t_ms").collect()
    walk = {r.id: r for r in rows if r.game == 1}
    assert apart(walk[29].course_deg, 90) < 20 and min(k - 30 for k, r in walk.items() if k > 30 and r.course_deg is not None and apart(r.course_deg, 0) < 20) <= 10
    run = [r for r in rows if r.game == 2]
    shown = [r.id - 30 for r in run if r.id > 30 and min(apart(x, 0) for x in (r.maneuver_deg, r.course_deg, 180.0) if x is not None) < 30]
    assert shown[0] <= 5
    assert all(r.disagreeing == 0 for r in run if 5 < r.id <= 30) and all(r.line_deg is None for r in run if r.id < 3)


def test_lines_need_fixes_time_and_speed(spark):
    rows = [(1, i, 0, 40.0, -111.0, 3.0) for i in range(5)] + [(2, i, 1000 * i, 40.0, -111.0, 3.0) for i in range(5)] + [(3, i, 1000 * i, 40.0, 179.9999 + 0.0002 * i - (360 if i > 0 else 0), 3.0) for i in range(5)]
    got = heading.line_courses(spark.createDataFrame(rows, "game int, id int, t_ms long, lat double, lon double, sigma_m double"), "game", ["t_ms", "id"]).collect()
    assert all(r.line_deg is None for r in got if r.game < 3)  # one time; one place
    east = [r.line_deg for r in got if r.game == 3 and r.line_deg is not None]
    assert len(east) == 2 and all(apart(x, 90) < 0.01 for x in east)  # across longitude 180
    empty = spark.createDataFrame([], "game int, id int, t_ms long, lat double, lon double, sigma_m double")
    assert heading.line_courses(empty, "game", ["t_ms"]).count() == 0


def carried(offsets, rng, every=3, sigma=8.0):
    """Courses (a wandering walk) and what the compass of a phone shows that is turned by each offset for some seconds."""
    t, course = 0, 40.0
    for seconds, offset in offsets:
        for _ in range(seconds // every):
            t, course = t + every, course + rng.gauss(0, 10)
            yield {"id": t, "t_ms": 1000 * t, "course_deg": course % 360, "course_sigma_deg": sigma, "azimuth_deg": (course - offset + rng.gauss(0, sigma)) % 360, "azimuth_sigma_deg": sigma, "rate_deg_s": 3.0}


def learn(rows):
    m = CarryOffset()
    s = m.start()
    return [x for r in rows for x in m.step(s, r)]


def test_the_offset_is_learned_and_relearned_across_north():
    for seed in range(10):
        out = learn(carried([(300, 170.0), (300, -120.0)], random.Random(seed)))
        before = [x for x in out if x[0] <= 300]
        assert apart(before[-1][3], 170) < 15 and before[-1][6] > 0.5
        assert not any(x[7] for x in before)
        noticed = [x[0] for x in out if x[0] > 300 and x[7]]
        assert noticed and noticed[0] <= 318  # within six courses
        assert apart(out[-1][3], -120) < 15 and out[-1][6] > 0.5


def test_one_wrong_course_a_turning_compass_and_nulls_change_nothing():
    rows = list(carried([(120, 60.0)], random.Random(3)))
    out = learn(rows)
    odd = {**rows[-1], "t_ms": rows[-1]["t_ms"] + 3000, "course_deg": (rows[-1]["course_deg"] + 175) % 360}
    assert learn([*rows, odd])[-1][3] == out[-1][3] and not learn([*rows, odd])[-1][7]
    for bad in ({"rate_deg_s": 30.0}, {"rate_deg_s": None}, {"course_deg": float("nan")}, {"t_ms": rows[-1]["t_ms"]}):
        assert learn([*rows, {**odd, **bad}]) == out


def test_headings_in_gaps(spark):
    offsets = spark.createDataFrame([(1, 10_000, 90.0, 50.0, 6.0, True), (2, 10_000, 90.0, 50.0, 6.0, False)], "game int, t_ms long, course_deg double, offset_deg double, sigma_deg double, steady boolean")
    asked = spark.createDataFrame([(g, t, a, s) for g in (1, 2, 3) for t, a, s in ((5_000, 10.0, 8.0), (11_000, 340.0, 8.0), (12_000, None, None), (400_000, 340.0, 8.0))], "game int, t_ms long, azimuth_deg double, azimuth_sigma_deg double")
    got = {(r.game, r.t_ms): (r.heading_deg and round(r.heading_deg, 6), r.heading_sigma_deg and round(r.heading_sigma_deg, 6), r.by) for r in heading.gap_headings(asked, offsets, "game").collect()}
    assert got[1, 11_000] == (30.0, round((36 + 4 + 64) ** 0.5, 6), "compass")
    assert got[1, 12_000] == (90.0, 14.0, "course") and got[1, 400_000] == (90.0, 90.0, "course")  # no reading; too long ago
    assert got[2, 11_000] == (90.0, 12.0, "course") and got[1, 5_000] == got[3, 11_000] == (None, None, None)
    assert len(got) == 12


def test_relocations_need_time_agreement_or_two_good_fixes():
    far = lambda t, e=5000.0, acc=30.0: [e, 0.0, acc, 1000 * t]
    assert agreeing([far(0), far(0.5), far(1)], 0) is None  # three within a second
    assert agreeing([far(0), far(1), far(2)], 0) == (far(0), far(2))
    assert agreeing([far(0), far(1), far(2, 9000.0)], 0) is None
    assert agreeing([far(1, acc=10.0), far(2, -9000.0), far(21, acc=15.0)], 0) == (far(1, acc=10.0), far(21, acc=15.0))
    assert agreeing([far(1, acc=10.0), far(2, -9000.0), far(21, acc=25.0)], 0) is None
    rows = [dict(zip("game id t_ms lat lon accuracy_m mock".split(), r)) for r in corner(1.4, 1.0, 5.0, random.Random(1), seconds=40)]
    for i in range(6):  # on a train, 20 m/s, from 5 km away
        rows.append({**rows[39], "id": 40 + i, "t_ms": 40_000 + 1000 * i, "lon": -111 + (5000 + 20 * i) / K})
    m = ImmFilter()
    s = m.start()
    out = [x for r in rows for x in m.step(s, r)]
    assert [x[1] for x in out[-6:]] == ["gated", "gated", "relocated", "used", "used", "used"]
    assert out[-1][8] > 0.5 and 15 < out[-1][5] < 25  # goes on fast, at that speed
    assert len(s["gated"]) == 0
