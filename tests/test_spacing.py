"""Spaced choices as rounds of joins, against the greedy loop."""

import hashlib
import math
import random

from strideframe.operators import joins, spacing

TYPES = "part long, id string, lat double, lon double"


def metres(a, b):
    x, y = math.radians(a[0]), math.radians(b[0])
    h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def rolled(seed, i):
    return int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16)


def greedy(pool, apart, seed, avoid=()):
    """{part: ids in the order taken}"""
    out, taken = {}, {}
    for part, i, lat, lon in sorted({p for p in pool if None not in p[1:]}, key=lambda p: (rolled(seed, p[1]), *p[1:])):
        if all(metres((lat, lon), q) >= apart for q in [*taken.get(part, []), *((a, o) for p, a, o in avoid if p == part)]):
            taken.setdefault(part, []).append((lat, lon))
            out.setdefault(part, []).append(i)
    return out


def cloud(n, lat, lon, wide, parts, rng):
    return [(rng.randrange(parts), f"p{lat}:{k}", lat + rng.uniform(-wide, wide), (lon + rng.uniform(-wide, wide) + 180) % 360 - 180) for k in range(n)]


def test_spaced_equals_the_greedy_choice(spark):
    rng = random.Random(1)
    pool = cloud(300, 40.0, -111.0, 0.01, 2, rng) + cloud(80, 10.0, 180.0, 0.005, 1, rng) + cloud(60, 89.99, 0.0, 0.01, 1, rng)
    pool += [(0, f"hot{k}", 40.001, -111.001) for k in range(200)] + pool[:20]  # a crowd on one spot, repeated rows
    pool += [(None, "x", 40.0, -111.0), (None, "y", 40.0, -111.0), (0, None, 40.0, -111.0), (0, "z", None, 1.0)]
    avoid = [(0, 40.002, -111.002), (1, None, 2.0), (1, 40.0, -111.0), (1, 40.0, -111.0)]
    rows = spark.createDataFrame([(*p, 1) for p in pool], TYPES + ", own long").withColumnRenamed("own", "k")
    bad = spark.createDataFrame(avoid, "part long, lat double, lon double")
    want = greedy(pool, 150.0, 7, [a for a in avoid if None not in a])
    got = {}
    for r in spacing.spaced(rows, ["part"], 150.0, 7, bad).collect():
        got.setdefault(r.part, []).append(r.id)
    assert {p: sorted(i) for p, i in got.items()} == {p: sorted(i) for p, i in want.items()}
    assert spacing.spaced(rows.limit(0), ["part"], 150.0, 7).count() == 0
    assert spacing.spaced(rows, ["part"], 0.0, 7).count() == len({p for p in pool if None not in p[1:]})


def test_far_rows_stay_whatever_is_crowded(spark):
    a = spark.createDataFrame([(1, 40.0, -111.0), (1, 40.01, -111.0), (2, 40.0, -111.0), (1, None, 0.0)], "part long, lat double, lon double")
    b = spark.createDataFrame([(1, 40.0, -111.0)] * 50 + [(2, None, None)], "part long, lat double, lon double")
    assert sorted((r.part, r.lat or 0) for r in joins.without_near(a, b, 100.0, ["part"]).collect()) == [(1, 0), (1, 40.01), (2, 40.0)]
    plan = joins.without_near(a, b, 100.0, ["part"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_top_up_to_the_wanted_number(spark):
    rng = random.Random(2)
    pool = cloud(80, 40.0, -111.0, 0.004, 2, rng) + [(5, "only", 1.0, 1.0)]
    items = [(0, 0, "a", 40.0, -111.0, True), (0, 1, "b", 40.001, -111.0, False), (0, 7, "c", 40.003, -111.0, None), (1, 0, "d", 40.0, -111.0, False)]
    got = spacing.top_up(spark.createDataFrame(items, "part long, no long, id string, lat double, lon double, picked boolean"), spark.createDataFrame(pool, TYPES), ["part"], 4, 200.0, 9).collect()
    live = [(p, la, lo) for p, _, _, la, lo, picked in items if not picked]
    order = greedy(pool, 200.0, 9, live)
    new = {p: sorted((r.no, r.id) for r in got if r.part == p and r.added) for p in (0, 1, 5)}
    assert new[0] == [(8 + k, i) for k, i in enumerate(order[0][:2])]
    assert new[1] == [(1 + k, i) for k, i in enumerate(order[1][:3])]
    assert new[5] == [(0, "only")]
    assert {r.part: r.full for r in got} == {0: True, 1: True, 5: False}
    assert sorted(r.id for r in got if not r.added) == ["b", "c", "d"]


def slow_items(pool, n, home, lo, hi, apart, seed, keep=()):
    hi, out = max(hi, lo + 2 * apart), []
    near = [(i, la, lo_, metres(home, (la, lo_))) for i, la, lo_ in pool]
    near = [p for p in near if lo <= p[3] <= hi * 1.5]
    for k in range(n, 0, -1):
        free = [p for p in near if all(metres(p[1:3], q) >= apart for q in [*keep, *(o[1:3] for o in out)])]
        if not free:
            return None
        out.append(min(free, key=lambda p: (round(abs(p[3] - (lo + (hi - lo) * k / n)), 6), rolled(seed, p[0]), p[0])))
    return out[::-1]


def test_items_are_placed_and_moved_as_by_brute_force(spark):
    rng, home = random.Random(3), (40.0, -111.0)
    pool = cloud(150, 40.0, -111.0, 0.01, 3, rng) + [(4, "few", 40.003, -111.0)]
    rows = spark.createDataFrame(pool, TYPES)
    quotas = spark.createDataFrame([(0, 5), (1, 2), (2, 0), (4, 3), (9, 1)], "part long, n long")
    of = lambda p: [x[1:] for x in pool if x[0] == p]
    got = {}
    for r in spacing.place_items(rows, quotas, ["part"], home, 100.0, 800.0, 120.0, 4).orderBy("part", "k").collect():
        got.setdefault(r.part, []).append(r.id)
    assert got == {p: [i for i, *_ in slow_items(of(p), n, home, 100.0, 800.0, 120.0, 4)] for p, n in ((0, 5), (1, 2))}
    items = [(p, k, f"old{p}{k}", 40.002 + k / 1000, -111.0, k == 1) for p in (0, 1) for k in range(4)] + [(4, k, f"old4{k}", 1.0, 1.0, None) for k in range(2)]
    moved = spacing.replace_unpicked(spark.createDataFrame(items, "part long, no long, id string, lat double, lon double, picked boolean"), rows, ["part"], home, 100.0, 800.0, 120.0, 4)
    found = {(r.part, r.no): (r.id, r.moved) for r in moved.collect()}
    assert len(found) == 10 and found[4, 0] == ("old40", False) and found[4, 1] == ("old41", False)
    for p in (0, 1):
        fresh = sorted(slow_items(of(p), 3, home, 100.0, 800.0, 120.0, 4, [(40.003, -111.0)]), key=lambda x: (x[3], x[0]))
        assert found[p, 1] == (f"old{p}1", False)
        assert [found[p, k] for k in (0, 2, 3)] == [(f[0], True) for f in fresh]
    assert spacing.place_items(rows.limit(0), quotas, ["part"], home, 100.0, 800.0, 120.0, 4).count() == 0
    assert spacing.place_items(rows, quotas.limit(0), ["part"], home, 100.0, 800.0, 120.0, 4).count() == 0
