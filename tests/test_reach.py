"""Fixpoints, thick places, clipped rings and ways straight on, against brute force."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strideframe.functions import geo
from strideframe.operators import assignment, clusters, graph, reach


def slow_reached(locations, needs):
    """{location: round} of one key."""
    wanted = {}
    for at, item, n in needs:
        wanted.setdefault(at, []).append((item, n))
    have, out, k = Counter(), {}, 0
    while True:
        new = [at for at, _ in locations if at not in out and all(have[i] >= n for i, n in wanted.get(at, []))]
        if not new:
            return out
        out |= {at: k for at in new}
        have.update(r for at, r in locations if at in set(new) and r)
        k += 1


def test_reached_equals_brute_force(spark):
    rng = random.Random(5)
    locs, needs, want = [], [], {}
    for g in range(12):
        own = [(g * 100 + i, rng.choice(["key", "key", "tool", "lamp", None])) for i in range(30)]
        own_needs = [(at, rng.choice(["key", "tool", "lamp"]), rng.randrange(0, 6)) for at, _ in own for _ in range(rng.randrange(3))]
        locs += [(g, *x) for x in own]
        needs += [(g, *x) for x in own_needs]
        want |= {(g, at): r for at, r in slow_reached(own, own_needs).items()}
    for i in range(7):  # each opens the next
        locs.append((99, i, f"k{i}"))
        needs += [(99, i, f"k{i - 1}", 1)] if i else []
        want[99, i] = i
    locs.append((98, 1, "key"))
    needs += [(98, 1, "key", 1), (98, 7, "key", 1)]  # needs itself; a location that isn't there
    a = spark.createDataFrame(locs + locs[:5], "game long, location_id long, reward string")
    b = spark.createDataFrame(needs + needs[:5], "game long, location_id long, item string, n long")
    assert {(r.game, r.location_id): r.round for r in reach.reached(a, b, "game").collect()} == want
    said = {r.game: r for r in reach.beatable(a, b, "game").collect()}
    assert said[99].beatable and said[99].rounds == 6 and not said[98].beatable and said[98].opened == 0
    assert reach.beatable(a.limit(0), b, "game").count() == 0


def test_placed_rewards_keep_a_game_winnable(spark):
    rng = random.Random(6)
    locs = [(g, g * 100 + i, rng.randrange(4) if i else 0, i % 3 > 0 or i == 0, rng.random()) for g in range(20) for i in range(24)]
    items = [(g, k, f"tool{k}", k) for g in range(20) for k in (1, 2, 3)] + [(50, 1, "tool1", 1)]
    a = spark.createDataFrame(locs, "game long, location_id long, zone long, holds boolean, o double")
    b = spark.createDataFrame(items, "game long, item_no long, item string, zone long")
    zone = {at: (z, h) for _, at, z, h, _ in locs}
    placed = reach.place_rewards(a, b, "game", "o").collect()
    assert len(placed) == len(items) and [r.location_id for r in placed if r.game == 50] == [None]
    mine = [r for r in placed if r.game < 50]
    assert len({r.location_id for r in mine}) == 60 and all(zone[r.location_id][0] < r.item_no and zone[r.location_id][1] for r in mine)
    rewards = a.join(spark.createDataFrame([tuple(r) for r in mine], "game long, item_no long, reward string, location_id long").drop("item_no"), ["game", "location_id"], "left")
    needs = a.select("game", "location_id", F.explode(F.sequence(F.lit(0), F.col("zone"))).alias("z")).select("game", "location_id", F.concat(F.lit("tool"), "z").alias("item"), F.when(F.col("z") > 0, 1).otherwise(0).alias("n"))
    assert all(r.beatable for r in reach.beatable(rewards, needs, "game").collect())


def test_two_planted_clusters(spark):
    rng = np.random.default_rng(2)
    light, heavy = rng.normal(0, 4, (200, 2)) + [1e6, -1e6], rng.normal(0, 4, (120, 2)) + [1e6 + 300, -1e6]
    rows = [(k, float(x), float(y), w) for k, (lo, hi) in (("a", (0.1, 1.0)), ("b", (1.0, 0.1))) for pts, w in ((light, lo), (heavy, hi)) for x, y in pts]
    rows += [("c", 5.0, 6.0, 2.0), ("d", None, 1.0, 1.0), ("d", 1.0, 1.0, 0.0)]
    got = {r.k: r for r in clusters.thickest(spark.createDataFrame(rows, "k string, x double, y double, w double"), "k", 15.0).collect()}
    assert math.hypot(got["a"].x - 1e6 - 300, got["a"].y + 1e6) < 2 and math.hypot(got["b"].x - 1e6, got["b"].y + 1e6) < 2
    assert (got["c"].x, got["c"].y, got["c"].inside) == (5.0, 6.0, 2.0) and "d" not in got and got["a"].inside > 110


def test_moments_far_from_the_origin(spark):
    rng = np.random.default_rng(4)
    x, y, w = rng.normal(1e9, 2, 500), rng.normal(-1e9, 3, 500), rng.uniform(0.1, 1, 500)
    df = spark.createDataFrame([("a", float(a), float(b), float(c)) for a, b, c in zip(x, y, w)] + [("b", None, 1.0, 1.0)], "k string, x double, y double, w double")
    (r,) = clusters.weighted_moments(df, "k").collect()
    want = np.cov(x - 1e9, y + 1e9, aweights=w, ddof=0)
    assert np.allclose([r.cov_xx, r.cov_xy, r.cov_yy], [want[0, 0], want[0, 1], want[1, 1]], rtol=1e-4, atol=1e-4)


def test_every_place_has_a_trap_point(spark):
    spot = lambda i, m: (f"s{i}", 40 + m / 111_195, -111.0)
    places = spark.createDataFrame([("near", 40.0, -111.0), ("alone", 50.0, 10.0), ("none", None, 1.0)], "id string, lat double, lon double")
    spots = spark.createDataFrame([spot(1, 70.0), spot(2, 90.0), spot(3, 150.0)], "id string, lat double, lon double")
    got = {r.id: r for r in assignment.trap_points(places, spots, 60, 100, 3).collect()}
    assert set(got) == {"near", "alone"} and got["near"].spot in ("s1", "s2") and got["alone"].spot is None
    assert abs(slow_metres((50.0, 10.0), (got["alone"].lat, got["alone"].lon)) - 80) < 0.1
    far = {r.id: r for r in assignment.trap_points(places, spots.where("id = 's3'"), 60, 100, 3).collect()}
    assert far["near"].spot == "s3"


def test_rings_over_longitude_180(spark):
    ring = [(0.0, 179.0), (2.0, 179.0), (2.0, -178.0), (0.0, -178.0)]
    df = spark.createDataFrame([([{"lat": a, "lon": b} for a, b in ring],)], "r array<struct<lat:double,lon:double>>")
    boxes = df.select(geo.bounding_boxes(F.col("r"), 180.0).alias("b")).first().b
    assert [tuple(b) for b in boxes] == [(0.0, 179.0, 2.0, 180.0), (0.0, -180.0, 2.0, -178.0)]
    boxes = df.select(geo.bounding_boxes(F.col("r"), -179.5).alias("b")).first().b
    assert [tuple(b) for b in boxes] == [(0.0, 179.0, 2.0, 180.0), (0.0, -180.0, 2.0, -178.0)]
    square = spark.createDataFrame([([{"lat": a, "lon": b} for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 2.0), (0.0, 2.0))],)], "r array<struct<lat:double,lon:double>>")
    west = square.select(geo.clip_at_lon(F.col("r"), 0.5, False).alias("c")).first().c
    assert sorted(tuple(p) for p in west) == [(0.0, 0.0), (0.0, 0.5), (1.0, 0.0), (1.0, 0.5)]
    assert square.select(geo.clip_at_lon(F.col("r"), 3.0, True).alias("c")).first().c == []
    assert [tuple(b) for b in square.select(geo.bounding_boxes(F.col("r"), 0.0).alias("b")).first().b] == [(0.0, 0.0, 1.0, 2.0)]


def slow_bearing(a, b):
    p, q, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    return math.degrees(math.atan2(math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d))) % 360


def slow_metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(h))


def test_straight_on_equals_brute_force(spark):
    rng = random.Random(8)
    spots = [(40 + rng.randrange(6) * 1e-4 + rng.random() * 2e-5, -111 + rng.randrange(6) * 1e-4) for _ in range(40)]
    segs = [(f"s{i:03}", *rng.choice(spots), *rng.choice(spots)) for i in range(160)]
    df = spark.createDataFrame(segs, "seg string, a_lat double, a_lon double, b_lat double, b_lon double")
    ends = {s: ((a, b), (c, d)) for s, a, b, c, d in segs}
    name = lambda p: f"{round(p[0] * 1e7)},{round(p[1] * 1e7)}"
    starts = [(s, s, name(q), slow_bearing(p, q)) for s, (p, q) in ends.items() if p != q]
    want = []
    for i, seg, node, bearing in starts:
        steps, carried = 0, 0.0
        while steps < 8 and carried < 30:
            on = []
            for s, (p, q) in ends.items():
                for u, v in ((p, q), (q, p)):
                    if s != seg and name(u) == node and name(u) != name(v):
                        turn = abs((slow_bearing(u, v) - bearing + 180) % 360 - 180)
                        if turn <= 30:
                            on.append((round(turn, 6), s, name(v), slow_bearing(u, v), slow_metres(u, v)))
            if not on:
                break
            _, seg, node, bearing, length = min(on)
            steps, carried = steps + 1, carried + length
        want.append((i, steps, seg, node))
    got = graph.straight_on(spark.createDataFrame(starts, "id string, seg string, node string, bearing double"), df).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and max(w[1] for w in want) >= 2
