"""Turns, inner points and loose ends over many small groups."""

import math
import random

from pyspark.sql import functions as F

from strideframe.functions import geo
from strideframe.operators import joins, measures, tracks


def test_turns_of_many_tracks_without_a_group_each(spark):
    rng = random.Random(6)
    rows = [(w if w else None, f"k{w % 2}", i * 1000, 40 + rng.random() / 100, -111 + rng.random() / 100) for w in range(300) for i in range(rng.randrange(1, 8))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "way int, kind string, t_ms bigint, lat double, lon double").repartition(7)
    out = tracks.detect_turns(df, ["way", "kind"])
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    want = []
    for w in {r[:2] for r in rows}:
        own = sorted(r[2:] for r in rows if r[:2] == w)
        want += [(*w, *t) for t in tracks.turns(*zip(*own))]
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key) and len(want) > 100
    assert tracks.detect_turns(df.limit(0), ["way", "kind"]).count() == 0


def test_a_ring_and_its_middle_are_spelled_out_once(spark):
    rings = spark.range(3).select(F.transform(F.sequence(F.lit(0), F.col("id").cast("int") + 2), lambda i: F.struct((F.sin(i * 40.0) * i).alias("lat"), F.cos(i * 40.0).alias("lon"))).alias("ring"))
    at = geo.point_inside(F.transform("ring", lambda p: F.struct(p["lat"].alias("lat"), (p["lon"] + 7.5).alias("lon"))))
    plan = rings.select(at.alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("7.5") == 1
    assert all(math.isfinite(r.p.lat) for r in rings.select(at.alias("p")).collect())


def test_loose_ends_of_a_crowd_make_no_pairs(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a join of all that is within the radius")

    rng = random.Random(8)
    spots = [(40 + rng.random() / 2000, -111 + rng.random() / 2000) for _ in range(40)]
    rows = [(f"c{i % 30}", *spots[i % 30], f"o{i}", *rng.choice(spots), i % 2 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "a string, a_lat double, a_lon double, b string, b_lat double, b_lon double, loose boolean")
    nodes = {r[0]: r[1:3] for r in rows} | {r[3]: r[4:6] for r in rows}
    of = spark.createDataFrame([(n, *at) for n, at in nodes.items()], "node string, lat double, lon double")
    near = joins.radius_join(of, of, 30.0).where("r_node <> node").collect()
    want = {}
    for r in rows:
        found = sorted((x.dist_m, x.r_node) for x in near if x.node == r[3] and x.r_node != r[0])
        if r[6] and found:
            want[r[3]] = (found[0][1], found[0][0])
    monkeypatch.setattr(joins, "radius_join", refuse)
    assert {r.node: (r.to_node, r.dist_m) for r in measures.loose_ends(df, join_m=30.0).collect() if r.node[0] == "o"} == want
