"""The segments nearest to each point, against the join of all that are near."""

import random

import pytest

from strideframe.operators import joins, matching, segments
from strideframe.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("lat, lon, held", [(40.0, -111.0, None), (0.0, 179.995, None), (89.98, 100.0, 64), (-84.5, 179.99, 64)])
def test_nearest_segments_equal_the_join(spark, monkeypatch, lat, lon, held):
    if held:  # blocks of a few points
        monkeypatch.setattr(segments, "HELD", held)
    rng = random.Random(4)
    wrap = lambda x: (x + 180) % 360 - 180
    at = lambda: (min(90.0, lat + rng.random() / 60), wrap(lon + rng.random() / 60))
    spots = [at() for _ in range(60)]
    pts = [(i, *(rng.choice(spots) if i % 3 else at())) for i in range(150)] + [(200, None, lon), (201, lat, None)]
    # Many from one spot, so that ties go by the name, and one without length.
    segs = [(f"s{i}", *(rng.choice(spots) if i % 2 else at()), *(rng.choice(spots) if i % 3 else at())) for i in range(600)] + [("point", *spots[0], *spots[0]), ("none", None, lon, lat, lon)]
    df, sf = spark.createDataFrame(pts, "id int, lat double, lon double"), spark.createDataFrame(segs, "seg string, a_lat double, a_lon double, b_lat double, b_lon double")
    for radius, k, digits in ((120.0, 4, 6), (40.0, 1, None)):
        every = joins.segment_join(df, sf, radius)
        every = every.selectExpr("*", "round(dist_m, 6) d").drop("dist_m").withColumnRenamed("d", "dist_m") if digits else every
        want = sorted((r.id, r["rank"], r.seg, r.dist_m) for r in joins.nearest(every, ["id"], k, "seg").collect())
        got = sorted((r.id, r["rank"], r.seg, r.dist_m) for r in segments.nearest_segments(df, sf, radius, ["id"], k, digits).collect())
        assert got == want and len(got) > 100
    assert segments.nearest_segments(df.limit(0), sf, 50.0, ["id"]).count() == segments.nearest_segments(df, sf.limit(0), 50.0, ["id"]).count() == 0


@pytest.mark.parametrize("name", ["c06_nearest_on_segments", "l05_settled", "l05_settled_areas"])
def test_queries_of_near_segments_make_no_pairs(spark, monkeypatch, name):
    whole = joins.segment_join

    def few(points, lines, *how, **more):
        assert lines.count() < 100, "a join of all that is within the radius"
        return whole(points, lines, *how, **more)

    monkeypatch.setattr(joins, "segment_join", few)
    assert catalog.queries()[name](spark, SF).count() > 0


def test_street_spots_make_no_pairs(spark, monkeypatch):
    rng = random.Random(9)
    at = lambda: (40.0 + rng.random() / 500, -111.0 + rng.random() / 500)
    fixes = spark.createDataFrame([(1, i, *at(), rng.choice([None, 1.0, 9.0])) for i in range(60)], "game int, id int, lat double, lon double, accuracy_m double")
    streets = spark.createDataFrame([(f"s{i}", *at(), *at()) for i in range(150)], "seg string, a_lat double, a_lon double, b_lat double, b_lon double")
    every = joins.segment_join(fixes.withColumn("sigma_m", matching.sigma_m()), streets, matching.MOST_RADIUS_M).where("dist_m <= 3 * sigma_m + 10")
    want = sorted((r.id, r["rank"] - 1, r.seg, r.dist_m) for r in joins.nearest(every, ["game", "id"], 8, "seg").collect())

    def refuse(*_, **__):
        raise AssertionError("a join of all that is within the radius")

    monkeypatch.setattr(joins, "segment_join", refuse)
    got = sorted((r.id, r.n, r.seg, r.dist_m) for r in matching.street_spots(fixes, streets, "game").collect())
    assert got == want and len(got) > 200
