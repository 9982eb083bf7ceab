"""What is nearest, found without pairs, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from strideframe.functions import geo
from strideframe.operators import joins
from strideframe.plans import catalog

SF = "/root/testdata/sf0.001"


def brute(left, right, radius, k, kinds=False):
    pairs = left.crossJoin(right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))).withColumn("dist_m", geo.distance_m("lat", "lon", "r_lat", "r_lon")).where(F.col("dist_m") <= radius)
    near = {}
    for x in pairs.where("kind = r_kind").collect() if kinds else pairs.collect():
        near.setdefault(x.id, []).append((x.dist_m, x.r_id))
    return {i: [(n + 1, round(m, 6), r) for n, (m, r) in enumerate(sorted(v)[:k])] for i, v in near.items()}


def crowd(rng, n, lat, lon, deg):
    """Points of which many share a spot, and some lie in a small heap."""
    spots = [(lat + rng.random() * deg, lon + rng.random() * deg * 2) for _ in range(n // 2)] + [(lat + rng.random() * deg / 100, lon + rng.random() * deg / 100) for _ in range(n // 4)]
    spots += [rng.choice(spots) for _ in range(n - len(spots))]
    return [(f"n{i}", min(y, 90.0), (x + 180) % 360 - 180, i % 3) for i, (y, x) in enumerate(spots)]


@pytest.mark.parametrize("lat, lon, deg", [(40.0, -111.0, 0.02), (0.0, 179.99, 0.02), (89.99, 100.0, 0.01), (-84.5, 179.9, 0.05)])
def test_nearest_within_equals_brute_force(spark, lat, lon, deg):
    rng = random.Random(1)
    schema = "id string, lat double, lon double, kind int"
    left = spark.createDataFrame([*crowd(rng, 120, lat, lon, deg), ("none", None, lon, 0)], schema)
    right = spark.createDataFrame([*crowd(rng, 300, lat, lon, deg), ("none", lat, None, 0)], schema)
    for radius, k, by in ((800.0, 3, []), (60.0, 1, []), (500.0, 2, ["kind"])):
        got = {}
        for x in joins.nearest_within(left, right, radius, ["id"], k, by=by).collect():
            got.setdefault(x.id, []).append((x["rank"], round(x.dist_m, 6), x.r_id))
        assert {i: sorted(v) for i, v in got.items()} == brute(left, right, radius, k, bool(by))
    for radius in (20.0, 150.0):
        assert {x.id for x in joins.with_near(left, right, radius).collect()} == set(brute(left, right, radius, 1))


def test_nearest_within_of_nothing(spark):
    some = spark.createDataFrame([("a", 1.0, 2.0)], "id string, lat double, lon double")
    assert joins.nearest_within(some, some.limit(0), 100.0, ["id"]).count() == joins.nearest_within(some.limit(0), some, 100.0, ["id"]).count() == 0
    assert joins.with_near(some, some.limit(0), 100.0).count() == 0 and joins.with_near(some, some, 0.5).count() == 1


@pytest.mark.parametrize("name", ["c06_nearest_three", "c09_area_snap", "c08_near_flag", "c17_relink"])
def test_queries_of_what_is_nearest_make_no_pairs(spark, monkeypatch, name):
    def refuse(*_, **__):
        raise AssertionError("a join of all that is within the radius")

    monkeypatch.setattr(joins, "radius_join", refuse)
    assert catalog.queries()[name](spark, SF).count() > 0
