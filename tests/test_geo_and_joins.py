import math
import random

import pytest

from pyspark.sql import functions as F

from strideframe.functions import geo, text
from strideframe.operators import assignment, joins
from strideframe.sources import files, osm
from strideframe.streaming.machines import metres


def test_distance_and_destination_agree(spark):
    rows = [(40.0, -111.0, float(b), float(d)) for b in range(0, 360, 45) for d in (1, 500, 30_000)] + [(10.0, 179.99, 90.0, 5000.0)]
    df = spark.createDataFrame(rows, "lat double, lon double, b double, d double").withColumn("p", geo.destination("lat", "lon", "b", "d"))
    out = df.select("b", "d", geo.distance_m("lat", "lon", "p.lat", "p.lon").alias("back"), geo.bearing_deg("lat", "lon", "p.lat", "p.lon").alias("bearing"), geo.distance_m("lat", "lon", F.lit(None).cast("double"), "lon").alias("none")).collect()
    for r in out:
        assert abs(r.back - r.d) < 1e-3 and abs((r.bearing - r.b + 180) % 360 - 180) < 1e-3 and r.none is None


def test_point_in_polygon_across_the_date_line(spark):
    ring = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in [(0.0, 179.0), (0.0, -179.0), (2.0, -179.0), (2.0, 179.0)]))
    df = spark.createDataFrame([(1.0, 180.0, True), (1.0, -179.5, True), (1.0, 178.0, False), (3.0, 180.0, False)], "lat double, lon double, want boolean")
    assert all(r.got == r.want for r in df.select("want", geo.point_in_polygon("lat", "lon", ring).alias("got")).collect())


def test_wraps_differ_at_the_seam(spark):
    r = spark.range(1).select(geo.wrap_deg(F.lit(180.0)).alias("a"), geo.wrap_deg_low(F.lit(180.0)).alias("b"), geo.wrap_deg(F.lit(-180.0)).alias("c")).first()
    assert (r.a, r.b, r.c) == (180.0, -180.0, 180.0)


def test_radius_join_equals_brute_force(spark):
    rng = random.Random(3)
    pts = [(i, 40 + rng.random() / 50, -111 + rng.random() / 50) for i in range(300)]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    for r in (30.0, 150.0):
        got = {(x.id, x.r_id) for x in joins.radius_join(df, df, r).collect()}
        assert got == {(a[0], b[0]) for a in pts for b in pts if metres(a[1], a[2], b[1], b[2]) <= r}


def test_segment_join_equals_brute_force(spark):
    rng = random.Random(4)
    at = lambda: (40 + rng.random() / 50, -111 + rng.random() / 50)
    pts = [(i, *at()) for i in range(200)]
    segs = [(i, *at(), *at()) for i in range(40)] + [(40, 40.01, -111.0, 40.01, -110.99), (41, 40.01, -110.99, 40.012, -110.99), (42, 40.01, -110.995, 40.01, -110.995)]
    df, sf = spark.createDataFrame(pts, "id int, lat double, lon double"), spark.createDataFrame(segs, "seg int, a_lat double, a_lon double, b_lat double, b_lon double")
    for r in (25.0, 120.0):
        every = df.crossJoin(sf).where(geo.segment_distance_m("lat", "lon", "a_lat", "a_lon", "b_lat", "b_lon") <= r)
        found = joins.segment_join(df, sf, r).select("id", "seg").collect()
        assert sorted(found) == sorted(every.select("id", "seg").collect()) and len(found) > 100


@pytest.mark.parametrize("lat, lon", [(0.0, 179.995), (71.0, -179.998), (-84.5, 179.99)])
def test_segments_across_longitude_180(spark, lat, lon):
    rng = random.Random(5)
    wrap = lambda x: (x + 180.0) % 360.0 - 180.0
    at = lambda: (lat + rng.random() / 100, wrap(lon + rng.random() / 50))
    pts, segs = [(i, *at()) for i in range(150)], [(i, *at(), *at()) for i in range(30)]
    df, sf = spark.createDataFrame(pts, "id int, lat double, lon double"), spark.createDataFrame(segs, "seg int, a_lat double, a_lon double, b_lat double, b_lon double")
    every = df.crossJoin(sf).where(geo.segment_distance_m("lat", "lon", "a_lat", "a_lon", "b_lat", "b_lon") <= 60.0)
    found = joins.segment_join(df, sf, 60.0).select("id", "seg").collect()
    assert sorted(found) == sorted(every.select("id", "seg").collect()) and len(found) > 20


def test_asof_before_the_first_row(spark):
    left, right = spark.createDataFrame([("a", 1), ("a", 5), ("b", 1)], "k string, t int"), spark.createDataFrame([("a", 3, 7), ("a", 5, 8)], "k string, t int, v int")
    plain = {(r.k, r.t): r.r_v for r in joins.asof_join(left, right, ["k"], "t", ["v"]).collect()}
    first = {(r.k, r.t): r.r_v for r in joins.asof_join(left, right, ["k"], "t", ["v"], first_before=True).collect()}
    assert plain == {("a", 1): None, ("a", 5): 8, ("b", 1): None} and first == {("a", 1): 7, ("a", 5): 8, ("b", 1): None}


def test_polylines_round_trip_and_refuse():
    rng = random.Random(1)
    for factor, places in ((1e5, 5), (1e7, 7)):
        pts = [(round(rng.uniform(-90, 90), places), round(rng.uniform(-180, 180), places)) for _ in range(50)]
        back = files.decode_polyline(files.encode_polyline(pts, factor), factor)
        assert all(math.isclose(a, c, abs_tol=1e-9) and math.isclose(b, d, abs_tol=1e-9) for (a, b), (c, d) in zip(pts, back))
    assert files.encode_polyline([(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert files.decode_polyline("") == [] and files.decode_polyline("_") is None and files.decode_polyline("\x01") is None


def test_map_response(spark):
    body = '{"elements":[{"type":"node","id":1,"lat":1.0,"lon":2.0,"tags":{"name":"n7","layer":3,"x":"y"}},{"type":"way","id":2,"center":{"lat":3,"lon":4}},{"type":"way","id":3,"geometry":[{"lat":0,"lon":0},{"lat":2,"lon":2}]},{"type":"way","id":4}]}'
    got = {r.id: r for r in osm.features(spark.createDataFrame([(body,)], "body string")).collect()}
    assert set(got) == {"n1", "w2", "w3"} and got["n1"].name is None and got["n1"].tags == {"name": "n7", "x": "y"} and (got["w3"].point.lat, got["w3"].point.lon) == (1.0, 1.0)


def test_raw_tracks(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"tag":"rawfix","tf":1,"lat":1.5,"lon":2.5}\n{"tag":"rawfix","tf":2}\nnot json\n{"tag":"rawsteps","te":3,"total":9}\n{"tag":"rawhead","te":4,"az":10.0,"acc":"high"}\n{"tag":"other"}\n')
    got = files.read_tracks(spark, str(p))
    assert {k: v.count() for k, v in got.items()} == {"fixes": 1, "steps": 1, "headings": 1, "skipped": 2} and got["fixes"].first().accuracy_m == 1000.0


def test_apportionment_sums_up(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("b", 1, 7)], "k string, i int, w int")
    got = {(r.k, r.i): r.seats for r in assignment.apportion(rows, "k", "w", "i", 10).collect()}
    assert got == {("a", 1): 4, ("a", 2): 3, ("a", 3): 3, ("b", 1): 10}


def test_sampled_trips_keep_the_rules(spark):
    rng = random.Random(5)
    places = spark.createDataFrame([("g", f"n{i}", 40 + rng.random() / 40, -111 + rng.random() / 40, i % 4) for i in range(200)], "g string, id string, lat double, lon double, score int")
    slots = spark.createDataFrame([("g", i, 1 + i % 3) for i in range(30)], "g string, location_id int, tier int")
    a, b = (assignment.sample_trips(slots, places, ["g"], (40.0, -111.0), 700.0, 50.0, 9).collect() for _ in range(2))
    assert sorted(a) == sorted(b) and len({r.id for r in a}) == len(a)
    at = {r.id: r for r in places.collect()}
    assert all(metres(at[x.id].lat, at[x.id].lon, at[y.id].lat, at[y.id].lon) >= 50 for x in a for y in a if x.id < y.id)
    assert all((r.tier - 1) * 700 < r.distance_m <= r.tier * 700 for r in a if r.in_band)


def test_reachability(spark):
    rows = spark.createDataFrame([("a", i, n) for i, n in enumerate([0, 0, 2, 5])] + [("b", i, n) for i, n in enumerate([0, 1, 2])], "g string, i int, n int")
    assert {r.g: (r.reached, r.beatable) for r in assignment.reachable(rows, ["g"], "i", "n").collect()} == {"a": (3, False), "b": (3, True)}


def test_rough_and_kinds(spark):
    df = spark.createDataFrame([({"highway": "steps"}, True), ({"highway": "path"}, True), ({"highway": "path", "surface": "asphalt"}, False), ({"surface": "paved; mud"}, True), ({}, False)], "tags map<string,string>, want boolean")
    assert all(r.got == r.want for r in df.select("want", text.is_rough(F.col("tags")).alias("got")).collect())
    assert not spark.createDataFrame([({"a": "b"},)], "tags map<string,string>").where(text.matches_kind(F.col("tags"), [])).count()


def test_radius_join_at_poles_and_across_180(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0.0, 60.0, 75.0, 89.0, 89.99, -89.9]) + rng.uniform(-0.01, 0.01), rng.choice([179.995, -179.995, 10.0]) + rng.uniform(-0.005, 0.005)) for i in range(150)]
    df = spark.createDataFrame(rows + [(999, None, None)], "id long, lat double, lon double")
    for r in (300.0, 30_000.0):
        got = {(x.id, x.r_id) for x in joins.radius_join(df, df, r).collect()}
        want = {(a[0], b[0]) for a in rows for b in rows if haversine(a[1:], b[1:]) <= r}
        assert got == want


def haversine(a, b):
    (x, o), (y, p) = (map(math.radians, q) for q in (a, b))
    return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin((p - o) / 2) ** 2)))
