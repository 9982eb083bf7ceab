"""Places settled on paths and in areas, lines that start beside a path, shares of lines."""

from pyspark.sql import functions as F

from strideframe.functions.geo import M_PER_DEG
from strideframe.operators import targets

K = 85_180.0
HOME = (39.0, -111.0)
SEG = "seg string, a_lat double, a_lon double, b_lat double, b_lon double"


def at(e, n):
    return 40 + n / M_PER_DEG, -111 + e / K


def path(spark, *ends):
    return spark.createDataFrame([(f"s{i}", *at(*a), *at(*b)) for i, (a, b) in enumerate(ends)], SEG)


def box(e, n, half):
    return [at(e - half, n - half), at(e - half, n + half), at(e + half, n + half), at(e + half, n - half)]


def test_settled_on_the_path_then_inside_then_at_the_edge(spark):
    paths = path(spark, ((-500, 0), (500, 0)))
    spots = spark.createDataFrame([at(*p) for p in ((0, 1000), (20, 1010), (0, 2125), (0, 2140), (0, 0))] + [(None, None)], "lat double, lon double")
    rows = [("near", *at(100, 20), None), ("inside", *at(0, 1000), box(10, 1000, 60)), ("edge", *at(0, 2000), box(0, 2000, 100)), ("none", *at(0, 3000), box(0, 3000, 10)), ("alone", *at(0, 4000), []), ("nowhere", None, None, None)]
    places = spark.createDataFrame(rows, "id string, lat double, lon double, ring array<struct<lat: double, lon: double>>")
    got = {r.id: r for r in targets.settle(places, paths, spots, HOME).collect()}
    assert {k: r.how for k, r in got.items()} == {"near": "path", "inside": "inside", "edge": "edge"}
    assert abs(got["near"].lat - 40) < 1e-6 and abs(got["near"].lon - at(100, 0)[1]) < 1e-5
    assert (got["inside"].lat, got["inside"].lon) == at(0, 1000) and (got["edge"].lat, got["edge"].lon) == at(0, 2125)
    assert targets.settle(places, paths, spots, (40.0, -111.0), 1500.0).select("id").collect()[0].id == "edge"  # all others are too near home
    assert targets.settle(places.limit(0), paths, spots, HOME).count() == 0


def test_areas_are_marked_inside_in_the_middle_or_at_the_edge(spark):
    paths = path(spark, ((-500, 10), (500, 10)))
    areas = spark.createDataFrame([("in", box(0, 1000, 60)), ("mid", box(0, 0, 20)), ("edge", box(0, 2000, 100)), ("two", box(0, 0, 20)[:2])], "id string, ring array<struct<lat: double, lon: double>>")
    spots = spark.createDataFrame([at(*p) for p in ((5, 1000), (40, 1040), (0, 2120), (0, 30))], "lat double, lon double")
    got = {r.id: (r.how, round(r.lat, 6)) for r in targets.settle_areas(areas, paths, spots, HOME).collect()}
    assert got == {"in": ("inside", round(at(5, 1000)[0], 6)), "mid": ("middle", 40.0), "edge": ("edge", round(at(0, 2120)[0], 6))}


def test_lines_start_beside_a_path(spark):
    paths = path(spark, ((100, -200), (100, 200)))
    lines = spark.createDataFrame(
        [("cut", [at(0, 0), at(300, 0)]), ("back", [at(0, 0), at(150, 0)]), ("loop", [at(0, 0), at(100, 0), at(100, 100), at(0, 100), at(0, 0)]), ("far", [at(0, 900), at(50, 900)]), ("dot", [at(100, 0)]), ("none", None)],
        "id string, pts array<struct<lat: double, lon: double>>",
    )
    got = {r.id: [((p.lon + 111) * K, (p.lat - 40) * M_PER_DEG) for p in r.pts] for r in targets.lines_from_paths(lines, paths).collect()}
    assert set(got) == {"cut", "back", "loop"}
    assert abs(got["cut"][0][0] - 70) < 10 and abs(got["cut"][-1][0] - 300) < 1e-3
    assert abs(got["back"][0][0] - 130) < 10 and abs(got["back"][-1][0]) < 1e-3  # more of it is left from its other end
    assert got["loop"][0] == got["loop"][-1] and abs(got["loop"][0][0] - 70) < 10
    assert {(round(e), round(n)) for e, n in got["loop"]} >= {(0, 0), (100, 0), (100, 100), (0, 100)}  # no corner is lost


def test_shares_of_lines(spark):
    #        length, wanted, way, whole line, most, whole
    rows = [(1000.0, 30.0, 10.0, 40.0, 1.0, False), (1000.0, 100.0, 10.0, 40.0, 0.9, False), (1000.0, 0.0, 10.0, 40.0, 1.0, False), (200.0, 0.0, 10.0, 40.0, 0.8, False), (100.0, 0.0, 1.0, 4.0, 0.7, False), (9000.0, 11.0, 10.0, 400.0, 0.3, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, len double, want double, way double, full double, most double, whole boolean")
    got = [r.s for r in df.select("i", targets.line_share(*(F.col(c) for c in ("len", "want", "way", "full", "most", "whole"))).alias("s")).orderBy("i").collect()]
    assert got == [0.5, 0.9, 0.25, 0.75, 0.7, 0.3]


def test_free_targets_without_spots_or_slots(spark):
    slots = spark.createDataFrame([(1, "reach", 0, "walk", 10.0, None), (2, "steps", 0, "walk", 1.0, None), (3, "away", 0, "run", 500.0, None), (4, "collect", 0, "run", 5.0, None), (5, "sector", 1, "walk", 10.0, None)], "id int, verify string, sector int, mode string, want_min double, minutes double")
    none = spark.createDataFrame([], "id string, lat double, lon double")
    got = {r.id: r for r in targets.free_targets(slots, none, HOME, 100.0).collect()}
    assert set(got) == {2, 3} and got[2].n == 500 and got[2].effort == 5.0 and got[3].away_min == 480.0
    spots = spark.createDataFrame([("west", 39.0, -111.01), ("north", 39.005, -111.0), ("home", 39.0, -111.0), ("lost", None, None)], "id string, lat double, lon double")
    got = {r.id: r.spot for r in targets.free_targets(slots, spots, HOME, 100.0).collect()}
    assert got[1] == "north" and 5 not in got  # nothing lies east
    assert targets.free_targets(slots.limit(0), spots, HOME, 100.0).count() == 0
    assert targets.free_targets(slots.where("id = 1"), spots, HOME, 100.0, spots.where("id = 'north'")).first().spot == "west"
