"""Queries without SQL run over whole tables: brute force over all of a small input, no part of it."""

import heapq
import os
from collections import defaultdict

import duckdb
import pytest

from strideframe.operators import graph
from strideframe.operators import tracks as T
from strideframe.plans import catalog
from strideframe.plans.fixtures import SEG, ctes, way_points
from strideframe.plans.spatial import SEGMENTS, _segments

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in ("lineitem", "events", "orders"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def test_geojson_of_every_way(spark, con):
    assert sorted(r.way_id for r in rows(spark, "a16_geojson")) == [x for (x,) in con.execute("select distinct l_orderkey from lineitem order by 1").fetchall()]


def test_turns_of_every_way(spark):
    want = set()
    for way, g in way_points(spark, SF).toPandas().sort_values("i").groupby("way_id"):
        want |= {(way, t) for t, _ in T.turns((g["i"] * 1000).to_numpy(), g["lat"].to_numpy(), g["lon"].to_numpy())}
    assert {(r.way_id, r.t_ms) for r in rows(spark, "e13_turns")} == want


def test_street_routes_from_every_node(spark):
    near = defaultdict(list)
    for r in graph.graph_of(_segments(spark, SF)).collect():
        near[r.a].append((r.b, r.mm))
    want = {}
    for source in near:
        heap = [(0, source)]
        while heap:
            mm, node = heapq.heappop(heap)
            if want.setdefault((source, node), mm) == mm:
                for b, more in near[node]:
                    if mm + more <= 700_000 and mm + more < want.get((source, b), 1 << 60):
                        heapq.heappush(heap, (mm + more, b))
    assert {(r.source, r.node): r.mm for r in rows(spark, "n05_street_routes")} == want


def test_streets_are_matched_among_all(spark, con):
    found = con.execute(f"""{ctes('fixes', 'way_points')}, {SEGMENTS},
    d as (select id, seg, {SEG('lat', 'lon', 'a_lat', 'a_lon', 'b_lat', 'b_lon')} as m from fixes, segments)
    select id, seg, m, nth_value(m, 8) over (partition by id order by m rows between unbounded preceding and unbounded following) as eighth from d where m <= 60""").fetchall()
    # Of equal distances (a shared end) any may be among the eight.
    near = {(i, seg) for i, seg, m, eighth in found if eighth is None or m <= eighth + 1e-6}
    got = [r for r in rows(spark, "i08_street_matches") if r.segment is not None]
    wrong = [r for r in got if (r.id, r.segment) not in near]
    assert got and not wrong, wrong[:3]


def test_every_slot_gets_a_place_and_every_game_is_solved(spark, con):
    slots = {x for (x,) in con.execute("select o_orderkey from orders").fetchall()}
    games = {x for (x,) in con.execute("select distinct o_custkey from orders").fetchall()}
    trips = {r.location_id for r in rows(spark, "l01_sampled_trips")}
    # Places are used once: with few of them the first slots of each part get one.
    assert trips <= slots and any(x % 10 for x in trips)
    assert {r.game for r in rows(spark, "l16_reachable")} == games
