"""Queries over what quests ask for: places settled on paths, areas, lines, and targets without a place."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions import geo
from strideframe.operators import targets
from strideframe.plans.catalog import query
from strideframe.plans.fixtures import SEG, H, ctes, places, slots, spots, way_points
from strideframe.plans.spatial import SEGMENTS, _segments

HOME = (40.02, -110.97)
LEAST_M, D_LAT, D_LON = 300.0, 0.00137, 0.00151
_HOME = ("40.02", "-110.97")
_CORNERS = ((-1, -1), (-1, 1), (1, 1), (1, -1))


def _areas(spark, d):
    """Each place with a box about it; one in four has none."""
    box = F.array(*(F.struct((F.col("lat") + a * D_LAT).alias("lat"), (F.col("lon") + b * D_LON).alias("lon")) for a, b in _CORNERS))
    return places(spark, d).select("id", "k", "lat", "lon", F.when(F.col("k") % 4 != 0, box).alias("ring"))


def _edge(p: str, s: str) -> str:
    """How far a spot is from the nearest edge of a place's box."""
    at = [(f"{p}.lat + {a} * {D_LAT}", f"{p}.lon + {b} * {D_LON}") for a, b in _CORNERS]
    return "least(" + ", ".join(SEG(f"{s}.lat", f"{s}.lon", *at[i], *at[(i + 1) % 4]) for i in range(4)) + ")"


_T = "(case when (dx*dx+dy*dy) = 0 then 0.0 else greatest(0.0, least(1.0, -(ax*dx+ay*dy)/(dx*dx+dy*dy))) end)"
_NEAR = f"""near as (select p.id, p.lat as plat, p.lon as plon, s.*, {SEG('p.lat', 'p.lon', 's.a_lat', 's.a_lon', 's.b_lat', 's.b_lon')} as dist_m from places p join segments s on p.lat between least(a_lat, b_lat) - 0.001 and greatest(a_lat, b_lat) + 0.001 and p.lon between least(a_lon, b_lon) - 0.001 and greatest(a_lon, b_lon) + 0.001),
one as (select *, (a_lon - plon) * 111195.0e0 * cos(radians(plat)) as ax, (a_lat - plat) * 111195.0e0 as ay, (b_lon - a_lon) * 111195.0e0 * cos(radians(plat)) as dx, (b_lat - a_lat) * 111195.0e0 as dy from near where dist_m <= 30 qualify row_number() over (partition by id order by round(dist_m, 6), seg) = 1),
path as (select id, a_lat + (b_lat - a_lat) * {_T} as lat, a_lon + (b_lon - a_lon) * {_T} as lon from one),
sites as (select distinct lat, lon from way_points),
pairs as (select p.id, s.lat, s.lon, round({H('p.lat', 'p.lon', 's.lat', 's.lon')}, 6) as m, abs(s.lat - p.lat) < {D_LAT} and abs(s.lon - p.lon) < {D_LON} as inside, {_edge('p', 's')} <= 30 as beside from places p join sites s on abs(s.lat - p.lat) < 0.0018 and abs(s.lon - p.lon) < 0.002 where p.k % 4 <> 0)"""


@query(f"""{ctes('places', 'way_points')}, {SEGMENTS}, {_NEAR},
c as (select id, lat, lon, -1 as o, 0.0 as m from path union all select id, lat, lon, case when inside then 0 else 1 end, m from pairs where inside or beside)
select id, round(lat, 7) as lat, round(lon, 7) as lon, case o when -1 then 'path' when 0 then 'inside' else 'edge' end as how from c where {H(*_HOME, 'lat', 'lon')} >= {LEAST_M} qualify row_number() over (partition by id order by o, m, lat, lon) = 1""")
def l05_settled(spark, d):
    """Each place's spot on a path, or in or beside its box, at least 300 m from home."""
    s = targets.settle(_areas(spark, d), _segments(spark, d), way_points(spark, d), HOME, LEAST_M)
    return s.select("id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "how")


@query(f"""{ctes('places', 'way_points')}, {SEGMENTS}, {_NEAR},
c as (select distinct p.id, p.lat, p.lon, 1 as o, 0.0 as m from places p join near n on p.id = n.id where n.dist_m <= 30 and p.k % 4 <> 0 union all select id, lat, lon, case when inside then 0 else 2 end, m from pairs where inside or beside)
select id, case o when 0 then 'inside' when 1 then 'middle' else 'edge' end as how, round(lat, 6) as lat from c where {H(*_HOME, 'lat', 'lon')} >= {LEAST_M} qualify row_number() over (partition by id order by o, m, lat, lon) = 1""")
def l05_settled_areas(spark, d):
    """Where each box to spend time in is marked."""
    s = targets.settle_areas(_areas(spark, d).drop("lat", "lon"), _segments(spark, d), way_points(spark, d), HOME, LEAST_M)
    return s.select("id", "how", F.round("lat", 6).alias("lat"))


@query(f"""{ctes('slots')}, q as (select location_id, case when game % 2 = 0 then 'run' else 'walk' end as mode, price % 5000 as out_m, price as len_m, tier * 12e0 as want, ['reach', 'dwell', 'area', 'line'][1 + location_id % 4] as verify, game % 10 = 0 as whole, 0.3e0 + (game % 8) / 10e0 as most from slots),
t as (select *, out_m * 1.3 / case mode when 'run' then 150 else 75 end as way, len_m / case mode when 'run' then 150e0 else 75e0 * 0.8e0 end as full_min, least(greatest(0.25e0, 150 / len_m), most) as lo from q),
r as (select *, least(greatest((want - way) / full_min, lo), most) as raw from t),
f as (select r.*, (select s from (values (0.25e0), (1e0 / 3), (0.5e0), (2e0 / 3), (0.75e0)) v(s) where s >= lo - 1e-9 and s <= most + 1e-9 order by abs(s - raw), s limit 1) as friendly from r),
g as (select *, case when whole or raw >= most - 1e-9 then most else coalesce(friendly, raw) end as share from f)
select location_id, round(case when verify = 'line' then share end, 6) as share, round(case verify when 'line' then way + share * full_min when 'reach' then way else way + 5 end, 6) as effort from g""")
def l03_target_efforts(spark, d):
    """What targets of each type take, and the share of a line that is asked for; prices stand for metres."""
    verify = F.get(F.array(*map(F.lit, ("reach", "dwell", "area", "line"))), (F.col("location_id") % 4).cast("int"))
    q = slots(spark, d).select("location_id", F.when(F.col("game") % 2 == 0, "run").otherwise("walk").alias("mode"), (F.col("price") % 5000).alias("out_m"), "price", (F.col("tier") * 12.0).alias("want"), verify.alias("verify"), (F.col("game") % 10 == 0).alias("whole"), (0.3 + (F.col("game") % 8) / 10.0).alias("most"))
    way, full = geo.travel_min("out_m", "mode"), F.col("price") / F.when(F.col("mode") == "run", geo.M_PER_MIN["run"]).otherwise(geo.M_PER_MIN["walk"] * targets.LINE_PACE)
    q = q.withColumn("share", F.when(F.col("verify") == "line", targets.line_share(F.col("price"), F.col("want"), way, full, F.col("most"), F.col("whole"))))
    effort = F.when(F.col("verify") == "line", way + F.col("share") * full).otherwise(targets.effort_min(F.col("verify"), F.col("out_m"), F.col("mode"), F.lit(5.0)))
    return q.select("location_id", F.round("share", 6).alias("share"), F.round(effort, 6).alias("effort"))


_VERIFY = ("reach", "sector", "dwell", "round_trip", "cells", "steps", "away")


@query(f"""{ctes('slots', 'spots', 'places')}, pool as (select * from spots s where not exists (select 1 from places p where abs(p.lat - s.lat) < 0.001 and {H('p.lat', 'p.lon', 's.lat', 's.lon')} < 40)),
b as (select id, {H(*_HOME, 'lat', 'lon')} as m, radians(lon - ({_HOME[1]})) as dlon, radians(lat) as la, radians({_HOME[0]}e0) as ho from pool),
p as (select id, m, cast(floor(((degrees(atan2(sin(dlon) * cos(la), cos(ho) * sin(la) - sin(ho) * cos(la) * cos(dlon))) + 360) % 360 + 45) / 90) as bigint) % 4 as own from b where m >= {LEAST_M}),
q as (select location_id, {list(_VERIFY)}[1 + location_id % 7] as verify, game % 4 as sector, game % 2 = 0 as runs, tier * 4e0 as want from slots),
w as (select *, cast(round(case verify when 'reach' then want when 'sector' then want when 'dwell' then greatest(want - 5, 1) when 'round_trip' then want / 2 end * case when runs then 150e0 else 75e0 end / 1.3) as bigint) as metre, case when verify = 'sector' then sector else -1 end as sec from q),
k as (select distinct sec, metre from w where metre is not null),
f as (select k.sec, k.metre, p.id, p.m from k join p on k.sec in (-1, p.own) qualify row_number() over (partition by k.sec, k.metre order by abs(cast(round(p.m) as bigint) - k.metre), cast(round(p.m) as bigint), p.id) = 1),
j as (select w.*, f.id as spot, f.m, f.m * 1.3 / case when runs then 150 else 75 end as way, case when runs then 150e0 else 75e0 end * 0.7e0 as pace, case when runs then 150e0 else 100e0 end as cadence from w left join f on w.sec = f.sec and w.metre = f.metre),
n as (select *, case verify when 'cells' then least(greatest(cast(round(want / ({geo.EXPLORER_CELL_M}e0 / pace)) as bigint), 3), 60) when 'steps' then least(greatest(cast(round(want * cadence) as bigint), 500), 40000) end as n from j)
select location_id, verify, spot, n, case when verify = 'away' then least(greatest(want * 3, 30), 480) end as away_min, round(e, 4) as effort from (select *, case verify when 'cells' then n * {geo.EXPLORER_CELL_M}e0 / pace when 'steps' then n / cadence when 'away' then want when 'dwell' then way + 5 when 'round_trip' then way * 2 else way end as e from n) where e is not null""")
def l04_free_targets(spark, d):
    """Targets without a place for each slot, away from the places: spots by their way, cells, steps and minutes."""
    verify = F.get(F.array(*map(F.lit, _VERIFY)), (F.col("location_id") % 7).cast("int"))
    q = slots(spark, d).select("location_id", verify.alias("verify"), (F.col("game") % 4).cast("int").alias("sector"), F.when(F.col("game") % 2 == 0, "run").otherwise("walk").alias("mode"), (F.col("tier") * 4.0).alias("want_min"), F.lit(5.0).alias("minutes"))
    t = targets.free_targets(q, spots(spark, d), HOME, LEAST_M, places(spark, d))
    return t.select("location_id", "verify", "spot", "n", "away_min", F.round("effort", 4).alias("effort"))
