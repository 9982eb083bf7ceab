"""Queries that join by distance, area and time, and the geometry functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideframe.functions import geo
from strideframe.operators import joins as J
from strideframe.operators.segments import nearest_segments
from strideframe.plans.catalog import query
from strideframe.plans.fixtures import SEG, H, ctes, fixes, places, slots, spots, way_points

#: A ring of six corners; one of them is concave.
RING = [(40.010, -110.990), (40.012, -110.960), (40.030, -110.965), (40.024, -110.978), (40.040, -110.985), (40.022, -110.992)]
_EDGES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(RING, RING[-1:] + RING[:-1]))
INSIDE = f"(select count(*) % 2 = 1 from (values {_EDGES}) e(alat, alon, blat, blon) where (alat > {{lat}}) <> (blat > {{lat}}) and {{lon}} < (blon - alon) * ({{lat}} - alat) / (blat - alat) + alon)"


def ring():
    return F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in RING))


def _segments(spark, d):
    """Consecutive points of each way as one row: seg, way_id, ends."""
    w = Window.partitionBy("way_id").orderBy("i")
    s = way_points(spark, d).withColumn("b_lat", F.lead("lat").over(w)).withColumn("b_lon", F.lead("lon").over(w)).where("b_lat is not null")
    return s.select(F.concat_ws(":", "way_id", "i").alias("seg"), "way_id", "i", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), "b_lat", "b_lon")


SEGMENTS = "segments as (select concat(way_id, ':', i) as seg, way_id, i, lat as a_lat, lon as a_lon, b_lat, b_lon from (select *, lead(lat) over (partition by way_id order by i) as b_lat, lead(lon) over (partition by way_id order by i) as b_lon from way_points) where b_lat is not null)"


@query(f"{ctes('places', 'spots')} select p.id, s.id as r_id, round({H('p.lat','p.lon','s.lat','s.lon')}, 4) as dist_m from places p join spots s on abs(p.lat - s.lat) < 0.01 where {H('p.lat','p.lon','s.lat','s.lon')} <= 250")
def c05_radius_join(spark, d):
    return J.radius_join(places(spark, d), spots(spark, d), 250).select("id", "r_id", F.round("dist_m", 4).alias("dist_m"))


@query(f"{ctes('places', 'spots')}, r as (select p.id, s.id as r_id, {H('p.lat','p.lon','s.lat','s.lon')} as dist_m from places p join spots s on abs(p.lat - s.lat) < 0.02), k as (select *, row_number() over (partition by id order by dist_m, r_id) as rank from r where dist_m <= 800) select id, r_id, rank, round(dist_m, 4) as dist_m from k where rank <= 3")
def c06_nearest_three(spark, d):
    near = J.nearest_within(places(spark, d), spots(spark, d), 800, ["id"], 3)
    return near.select("id", "r_id", F.col("rank").cast("bigint").alias("rank"), F.round("dist_m", 4).alias("dist_m"))


@query(f"{ctes('places', 'spots')} select p.id, count(*) as n from places p join spots s on abs(p.lat - s.lat) < 0.02 where {H('p.lat','p.lon','s.lat','s.lon')} between 150 and 600 group by p.id")
def c07_ring_join(spark, d):
    return J.radius_join(places(spark, d), spots(spark, d), 600, min_m=150).groupBy("id").agg(F.count("*").alias("n"))


@query(f"{ctes('places', 'way_points')}, {SEGMENTS}, r as (select p.id, s.seg, {SEG('p.lat','p.lon','s.a_lat','s.a_lon','s.b_lat','s.b_lon')} as dist_m from places p join segments s on p.lat between least(a_lat, b_lat) - 0.001 and greatest(a_lat, b_lat) + 0.001 and p.lon between least(a_lon, b_lon) - 0.002 and greatest(a_lon, b_lon) + 0.002), k as (select *, row_number() over (partition by id order by round(dist_m, 6), seg) as rank from r where dist_m <= 60) select id, seg, rank, round(dist_m, 4) as dist_m from k where rank <= 5")
def c06_nearest_on_segments(spark, d):
    """Up to five segments within 60 m of each place."""
    return nearest_segments(places(spark, d), _segments(spark, d), 60, ["id"], 5, digits=6).select("id", "seg", F.col("rank").cast("bigint").alias("rank"), F.round("dist_m", 4).alias("dist_m"))


@query(f"{ctes('spots', 'places')} select s.id, exists(select 1 from places p where abs(p.lat - s.lat) < 0.01 and {H('p.lat','p.lon','s.lat','s.lon')} <= 300) as near from spots s")
def c08_near_flag(spark, d):
    """Whether any place is within 300 m: a semi-join whose share is the share of samples near a path."""
    near = J.with_near(spots(spark, d), places(spark, d), 300).select("id").distinct().withColumn("near", F.lit(True))
    return spots(spark, d).select("id").join(near, "id", "left").select("id", F.coalesce("near", F.lit(False)).alias("near"))


@query(f"{ctes('spots', 'places')}, r as (select s.id, p.id as r_id, {INSIDE.format(lat='s.lat', lon='s.lon')} as inside, {H('p.lat','p.lon','s.lat','s.lon')} as dist_m from spots s join places p on abs(p.lat - s.lat) < 0.02), k as (select *, row_number() over (partition by id order by case when inside then 0 else 1 end, dist_m, r_id) as n from r where dist_m <= 500) select id, r_id, inside from k where n = 1")
def c09_area_snap(spark, d):
    """Points in the area first, then the nearest."""
    # Inside or not is of the point, the same for all that is near it, so its nearest is its first.
    r = J.nearest_within(spots(spark, d), places(spark, d), 500, ["id"])
    return r.select("id", "r_id", geo.point_in_polygon("lat", "lon", ring()).alias("inside"))


@query(f"{ctes('fixes')} select id from fixes where {INSIDE.format(lat='lat', lon='lon')}")
def c10_point_in_polygon(spark, d):
    areas = spark.range(1).select(F.lit("area").alias("area"), ring().alias("ring"))
    return J.polygon_join(fixes(spark, d).select("id", "lat", "lon"), areas).select("id")


_EV = "a as (select * from fixes where id % 3 = 0), b as (select * from fixes where id % 3 = 1)"


@query(f"{ctes('fixes')}, {_EV} select a.game, a.id, b.id as r_id from a asof left join (select game, t_ms, max(id) as id from b group by game, t_ms) b on a.game = b.game and a.t_ms >= b.t_ms")
def c11_asof_join(spark, d):
    f = fixes(spark, d)
    return J.asof_join(f.where("id % 3 = 0").select("game", "id", "t_ms"), f.where("id % 3 = 1").select("game", "id", "t_ms"), ["game"], "t_ms", ["id"]).select("game", "id", "r_id")


@query(f"{ctes('fixes')}, {_EV}, p as (select a.game, a.id, b.id as r_id, row_number() over (partition by a.game, a.id order by abs(a.t_ms - b.t_ms), b.t_ms, b.id) as n from a join b on a.game = b.game and abs(a.t_ms - b.t_ms) <= 7200000) select game, id, r_id from p where n = 1")
def c12_nearest_in_time(spark, d):
    f = fixes(spark, d)
    return J.nearest_in_time(f.where("id % 3 = 0").select("game", "id", "t_ms"), f.where("id % 3 = 1").select("game", "id", "t_ms"), ["game"], "t_ms", 7_200_000, ["id"]).select("game", "id", "r_id")


_TRACK = "b as (select game, t_ms, min(lat) as lat, min(lon) as lon from fixes where id % 3 = 1 group by game, t_ms)"


@query(f"""{ctes('fixes')}, a as (select game, id, t_ms from fixes where id % 3 = 0), {_TRACK},
p as (select a.*, b.t_ms as pt, b.lat as plat, b.lon as plon from a asof left join b on a.game = b.game and a.t_ms >= b.t_ms),
n as (select p.*, b.t_ms as nt, b.lat as nlat, b.lon as nlon from p asof left join b on p.game = b.game and p.t_ms <= b.t_ms)
select game, id, round(case when pt is null then nlat when nt is null then plat when nt = pt then plat else plat + (nlat - plat) * (t_ms - pt) / (nt - pt) end, 8) as i_lat from n""")
def c13_interpolated(spark, d):
    f = fixes(spark, d)
    track = f.where("id % 3 = 1").groupBy("game", "t_ms").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    return J.interpolated(f.where("id % 3 = 0").select("game", "id", "t_ms"), track, ["game"], "t_ms").select("game", "id", F.round("i_lat", 8).alias("i_lat"))


@query(f"{ctes('fixes')}, w as (select game, id as w_id, t_ms as from_ms, t_ms + 5400000 as to_ms from fixes where id % 50 = 0) select w.w_id, count(*) as n from fixes f join w on f.game = w.game and f.t_ms between w.from_ms and w.to_ms group by w.w_id")
def c14_interval_join(spark, d):
    f = fixes(spark, d)
    w = f.where("id % 50 = 0").select("game", F.col("id").alias("w_id"), F.col("t_ms").alias("from_ms"), (F.col("t_ms") + 5_400_000).alias("to_ms"))
    return J.intervals_join(f.select("game", "t_ms"), w, ["game"], "t_ms", 3_600_000).groupBy("w_id").agg(F.count("*").alias("n"))


@query(f"""{ctes('fixes')}, a as (select game, id, t_ms, lat, lon from fixes where id % 3 = 0), {_TRACK},
p as (select a.*, b.t_ms as pt, b.lat as plat, b.lon as plon from a asof left join b on a.game = b.game and a.t_ms >= b.t_ms),
n as (select p.*, b.t_ms as nt, b.lat as nlat, b.lon as nlon from p asof left join b on p.game = b.game and p.t_ms <= b.t_ms),
e as (select game, {H('lat', 'lon', 'case when nt = pt then plat else plat + (nlat - plat) * (t_ms - pt) / (nt - pt) end', 'case when nt = pt then plon else plon + (nlon - plon) * (t_ms - pt) / (nt - pt) end')} as e from n where pt is not null and nt is not null)
select game, round(sqrt(avg(e * e)), 3) as rms_m, round(quantile_cont(e, 0.95), 3) as p95_m from e group by game""")
def d10_position_error(spark, d):
    """Root mean square and 95th percentile of the distance to a reference track, inside its span."""
    f = fixes(spark, d)
    track = f.where("id % 3 = 1").groupBy("game", "t_ms").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    span = track.groupBy("game").agg(F.min("t_ms").alias("lo"), F.max("t_ms").alias("hi"))
    shown = f.where("id % 3 = 0").join(span, "game").where(F.col("t_ms").between(F.col("lo"), F.col("hi"))).select("game", "id", "t_ms", "lat", "lon")
    e = J.interpolated(shown, track, ["game"], "t_ms").select("game", geo.distance_m("lat", "lon", "i_lat", "i_lon").alias("e"))
    return e.groupBy("game").agg(F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 3).alias("rms_m"), F.round(F.percentile("e", 0.95), 3).alias("p95_m"))


@query(f"{ctes('slots', 'spots')} select s.location_id, p.name from slots s join spots p on s.game = p.k")
def c15_lookup(spark, d):
    return slots(spark, d).join(spots(spark, d).select(F.col("k").alias("game"), "name"), "game").select("location_id", "name")


@query(f"{ctes('slots', 'spots')} select id from spots where k not in (select game from slots where tier = 10)")
def c16_anti_join(spark, d):
    return spots(spark, d).join(slots(spark, d).where("tier = 10").select(F.col("game").alias("k")), "k", "left_anti").select("id")


@query(f"""{ctes('places', 'spots')}, r as (select p.id, s.id as r_id, {H('p.lat','p.lon','s.lat','s.lon')} as dist_m from places p join spots s on p.k % 7 = s.k % 7 and abs(p.lat - s.lat) < 0.01), k as (select *, row_number() over (partition by id order by dist_m, r_id) as n from r where dist_m <= 600) select id, r_id from k where n = 1""")
def c17_relink(spark, d):
    """The nearest of the same kind within 600 m."""
    kind = (F.col("k") % 7).alias("kind")
    return J.nearest_within(places(spark, d).select("*", kind), spots(spark, d).select("*", kind), 600, ["id"], by=["kind"]).select("id", "r_id")


@query(f"{ctes('places')}, t as (select distinct cast(floor(lat/0.02) as int) as row, cast(floor(lon/0.02) as int) as col from places) select row, col, job, n from t cross join (values ('places', 0), ('streets', 1), ('geometry', 2)) j(job, n)")
def c18_tile_jobs(spark, d):
    """Every job of every tile, in order; the jobs are three."""
    t = places(spark, d).select(geo.tile("lat", "lon").alias("t")).select("t.row", "t.col").distinct()
    return t.select("row", "col", F.posexplode(F.array(F.lit("places"), F.lit("streets"), F.lit("geometry"))).alias("n", "job"))


@query(f"{ctes('fixes')} select id, (t_ms + 19999) // 20000 * 20000 as arrival_ms from fixes")
def c21_delivery(spark, d):
    """Arrival in batches: the next multiple of 20 s."""
    return fixes(spark, d).select("id", F.expr("(t_ms + 19999) div 20000 * 20000").alias("arrival_ms"))


@query(f"""{ctes('fixes')}, u as (select id, 0 as rank, (t_ms + 19999) // 20000 * 20000 as arrival, t_ms, game from fixes where id % 2 = 0 union all select id, 2, t_ms, t_ms, game from fixes where id % 2 = 1)
select id, row_number() over (partition by game order by arrival, rank, t_ms, id) as place from u""")
def c20_merged_streams(spark, d):
    """Two streams by arrival, then rank, then event time."""
    f = fixes(spark, d)
    a = f.where("id % 2 = 0").select("id", "game", "t_ms", F.lit(0).alias("rank"), F.expr("(t_ms + 19999) div 20000 * 20000").alias("arrival"))
    b = f.where("id % 2 = 1").select("id", "game", "t_ms", F.lit(2).alias("rank"), F.col("t_ms").alias("arrival"))
    return a.unionByName(b).select("id", F.row_number().over(Window.partitionBy("game").orderBy("arrival", "rank", "t_ms", "id")).cast("bigint").alias("place"))


@query(f"""{ctes('fixes')}, p as (select id, radians(40.0) as p1, radians(lat) as p2, radians(lon + 111.0) as dl, lat, lon from fixes)
select id, round({H('40.0','-111.0','lat','lon')}, 3) as dist_m, round(case when lat = 40.0 and lon = -111.0 then 0.0 else (degrees(atan2(sin(dl)*cos(p2), cos(p1)*sin(p2)-sin(p1)*cos(p2)*cos(dl))) + 360.0) % 360.0 end, 5) as bearing from p""")
def f01_distance_and_bearing(spark, d):
    return fixes(spark, d).select("id", F.round(geo.distance_m(40.0, -111.0, "lat", "lon"), 3).alias("dist_m"), F.round(geo.bearing_deg(40.0, -111.0, "lat", "lon"), 5).alias("bearing"))


@query(f"""{ctes('fixes')}, p as (select id, radians(lat) as a, radians(lon) as o, radians(value) as b, 1500.0/6371000.0 as dd from fixes), q as (select *, asin(sin(a)*cos(dd)+cos(a)*sin(dd)*cos(b)) as a2 from p)
select id, round(degrees(a2), 7) as lat, round(degrees(o + atan2(sin(b)*sin(dd)*cos(a), cos(dd)-sin(a)*sin(a2))), 7) as lon from q""")
def f03_destination(spark, d):
    p = fixes(spark, d).select("id", geo.destination("lat", "lon", "value", 1500.0).alias("p"))
    return p.select("id", F.round("p.lat", 7).alias("lat"), F.round("p.lon", 7).alias("lon"))


@query(f"{ctes('fixes')} select id, round({SEG('lat','lon','40.01','-110.99','40.03','-110.96')}, 4) as dist_m from fixes")
def f04_segment_distance(spark, d):
    return fixes(spark, d).select("id", F.round(geo.segment_distance_m("lat", "lon", 40.01, -110.99, 40.03, -110.96), 4).alias("dist_m"))


@query(f"""{ctes('fixes')}, x as (select id, value * 7 - 900 as a from fixes) select id, round(170.0 + (((a - 170.0 + 180.0) % 360.0) + 360.0) % 360.0 - 180.0, 6) as near_170, round(180.0 - (((180.0 - a) % 360.0) + 360.0) % 360.0, 6) as high, round((((a + 180.0) % 360.0) + 360.0) % 360.0 - 180.0, 6) as low from x""")
def f06_wrapped_angles(spark, d):
    """Longitudes near 170, and both rules of wrapping an angle."""
    a = F.col("value") * 7 - 900
    return fixes(spark, d).select("id", F.round(geo.unwrap_lon(a, 170.0), 6).alias("near_170"), F.round(geo.wrap_deg(a), 6).alias("high"), F.round(geo.wrap_deg_low(a), 6).alias("low"))


@query(f"""{ctes('way_points')}, s as (select way_id, i, lat, lon, {H('lag(lat) over w','lag(lon) over w','lat','lon')} as st from way_points window w as (partition by way_id order by i)) select way_id, round(coalesce(sum(st), 0), 3) as length_m, round(avg(lat), 8) as c_lat, round(avg(lon), 8) as c_lon from s group by way_id""")
def f09_polylines(spark, d):
    """Length and centroid of arrays of points."""
    p = way_points(spark, d).groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "lat", "lon"))), lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("pts"))
    p = p.withColumn("c", geo.centroid(F.col("pts")))
    return p.select("way_id", F.round(geo.polyline_m(F.col("pts")), 3).alias("length_m"), F.round("c.lat", 8).alias("c_lat"), F.round("c.lon", 8).alias("c_lon"))


@query(f"""{ctes('way_points')}, {SEGMENTS}, n as (select *, greatest(cast(ceil({H('a_lat','a_lon','b_lat','b_lon')} / 500.0) as bigint), 1) as n from segments),
x as (select way_id, i, k, a_lat + (b_lat - a_lat) * (k / cast(n as double)) as lat from n, lateral (select unnest(range(0, n)) as k) u)
select way_id, count(*) + 1 as n_points, round(sum(lat), 5) as lat_sum from x group by way_id""")
def f10_densified(spark, d):
    """Points at most 500 m apart."""
    p = way_points(spark, d).groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "lat", "lon"))), lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("pts")).where(F.size("pts") > 1)
    p = p.withColumn("dense", geo.densify(F.col("pts"), 500.0)).withColumn("last", F.element_at("pts", -1)["lat"])
    return p.select("way_id", F.size("dense").cast("bigint").alias("n_points"), F.round(F.aggregate("dense", F.lit(0.0), lambda a, x: a + x["lat"]) - F.col("last"), 5).alias("lat_sum"))


@query(f"{ctes('fixes')} select id, cast(floor(lat/0.02) as int) as row, cast((((floor(lon/0.02) + 9000) % 18000) + 18000) % 18000 - 9000 as int) as col, cast(floor(lat*111195.0/150.0) as bigint) as ci, cast(floor(lon*111195.0*cos(radians(lat))/150.0) as bigint) as cj from fixes")
def f16_tiles_and_cells(spark, d):
    t, c = geo.tile("lat", "lon"), geo.explorer_cell("lat", "lon")
    return fixes(spark, d).select("id", t.alias("t"), c.alias("c")).select("id", "t.row", "t.col", F.col("c.i").alias("ci"), F.col("c.j").alias("cj"))


@query(f"{ctes('fixes')} select id, round((lon + 110.97) * 111195.0 * cos(radians(40.02)), 4) as e, round((lat - 40.02) * 111195.0, 4) as n from fixes")
def f20_local_frame(spark, d):
    return fixes(spark, d).select("id", geo.to_enu("lat", "lon", 40.02, -110.97).alias("p")).select("id", F.round("p.e", 4).alias("e"), F.round("p.n", 4).alias("n"))


@query(f"""{ctes('spots')}, m as (select id, case when k % 3 = 0 then 150.0 else 75.0 end as v, {H('40.02','-110.97','lat','lon')} as dist from spots)
select id, round(dist * 1.3 / v, 5) as minutes, cast(least(greatest(ceil(dist * 1.3 / v / 10.0), 1), 10) as int) as tier, round(10.0 * v / 1.3, 5) as dist_for_10 from m""")
def f23_effort(spark, d):
    """Minutes to a place, its tier of ten minutes, and the distance that ten minutes make."""
    mode = F.when(F.col("k") % 3 == 0, "run").otherwise("walk")
    m = spots(spark, d).select("id", mode.alias("mode"), geo.distance_m(40.02, -110.97, "lat", "lon").alias("dist"))
    minutes = geo.travel_min("dist", "mode")
    return m.select("id", F.round(minutes, 5).alias("minutes"), geo.tier_for(minutes, 10.0).alias("tier"), F.round(geo.dist_for(10.0, "mode"), 5).alias("dist_for_10"))


@query(f"{ctes('spots')} select id, case when {H('40.02','-110.97','lat','lon')} <= 900 then 'circle' when {H('40.02','-110.97','lat','lon')} between 1200 and 1800 then 'annulus' when {INSIDE.format(lat='lat', lon='lon')} then 'polygon' else 'outside' end as zone from spots")
def b07_zones(spark, d):
    """Circle, annulus (both ends count) and polygon zones."""
    dist = geo.distance_m(40.02, -110.97, "lat", "lon")
    return spots(spark, d).select("id", F.when(dist <= 900, "circle").when(dist.between(1200, 1800), "annulus").when(geo.point_in_polygon("lat", "lon", ring()), "polygon").otherwise("outside").alias("zone"))


@query(f"{ctes('way_points')}, {SEGMENTS} select seg from segments where {SEG('40.02','-110.97','a_lat','a_lon','b_lat','b_lon')} <= 500")
def b08_segments_touching(spark, d):
    """Segments that touch a circle."""
    return _segments(spark, d).where(geo.segment_distance_m(F.lit(40.02), F.lit(-110.97), "a_lat", "a_lon", "b_lat", "b_lon") <= 500).select("seg")


@query(f"{ctes('way_points')}, p as (select way_id, bool_or({H('40.02','-110.97','lat','lon')} <= 1000) as inside from way_points group by way_id) select way_id, inside from p")
def b09_ways_in_zone(spark, d):
    """Ways of which any point is in the zone."""
    p = way_points(spark, d).groupBy("way_id").agg(F.collect_list(F.struct("lat", "lon")).alias("pts"))
    return p.select("way_id", F.exists("pts", lambda x: geo.distance_m(40.02, -110.97, x["lat"], x["lon"]) <= 1000).alias("inside"))


@query(f"""{ctes('way_points')}, m as (select *, {H('40.025','-110.975','lat','lon')} <= 2000 as keep from way_points), r as (select *, i - row_number() over (partition by way_id order by i) as run from m where keep) select way_id, min(i) as from_i, count(*) as n from r group by way_id, run""")
def b10_kept_runs(spark, d):
    """Ways cut to a zone: each run of consecutive points inside is a piece."""
    kept = way_points(spark, d).where(geo.distance_m(40.025, -110.975, "lat", "lon") <= 2000)
    return kept.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy("way_id").orderBy("i"))).groupBy("way_id", "run").agg(F.min("i").alias("from_i"), F.count("*").alias("n")).drop("run")


@query(f"{ctes('spots')} select id, k % 11 = 0 as favorite from spots where k % 13 <> 0")
def b11_marks(spark, d):
    """Banned places go, favourites are flagged; a ban wins."""
    s = spots(spark, d)
    banned, favorites = s.where("k % 13 = 0").select("id"), s.where("k % 11 = 0").select("id", F.lit(True).alias("favorite"))
    return s.join(banned, "id", "left_anti").join(favorites, "id", "left").select("id", F.coalesce("favorite", F.lit(False)).alias("favorite"))
