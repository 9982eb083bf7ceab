"""Queries of casts, steps, texts, walks along ways, tile covers and point filters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideframe.functions import geo, links, numbers
from strideframe.operators import sequences as S
from strideframe.operators import assignment as A
from strideframe.operators import clusters
from strideframe.plans.catalog import query
from strideframe.plans.fixtures import H, ctes, fixes, places, slots, spots, table, way_points
from strideframe.plans.spatial import SEGMENTS, _segments

PER_TIER = 10


@query(f"""{ctes('way_points')}, {SEGMENTS}, m as (select *, {H('a_lat','a_lon','b_lat','b_lon')} as m from segments),
c as (select *, coalesce(sum(m) over (partition by way_id order by i rows between unbounded preceding and 1 preceding), 0.0) % 300.0 as carry from m),
n as (select *, case when a0 <= m then cast(floor((m - a0) / 300.0) as bigint) + 1 else 0 end as n from (select *, case when carry = 0 then 0.0 else 300.0 - carry end as a0 from c)),
k as (select *, coalesce(sum(n) over (partition by way_id order by i rows between unbounded preceding and 1 preceding), 0) as k0 from n)
select way_id, cast(k0 + s as bigint) as k, round(a_lat + (b_lat - a_lat) * case when m > 0 then (a0 + s * 300.0) / m else 0 end, 7) as lat, round(a_lon + (b_lon - a_lon) * case when m > 0 then (a0 + s * 300.0) / m else 0 end, 7) as lon from k, lateral (select unnest(range(0, n)) as s) u""")
def f11_fixed_spacing(spark, d):
    """A place every 300 m along each way."""
    p = S.fixed_spacing(_segments(spark, d), "way_id", "i", 300.0)
    return p.select("way_id", F.col("k").cast("bigint").alias("k"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query(f"""{ctes('places')}, z as (select k, lat, lon, 900.0 + k % 5 * 400.0 as r from places),
o as (select k, lat as clat, lon as clon, r, asin(sin(radians(lat))*cos(r/6371000.0)+cos(radians(lat))*sin(r/6371000.0)*cos(radians(i*0.5))) as a2, radians(i*0.5) as b from z, range(0, 720) q(i)),
p as (select k, degrees(a2) as lat, degrees(radians(clon) + atan2(sin(b)*sin(r/6371000.0)*cos(radians(clat)), cos(r/6371000.0)-sin(radians(clat))*sin(a2))) as lon from o),
t as (select distinct k, cast(floor(lat/0.02) as int) as row, cast(floor(lon/0.02) as int) as col from p),
b as (select k, min(row) as r0, max(row) as r1, min(col) as c0, max(col) as c1 from t group by k),
i as (select z.k, cast(row as int) as row, cast(col as int) as col from z join b using (k), lateral (select unnest(range(r0, r1 + 1)) as row) x, lateral (select unnest(range(c0, c1 + 1)) as col) y where {H('lat','lon','(row+0.5)*0.02','(col+0.5)*0.02')} <= r)
select k, row, col from t union select k, row, col from i""")
def f17_tiles_of_zone(spark, d):
    """The tiles that a round zone touches."""
    z = places(spark, d).select("k", F.explode(geo.circle_tiles("lat", "lon", 900.0 + F.col("k") % 5 * 400.0)).alias("t"))
    return z.select("k", "t.row", "t.col")


@query(f"{ctes('fixes')} select id, round(degrees(acos(cos(radians(id % 90)) * cos(radians(id % 45)))), 6) as tilt, greatest(0.5, least(1.1, 0.25 + 0.25 * (id % 9) / 2.0)) as step_m, round((-0.25 * s + sqrt(0.0625 * s * s + s * (accuracy_m / 10))) / (0.5 * s), 6) as cadence from (select *, 0.8 + id % 5 * 0.1 as s from fixes)")
def f22_steps_and_tilt(spark, d):
    i = F.col("id")
    scale = 0.8 + i % 5 * 0.1
    return fixes(spark, d).select(
        "id", F.round(numbers.tilt_deg(i % 90, i % 45), 6).alias("tilt"), numbers.step_length_m((i % 9) / 2.0).alias("step_m"), F.round(numbers.cadence_for(F.col("accuracy_m") / 10, scale), 6).alias("cadence")
    )


@query(f"{ctes('slots')} select location_id, greatest(1, least(10, cast(ceil(price / 3000 / 10) as bigint))) as tier, round(5.0 * tier * 10 / 60.0, 6) as km from slots")
def f24_effort_tiers(spark, d):
    s = slots(spark, d)
    return s.select("location_id", numbers.effort_tier(F.col("price") / 3000, PER_TIER).alias("tier"), F.round(numbers.tier_distance_km(F.col("tier"), PER_TIER, F.lit(5.0)), 6).alias("km"))


_X = "case when l_linenumber = 7 then 'nan'::double else (cast(l_extendedprice as double) - 30000.5) * power(10.0, (l_linenumber - 1) * 3) end"


@query(f"""select l_orderkey, l_linenumber, l_partkey, case when isnan(x) then 0 when x >= 2147483647 then 2147483647 when x <= -2147483648 then -2147483648 else cast(floor(x) as int) end as floor_int,
case when isnan(x) then 0 when x >= 9.223372036854775807e18 then 9223372036854775807 when x <= -9.223372036854775807e18 then -9223372036854775808 when abs(x) >= 9007199254740992 then cast(x as bigint) else cast(sign(x) * floor(abs(x) + 0.5) as bigint) end as round_long from (select *, {_X} as x from lineitem)""")
def f26_saturating_casts(spark, d):
    x = F.when(F.col("l_linenumber") == 7, float("nan")).otherwise((F.col("l_extendedprice").cast("double") - 30000.5) * F.pow(F.lit(10.0), (F.col("l_linenumber") - 1) * 3))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numbers.floor_int(x).alias("floor_int"), numbers.round_long(x).alias("round_long"))


@query(f"{ctes('tags')} select fid, cast(greatest(0.5, 1.0 - 0.05 * (size % 14)) as double) as factor from tags")
def f31_step_factor(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("fid"), F.col("p_size").cast("bigint").alias("size"))
    return t.select("fid", numbers.step_factor((F.col("size") % 14).cast("double")).alias("factor"))


@query("""select c_custkey, case when c_custkey % 5 = 0 then null else case when c_custkey % 3 = 0 then '' else c_custkey % 90 || ' ' end || c_name || case when c_custkey % 4 = 0 then '' else ', ' || c_mktsegment end end as address,
regexp_matches(lower(u), '^https?://') as web, case when c_custkey % 7 = 0 then null when c_custkey % 7 = 1 then null else 'https://de.wikipedia.org/wiki/' || replace(trim(c_mktsegment || ' of ' || c_custkey), ' ', '_') end as wiki,
case when c_custkey % 6 < 3 then 'https://www.openstreetmap.org/' || case c_custkey % 6 when 0 then 'node' when 1 then 'way' else 'relation' end || '/' || c_custkey end as page
from (select *, case c_custkey % 3 when 0 then 'HTTP://x' when 1 then 'https://y' else 'ftp://z' end as u from customer)""")
def k04_links(spark, d):
    """Addresses and links; every few rows lack a part or have one that is not valid."""
    k = F.col("c_custkey")
    text = k.cast("string")
    url = F.when(k % 3 == 0, "HTTP://x").when(k % 3 == 1, "https://y").otherwise("ftp://z")
    tag = F.when(k % 7 == 0, F.col("c_mktsegment")).when(k % 7 == 1, F.concat(F.lit("d:"), F.col("c_mktsegment"))).otherwise(F.concat(F.lit("de: "), F.col("c_mktsegment"), F.lit(" of "), text))
    kind = F.when(k % 6 == 0, "n").when(k % 6 == 1, "w").when(k % 6 == 2, "r").otherwise("t")
    return table(spark, d, "customer").select(
        "c_custkey",
        links.address(F.when(k % 5 != 0, F.col("c_name")), F.when(k % 3 != 0, (k % 90).cast("string")), F.when(k % 4 != 0, F.col("c_mktsegment"))).alias("address"),
        links.is_web(url).alias("web"),
        links.wikipedia_url(tag).alias("wiki"),
        links.feature_url(F.concat(kind, text)).alias("page"),
    )


@query("select o_orderkey, case m // 60 when 0 then m || ' min' else case when m = 60 then '1 hour' when m % 60 = 0 then m // 60 || ' hours' else m // 60 || ' h ' || m % 60 || ' min' end end as lasts, case o_orderkey % 13 when 3 then 'a quarter of' when 4 then 'a third of' when 6 then 'half' when 8 then 'two thirds of' when 9 then 'three quarters of' when 12 then 'the whole' end as share from (select *, cast(o_orderkey % 400 as bigint) as m from orders)")
def k17_phrases(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", numbers.duration_words((k % 400).cast("double")).alias("lasts"), numbers.share_phrase((k % 13) / 12.0).alias("share"))


@query("with l as (select o_custkey as zone, o_orderpriority as kind, min(o_orderkey) as first from orders where o_orderkey % 3 <> 0 group by all), g as (select zone, string_agg(kind, ',' order by first, kind) as kinds from l group by zone) select c_custkey as zone, coalesce(kinds, 'walk,run') as kinds from customer left join g on c_custkey = zone")
def k18_ordered_union(spark, d):
    """The kinds of a zone's lists in the order of their first mention; a zone without any has the game's."""
    lists = table(spark, d, "orders").where("o_orderkey % 3 <> 0").groupBy(F.col("o_custkey").alias("zone"), F.col("o_orderpriority").alias("kind")).agg(F.min("o_orderkey").alias("first"))
    own = lists.groupBy("zone").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "kind"))), lambda x: x["kind"]), ",").alias("kinds"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("zone")).join(own, "zone", "left").select("zone", F.coalesce("kinds", F.lit("walk,run")).alias("kinds"))


@query(f"{ctes('slots', 'fixes')}, a as (select game, location_id, row_number() over (partition by game order by location_id) as n from slots), b as (select game, id, row_number() over (partition by game order by t_ms, id) as n from fixes) select game, n, location_id, id from a join b using (game, n)")
def c19_zipped(spark, d):
    """Slots and fixes of a game put together by their place in order; the shorter list ends it."""
    at = lambda *order: F.row_number().over(Window.partitionBy("game").orderBy(*order)).cast("bigint").alias("n")
    a = slots(spark, d).select("game", "location_id", at("location_id"))
    b = fixes(spark, d).select("game", "id", at("t_ms", "id"))
    return a.join(b, ["game", "n"]).select("game", "n", "location_id", "id")


@query(f"{ctes('spots')} select id from spots order by md5('7:' || id), id limit 300")
def g06_shuffled(spark, d):
    """300 places in an order that a seed fixes: each task keeps its own 300."""
    return spots(spark, d).orderBy(F.md5(F.concat(F.lit("7:"), F.col("id"))), "id").limit(300).select("id")


@query(f"{ctes('way_points')}, {SEGMENTS}, s as (select seg, cast(round(a_lat * 1e7) as bigint) || ':' || cast(round(a_lon * 1e7) as bigint) as a, cast(round(b_lat * 1e7) as bigint) || ':' || cast(round(b_lon * 1e7) as bigint) as b, way_id % 8 as class from segments) select a as node, seg, 1 as direction from s where class & 3 <> 0 union all select b, seg, -1 from s where class & 3 <> 0 and a <> b")
def n04_leaving(spark, d):
    """The segments that leave each node for feet or bikes, with their direction."""
    key = lambda lat, lon: F.concat_ws(":", *(F.round(F.col(c) * 1e7).cast("bigint") for c in (lat, lon)))
    s = _segments(spark, d).where((F.col("way_id") % 8).bitwiseAND(3) != 0).select("seg", key("a_lat", "a_lon").alias("a"), key("b_lat", "b_lon").alias("b"))
    ends = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("direction")))).otherwise(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("direction")), F.struct(F.col("b").alias("node"), F.lit(-1).alias("direction"))))
    return s.select("seg", F.inline(ends)).select("node", "seg", "direction")


_KINDS = "kinds as (select n_nationkey as kind, n_nationkey % 6 as family, n_nationkey % 4 <> 3 as walk, n_nationkey % 4 <> 2 as run, n_nationkey % 5 = 0 as progressive from nation)"


@query(f"{ctes('slots')}, {_KINDS} select location_id, kind from (select *, game % 2 = 0 as by_run, location_id % 97 = 0 as boss, location_id % 6 as fam from slots) s join kinds k on (s.boss or k.family = s.fam) where case when by_run then run else walk end and not progressive")
def b03_offered_kinds(spark, d):
    """Kinds that a slot may have: of its mode and family (a boss slot: of any), none that share a counter."""
    k = F.col("n_nationkey")
    kinds = table(spark, d, "nation").where(k % 5 != 0).select(k.alias("kind"), (k % 6).cast("bigint").alias("family"), F.array_compact(F.array(F.when(k % 4 != 3, "walk"), F.when(k % 4 != 2, "run"))).alias("modes"))
    s = slots(spark, d).select("location_id", F.when(F.col("game") % 2 == 0, "run").otherwise("walk").alias("mode"), F.explode(F.when(F.col("location_id") % 97 == 0, F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).otherwise(F.array(F.col("location_id") % 6))).alias("family"))
    return s.join(F.broadcast(kinds), "family").where(F.array_contains("modes", F.col("mode"))).select("location_id", "kind")


@query(f"{ctes('way_points')}, p as (select distinct lat, lon from way_points where way_id % 9 = 0) select way_id, i from way_points w where not exists (select 1 from p where p.lat = w.lat and p.lon = w.lon)")
def b20_without_parking(spark, d):
    """Points that no parking aisle has."""
    p = way_points(spark, d)
    parking = p.where("way_id % 9 = 0").select("lat", "lon").distinct()
    return p.join(parking, ["lat", "lon"], "left_anti").select("way_id", "i")


@query(f"""{ctes('places', 'spots')}, r as (select p.id, s.id as spot, s.lat, s.lon, {H('p.lat','p.lon','s.lat','s.lon')} as dist_m from places p join spots s on abs(p.lat - s.lat) < 0.01 where {H('p.lat','p.lon','s.lat','s.lon')} <= 200),
w as (select * from r qualify row_number() over (partition by id order by case when dist_m between 60 and 100 then 0 else 1 end, case when dist_m between 60 and 100 then md5('3:' || id || ':' || spot) else '' end, round(abs(dist_m - 80), 6), spot) = 1),
m as (select id, radians(lat) as la, radians(lon) as lo, radians(cast('0x' || substr(md5('3:' || id), 1, 8) as bigint) % 360) as b, 80.0 / 6371000.0 as dd from places), q as (select *, asin(sin(la) * cos(dd) + cos(la) * sin(dd) * cos(b)) as l2 from m)
select id, spot, round(coalesce(w.lat, degrees(l2)), 7) as lat, round(coalesce(w.lon, degrees(lo + atan2(sin(b) * sin(dd) * cos(la), cos(dd) - sin(la) * sin(l2)))), 7) as lon, round(coalesce(dist_m, 80.0), 4) as dist_m from q left join w using (id)""")
def l17_trap_points(spark, d):
    """For each place a spot 60 to 100 m away that a seed picks, else the one nearest to 80 m, else a point made up there."""
    p = A.trap_points(places(spark, d), spots(spark, d), 60, 100, 3)
    return p.select("id", "spot", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.round("dist_m", 4).alias("dist_m"))


@query(f"""{ctes('fixes')}, m as (select game, 1.0 / accuracy_m as w, (lon + 110.97) * 111195.0 * cos(radians(40.02)) as e, (lat - 40.02) * 111195.0 as n from fixes), c as (select game, sum(w * e) / sum(w) as me, sum(w * n) / sum(w) as mn from m group by game)
select game, round(any_value(me), 3) as mean_e, round(any_value(mn), 3) as mean_n, round(sum(w * (e - me) * (e - me)) / sum(w), 2) as cov_ee, round(sum(w * (e - me) * (n - mn)) / sum(w), 2) as cov_en, round(sum(w * (n - mn) * (n - mn)) / sum(w), 2) as cov_nn from m join c using (game) group by game""")
def d24_weighted_moments(spark, d):
    """Weighted mean and covariance of a cloud of points in the local frame: means first, then sums of what is off them."""
    p = fixes(spark, d).select("game", (1.0 / F.col("accuracy_m")).alias("w"), geo.to_enu("lat", "lon", 40.02, -110.97).alias("p")).select("game", "w", F.col("p.e").alias("x"), F.col("p.n").alias("y"))
    s = clusters.weighted_moments(p, "game")
    return s.select("game", F.round("mean_x", 3).alias("mean_e"), F.round("mean_y", 3).alias("mean_n"), F.round("cov_xx", 2).alias("cov_ee"), F.round("cov_xy", 2).alias("cov_en"), F.round("cov_yy", 2).alias("cov_nn"))


@query(f"{ctes('way_points')}, {SEGMENTS} select seg from segments where {H('a_lat','a_lon','b_lat','b_lon')} between 1900.0 and 2100.0")
def e07_straight_links(spark, d):
    """Consecutive points that are a step of 2 km apart, give or take a twentieth."""
    return S.straight_links(_segments(spark, d), 2000.0).select("seg")
