"""Queries of jitter, matching, loose ends, evidence, goals, documents and throttles over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions import documents, geo
from strideframe.operators import measures as M
from strideframe.operators import sequences as S
from strideframe.plans.catalog import query
from strideframe.plans.fixtures import XY, H, ctes, fixes, table, way_points, xy
from strideframe.streaming.fold import fold
from strideframe.streaming.machines import NearMissLog, SavePolicy, Throttle

HOUR_MS = 3_600_000


@query(f"""{ctes('fixes')}, m as (select *, value / 100 < 0.2 as still, lead(t_ms) over (partition by game order by t_ms) as nxt, case when (value / 100 < 0.2) = lag(value / 100 < 0.2) over (partition by game order by t_ms) then 0 else 1 end as fresh from fixes),
r as (select *, sum(fresh) over (partition by game order by t_ms rows unbounded preceding) as run from m),
s as (select game, min(t_ms) as from_ms, max(coalesce(nxt, t_ms)) as to_ms from r where still group by game, run having max(coalesce(nxt, t_ms)) - min(t_ms) >= 20000),
i as (select f.game, from_ms, to_ms, id, t_ms, lat, lon from fixes f join s on f.game = s.game and t_ms between from_ms and to_ms),
p as (select *, {H('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} as step, lag(lat) over w = lat and lag(lon) over w = lon as held from i window w as (partition by game, from_ms order by t_ms, id)),
a as (select *, (to_ms - from_ms) / 60000.0 as mins from (select game, from_ms, to_ms, quantile_cont(lat, 0.5) as ml, quantile_cont(lon, 0.5) as mo, count(*) as n, sum(step) as path, count(*) filter (held) as held, first(lat order by t_ms, id) as al, first(lon order by t_ms, id) as ao, last(lat order by t_ms, id) as bl, last(lon order by t_ms, id) as bo from p group by all) where n > 1),
q as (select game, sum(power({H('lat', 'lon', 'ml', 'mo')}, 2)) as sq from i join a using (game, from_ms) group by game)
select game, round(sqrt(max(sq) / sum(n)), 4) as rms_m, round(sum(path) / sum(mins), 5) as path_m_per_min, round(max({H('al', 'ao', 'bl', 'bo')} / mins), 5) as drift_m_per_min, round(sum(held) / sum(n - 1), 9) as held_share from a join q using (game) group by game""")
def d15_stationary_jitter(spark, d):
    f = fixes(spark, d)
    windows = S.still_windows(f.withColumn("speed", F.col("value") / 100), ["game"], "t_ms", "speed")
    j = M.stationary_jitter(windows, f, "game", "t_ms", "id")
    return j.select("game", F.round("rms_m", 4).alias("rms_m"), F.round("path_m_per_min", 5).alias("path_m_per_min"), F.round("drift_m_per_min", 5).alias("drift_m_per_min"), F.round("held_share", 9).alias("held_share"))


_Y = "sin(radians(lon - est_lon)) * cos(radians(lat))"
_X = "cos(radians(est_lat)) * sin(radians(lat)) - sin(radians(est_lat)) * cos(radians(lat)) * cos(radians(lon - est_lon))"


@query(f"""{ctes('fixes')}, s as (select game, t_ms, id, case when id % 5 = 0 then null else id % 3 end as seg, id % 5 <> 0 as matched, lat as est_lat, lon as est_lon, case when id % 5 = 0 then lat else lat + id % 4 * 0.00002 end as lat, lon from fixes),
o as (select *, {H('est_lat', 'est_lon', 'lat', 'lon')} as m, atan2({_Y}, {_X}) as b from s),
j as (select *, lag(t_ms) over w is not null and lag(seg) over w is distinct from seg as switch, sqrt(power(m * sin(b) - lag(m * sin(b)) over w, 2) + power(m * cos(b) - lag(m * cos(b)) over w, 2)) > 3.0 as jump from o window w as (partition by game order by t_ms, id)),
g as (select game, count(*) as n, count(*) filter (matched) as matched, count(*) filter (switch) as sw, count(*) filter (seg is null) as off_n, count(*) filter (jump) as ju, greatest((max(t_ms) - min(t_ms)) / 60000.0, 1 / 60.0) as mins from j group by game)
select game, round(matched / n, 9) as matched_share, round(sw / mins, 9) as switches_per_min, round(off_n / n, 9) as off_share, round(ju / mins, 9) as pin_jumps_per_min from g""")
def d21_matching_stats(spark, d):
    off = F.col("id") % 5 == 0
    rows = fixes(spark, d).select(
        "game", "t_ms", "id", F.when(~off, F.col("id") % 3).alias("seg"), (~off).alias("matched"), F.col("lat").alias("est_lat"), F.col("lon").alias("est_lon"), F.when(off, F.col("lat")).otherwise(F.col("lat") + F.col("id") % 4 * 0.00002).alias("lat"), "lon"
    )
    s = M.matching_stats(rows, "game", "t_ms", "id")
    return s.select("game", *(F.round(c, 9).alias(c) for c in s.columns[1:]))


@query(f"""with c as (select c_custkey, {XY('c_custkey')} from customer), s as (select o_orderkey, concat('c', c_custkey) as a, c.lat as a_lat, c.lon as a_lon, concat('o', o_orderkey) as b, o.lat as b_lat, o.lon as b_lon, o_orderkey % 2 = 0 as loose from (select o_orderkey, o_custkey, {XY('o_orderkey')} from orders) o join c on c_custkey = o_custkey),
e as (select a as node, a_lat as lat, a_lon as lon, b as other, loose from s union all select b, b_lat, b_lon, a, loose from s),
n as (select node, min(lat) as lat, min(lon) as lon, count(*) as degree, first(other) as other, bool_or(loose) as loose from e group by node),
k as (select l.node, r.node as to_node, {H('l.lat', 'l.lon', 'r.lat', 'r.lon')} as dist_m from n l join n r on r.lat between l.lat - 0.0004 and l.lat + 0.0004 and r.lon between l.lon - 0.0005 and l.lon + 0.0005 where l.degree = 1 and l.loose and r.node <> l.node and r.node <> l.other)
select node, to_node, round(dist_m, 4) as dist_m from (select *, row_number() over (partition by node order by dist_m, to_node) as i from k where dist_m <= 30) where i = 1""")
def n03_loose_ends(spark, d):
    """Links of loose ends to the nearest other node, here within 30 m."""
    c = table(spark, d, "customer").select("c_custkey", *xy("c_custkey")).withColumnsRenamed({"lat": "a_lat", "lon": "a_lon"})
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", *xy("o_orderkey")).withColumnsRenamed({"lat": "b_lat", "lon": "b_lon"})
    s = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.concat(F.lit("c"), "c_custkey").alias("a"), "a_lat", "a_lon", F.concat(F.lit("o"), "o_orderkey").alias("b"), "b_lat", "b_lon", (F.col("o_orderkey") % 2 == 0).alias("loose"))
    return M.loose_ends(s, join_m=30.0).select("node", "to_node", F.round("dist_m", 4).alias("dist_m"))


@query(f"""{ctes('fixes')}, s as (select id, round(lat, 4) as on_lat, round(lon, 4) as on_lon, lat, lon, id % 3 = 0 as walks, id % 4 < 3 as road from fixes),
m as (select *, {H('on_lat', 'on_lon', 'lat', 'lon')} as m, atan2(sin(radians(lon - on_lon)) * cos(radians(lat)), cos(radians(on_lat)) * sin(radians(lat)) - sin(radians(on_lat)) * cos(radians(lat)) * cos(radians(lon - on_lon))) as b from s),
e as (select *, asin(sin(radians(on_lat)) * cos(3.0 / 6371000.0) + cos(radians(on_lat)) * sin(3.0 / 6371000.0) * cos(b)) as el from m)
select id, round(case when not (walks and road) then on_lat when m <= 3.0 then lat else degrees(el) end, 8) as lat, round(case when not (walks and road) then on_lon when m <= 3.0 then lon else degrees(radians(on_lon) + atan2(sin(b) * sin(3.0 / 6371000.0) * cos(radians(on_lat)), cos(3.0 / 6371000.0) - sin(radians(on_lat)) * sin(el))) end, 8) as lon from e""")
def n07_beside(spark, d):
    """Walkers on a road keep their side of it, here at most 3 m away."""
    i = F.col("id")
    at = geo.beside(F.round("lat", 4), F.round("lon", 4), "lat", "lon", i % 3 == 0, i % 4 < 3, 3.0)
    return fixes(spark, d).select("id", at.alias("p")).select("id", F.round("p.lat", 8).alias("lat"), F.round("p.lon", 8).alias("lon"))


@query(f"""{ctes('fixes')}, a as (select game, id, t_ms, case id % 4 when 0 then 'gps' when 1 then 'network' else 'fused' end as source, id % 7 <> 0 as gps_on from fixes where id % 3 <> 0),
b as (select game, t_ms, max(id % 5) as used from fixes where id % 3 = 0 group by game, t_ms)
select a.game, a.id, case when source = 'fused' and (not gps_on or coalesce(a.t_ms - b.t_ms <= 21600000 and used = 0, false)) then 'network' else source end as source from a asof left join b on a.game = b.game and a.t_ms >= b.t_ms""")
def i26_sources(spark, d):
    """Fused fixes without satellites count as network; here a status holds for six hours."""
    f, i = fixes(spark, d), F.col("id")
    named = f.where("id % 3 <> 0").select("game", "id", "t_ms", F.when(i % 4 == 0, "gps").when(i % 4 == 1, "network").otherwise("fused").alias("source"))
    status = f.where("id % 3 = 0").select("game", "t_ms", (i % 5).alias("used"))
    return M.sources_by_evidence(named, status, ["game"], "t_ms", i % 7 != 0, 6 * HOUR_MS).select("game", "id", "source")


@query(f"{ctes('journal_events')}, f as (select game, cast(floor(value) as bigint) % 40 as item, min((t_ms, id)) as first from journal_events where kind = 'purchase' group by all), n as (select game, first, row_number() over (partition by game order by first) as n from f) select game, first[1] as t_ms, first[2] as id from n where n = 5")
def i28_goal_once(spark, d):
    """When each game has five different locations done, told once."""
    from strideframe.plans.fixtures import journal_events

    done = journal_events(spark, d).where("kind = 'purchase'").select("game", "t_ms", "id", (F.floor("value") % 40).alias("item"))
    return M.goals_reached(done, "game", "item", "t_ms", "id", 5)


@query("""with s as (select o_orderkey as k, o_orderkey % 6 as g from orders)
select k as location_id, case when k % 13 = 0 then 'bad document' when k % 11 = 0 then 'unsupported version 4' when k % 7 = 0 then 'no zones' when g = 0 then 'no goal' when g = 3 then 'unknown goal x' when g = 4 then 'goal listed twice: all_trips'
when k % 5 = 0 and not k % 4 between 1 and (case when g = 1 then 1 else 2 end) then 'need out of range: ' || (k % 4) end as error from s""")
def k12_slot_errors(spark, d):
    """A document for each order, some of them not fit to be played, each for a reason of its own."""
    k = F.col("o_orderkey")
    goals = F.element_at(F.array(*(F.lit(g) for g in ("", '"treasure_hunt"', '"treasure_hunt","all_trips"', '"all_trips","x"', '"all_trips","all_trips"', '"treasure_hunt","all_trips"'))), (k % 6 + 1).cast("int"))
    text = F.when(k % 13 == 0, '{"schema_version":').otherwise(
        F.format_string('{"schema_version":%d,"goals":[%s],"goal_requirement":"%s","goal_need":%d,"zones":[%s]}', F.when(k % 11 == 0, 4).otherwise(5), goals, F.when(k % 5 == 0, "at_least").otherwise("all"), k % 4, F.when(k % 7 == 0, "").otherwise('{"name":"a"}'))
    )
    return table(spark, d, "orders").select(k.alias("location_id"), documents.slot_error(text).alias("error"))


@query()
def f08_point_inside(spark, d):
    """A point inside the ring of each way of three points or more."""
    rings = way_points(spark, d).groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("i", "lat", "lon"))).alias("p")).where(F.size("p") > 2)
    return rings.select("way_id", geo.point_inside(F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))).alias("p")).select("way_id", "p.lat", "p.lon")


@query()
def b22_saves(spark, d):
    return fold(fixes(spark, d).withColumn("eventful", F.col("id") % 11 == 0), "game", ["t_ms", "id"], SavePolicy(6 * HOUR_MS))


@query()
def b22_throttled(spark, d):
    return fold(fixes(spark, d), "game", ["t_ms", "id"], Throttle(6 * HOUR_MS))


@query()
def b22_near_misses(spark, d):
    rows = fixes(spark, d).select("game", "t_ms", "id", F.concat(F.lit("n"), F.col("id") % 3).alias("place"), F.when(F.col("accuracy_m") > 35, "accuracy").otherwise("speed").alias("reason"))
    return fold(rows, "game", ["t_ms", "id"], NearMissLog(24 * HOUR_MS))


@query(f"""{ctes('fixes')}, r as (select game, t_ms, id, cast(floor(value) as bigint) as total, accuracy_m < 25 as event from fixes),
o as (select game, t_ms, total, case when event then t_ms end as event_ms from r qualify row_number() over (partition by game, t_ms order by event desc, id) = 1),
p as (select *, coalesce(total < lag(total) over (partition by game order by t_ms), false) as reset from o),
s as (select *, sum(cast(reset as int)) over w as since, max(event_ms) over w as last_event_ms from p window w as (partition by game order by t_ms))
select game, t_ms, count(*) over v as kept, total - first_value(total) over v as steps, last_event_ms from s window v as (partition by game, since order by t_ms range between {48 * HOUR_MS} preceding and current row)""")
def i05_step_history(spark, d):
    """What a step counter's readings of the last two days say, its value standing for the count."""
    rows = fixes(spark, d).select("game", "t_ms", "id", F.floor("value").alias("total"), (F.col("accuracy_m") < 25).alias("event"))
    return M.step_history(rows, "game", 48 * HOUR_MS)
