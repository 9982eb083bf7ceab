"""Queries over the journal: range scans, outings, counts, streaks, counters, windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideframe.functions import geo
from strideframe.operators import sequences as S
from strideframe.plans.catalog import query
from strideframe.plans.fixtures import HOUR_MS, H, ctes, fixes, journal_events, slots

GAP = 6 * HOUR_MS
DAY_MS = 86_400_000
KEYS, ORDER = ["game"], ["t_ms", "id"]


@query(f"""{ctes('journal_events')}, g as (select *, t_ms - lag(t_ms) over (partition by game order by t_ms, id) as gap from journal_events),
s as (select *, sum(case when gap is null or gap > {GAP} then 1 else 0 end) over (partition by game order by t_ms, id rows unbounded preceding) as outing from g)
select game, cast(outing as bigint) as outing, min(t_ms) as started, max(t_ms) as ended, count(*) as n from s group by game, outing""")
def e03_outings(spark, d):
    """Gaps and islands: an outing ends where over six hours pass."""
    rows = S.islands(journal_events(spark, d), KEYS, ORDER, "t_ms", GAP)
    return rows.groupBy("game", F.col("island").alias("outing")).agg(F.min("t_ms").alias("started"), F.max("t_ms").alias("ended"), F.count("*").alias("n"))


@query(f"{ctes('journal_events')} select id, t_ms, kind, detail from journal_events where game = 7 and t_ms between 1704200000000 and 1705500000000")
def a05_range_scan(spark, d):
    """One game's rows between two times; both conditions reach the scan."""
    return journal_events(spark, d).where("game = 7 and t_ms between 1704200000000 and 1705500000000").select("id", "t_ms", "kind", "detail")


@query(f"{ctes('journal_events')} select game, id, row_number() over (order by t_ms, id) as place, t_ms from journal_events where game = 7")
def g01_ordered_scan(spark, d):
    """ORDER BY t_ms, id of one game, as a rank."""
    return journal_events(spark, d).where("game = 7").withColumn("place", F.row_number().over(Window.partitionBy("game").orderBy("t_ms", "id")).cast("bigint")).select("game", "id", "place", "t_ms")


@query(f"{ctes('journal_events')} select id, t_ms, kind from journal_events where game = 3 order by t_ms desc, id desc limit 50")
def g02_newest_first(spark, d):
    return journal_events(spark, d).where("game = 3").orderBy(F.desc("t_ms"), F.desc("id")).limit(50).select("id", "t_ms", "kind")


@query(f"{ctes('journal_events')} select id, game, t_ms, kind from journal_events where game <> 11")
def a08_delete_by_key(spark, d):
    """What is left after a game's rows are deleted (a rewrite of the other partitions)."""
    return journal_events(spark, d).where("game <> 11").select("id", "game", "t_ms", "kind")


@query(f"{ctes('journal_events')} select kind, count(*) as n from journal_events group by kind")
def d01_count_by_kind(spark, d):
    return journal_events(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"{ctes('journal_events')} select game, kind, max(t_ms) as latest from journal_events group by game, kind")
def d02_latest_by_kind(spark, d):
    return journal_events(spark, d).groupBy("game", "kind").agg(F.max("t_ms").alias("latest"))


@query(f"""{ctes('fixes')}, s as (select *, {H('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} as step_m from fixes window w as (partition by game order by t_ms, id))
select game, id, round(step_m, 4) as step_m from s""")
def e01_pairwise_steps(spark, d):
    return S.path_steps(fixes(spark, d), KEYS, ORDER).select("game", "id", F.round("step_m", 4).alias("step_m"))


@query(f"""{ctes('fixes')}, s as (select *, {H('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} as step_m from fixes window w as (partition by game order by t_ms, id))
select game, round(coalesce(sum(step_m), 0), 2) as length_m, count(*) as n from s group by game""")
def e02_path_length(spark, d):
    return S.path_length(fixes(spark, d), KEYS, ORDER).select("game", F.round("length_m", 2).alias("length_m"), "n")


@query(f"""{ctes('slots')}, m as (select *, sum(tier) over (partition by game order by tier, location_id rows unbounded preceding) as upto, row_number() over (partition by game order by tier, location_id) as position from slots)
select game, location_id, cast(upto as bigint) as upto, position from m""")
def e04_milestones(spark, d):
    """Quests of a chain by amount, then id, with the running total at which each is reached."""
    return S.milestones(slots(spark, d), ["game"], ["tier", "location_id"], "tier").select("game", "location_id", F.col("at").cast("bigint").alias("upto"), F.col("position").cast("bigint").alias("position"))


@query(f"""{ctes('slots')}, m as (select *, sum(tier) over w as upto, coalesce(sum(tier) over (partition by game order by tier, location_id rows between unbounded preceding and 1 preceding), 0) as floor_at from slots window w as (partition by game order by tier, location_id rows unbounded preceding))
select game, location_id, upto <= 30 + 1e-9 as reached, round(greatest(0.0, least(1.0, (30 - floor_at) / cast(upto - floor_at as double))), 6) as progress from m""")
def e05_chain_progress(spark, d):
    """With a counter of 30: which milestones are reached, and how far between the last mark and its own each one is."""
    m = S.milestones(slots(spark, d), ["game"], ["tier", "location_id"], "tier")
    before = F.coalesce(F.lag("at").over(Window.partitionBy("game").orderBy("tier", "location_id")), F.lit(0))
    share = (F.lit(30) - before) / (F.col("at") - before).cast("double")
    return m.select("game", "location_id", (F.col("at") <= 30 + 1e-9).alias("reached"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), 6).alias("progress"))


@query(f"""{ctes('journal_events')}, r as (select *, case when kind = lag(kind) over (partition by game order by t_ms, id) then 0 else 1 end as fresh from journal_events),
n as (select *, sum(fresh) over (partition by game order by t_ms, id rows unbounded preceding) as run from r)
select game, cast(run as bigint) as run, max(kind) as kind, count(*) as n, min(t_ms) as from_ms from n group by game, run""")
def e06_runs(spark, d):
    """Run-length groups of equal kinds in order."""
    same = F.col("kind") == F.lag("kind").over(Window.partitionBy("game").orderBy(*ORDER))
    return S.runs(journal_events(spark, d), KEYS, ORDER, same).groupBy("game", "run").agg(F.max("kind").alias("kind"), F.count("*").alias("n"), F.min("t_ms").alias("from_ms"))


@query(f"""{ctes('fixes')}, r as (select *, row_number() over (partition by game order by t_ms, id) - 1 as k from fixes) select game, id from r where k % 5 = 0""")
def e08_stride(spark, d):
    return S.every_nth(fixes(spark, d), KEYS, ORDER, 5).select("game", "id")


@query(f"""{ctes('fixes')}, r as (select *, row_number() over (partition by game order by t_ms, id) - 1 as k, count(*) over (partition by game) as n from fixes)
select game, id from r where k % greatest(n // 12, 1) = 0""")
def e09_even_sample(spark, d):
    return S.even_sample(fixes(spark, d), KEYS, ORDER, 12).select("game", "id")


@query(f"""{ctes('journal_events')}, dd as (select distinct game, t_ms // {DAY_MS} as d from journal_events where t_ms // {DAY_MS} <= 19740),
r as (select *, d - row_number() over (partition by game order by d) as g from dd), l as (select game, g, max(d) as last, count(*) as n from r group by game, g)
select game, cast(coalesce(max(case when last >= 19739 then n end), 0) as bigint) as streak from l group by game""")
def e10_streaks(spark, d):
    """Days in a row up to day 19740, or up to the day before."""
    days = journal_events(spark, d).withColumn("d", F.expr(f"t_ms div {DAY_MS}"))
    return S.streaks(days, KEYS, "d", F.lit(19740).cast("bigint"))


@query(f"""{ctes('fixes')}, s as (select *, value / 100 as speed from fixes), m as (select *, speed < 0.2 as still, lead(t_ms) over w as nxt, case when (speed < 0.2) = (lag(speed) over w < 0.2) then 0 else 1 end as fresh from s window w as (partition by game order by t_ms)),
r as (select *, sum(fresh) over (partition by game order by t_ms rows unbounded preceding) as run from m)
select game, min(t_ms) as from_ms, max(coalesce(nxt, t_ms)) as to_ms from r where still group by game, run having max(coalesce(nxt, t_ms)) - min(t_ms) >= 20000""")
def e11_still_windows(spark, d):
    return S.still_windows(fixes(spark, d).withColumn("speed", F.col("value") / 100), KEYS, "t_ms", "speed")


@query(f"""{ctes('fixes')}, h as (select *, {H('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} as hop, (t_ms - lag(t_ms) over w) / 1000.0 as dt, value / 100 as v from fixes window w as (partition by game order by t_ms, id))
select game, count(*) as jumps from h where v < 2 and hop > greatest(15.0, 3.0 * (v * dt + accuracy_m)) group by game""")
def e12_false_jumps(spark, d):
    """Hops longer than movement and uncertainty explain."""
    w = Window.partitionBy("game").orderBy(*ORDER)
    h = S.path_steps(fixes(spark, d), KEYS, ORDER).withColumn("dt", (F.col("t_ms") - F.lag("t_ms").over(w)) / 1000).withColumn("v", F.col("value") / 100)
    return h.where((F.col("v") < 2) & (F.col("step_m") > F.greatest(F.lit(15.0), 3 * (F.col("v") * F.col("dt") + F.col("accuracy_m"))))).groupBy("game").agg(F.count("*").alias("jumps"))


@query(f"""{ctes('fixes')} select game, min(case when value > 180 and t_ms >= 1705000000000 then t_ms end) - 1705000000000 as lag_ms from fixes group by game""")
def e14_arrival_lag(spark, d):
    """From a moment to the first row that meets a condition."""
    return S.first_after(fixes(spark, d), KEYS, "t_ms", F.lit(1705000000000), F.col("value") > 180)


@query(f"""{ctes('journal_events')} select game, id, count(*) over w as n_day, cast(sum(id % 10) over w as bigint) as gained, min(t_ms) over w as since
from journal_events window w as (partition by game order by t_ms range between {DAY_MS} preceding and current row)""")
def e16_sliding_counts(spark, d):
    rows = S.sliding(journal_events(spark, d), KEYS, "t_ms", DAY_MS, n_day=lambda w: F.count("*").over(w), gained=lambda w: F.sum(F.col("id") % 10).over(w), since=lambda w: F.min("t_ms").over(w))
    return rows.select("game", "id", "n_day", F.col("gained").cast("bigint").alias("gained"), "since")


@query(f"""{ctes('fixes')}, s as (select *, sum(sin(radians(value))) over w as s, sum(cos(radians(value))) over w as c, count(*) over w as n from fixes window w as (partition by game order by t_ms range between {DAY_MS} preceding and current row))
select game, id, n, round(sqrt(s*s + c*c) / n, 6) as resultant from s""")
def e17_compass_window(spark, d):
    """Mean resultant length of the angles of the last day."""
    a = F.radians("value")
    rows = S.sliding(fixes(spark, d), KEYS, "t_ms", DAY_MS, s=lambda w: F.sum(F.sin(a)).over(w), c=lambda w: F.sum(F.cos(a)).over(w), n=lambda w: F.count("*").over(w))
    return rows.select("game", "id", "n", F.round(F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")) / F.col("n"), 6).alias("resultant"))


@query(f"""{ctes('fixes')}, f as (select *, regr_slope(lat, t_ms / 1000.0) over w as slope, count(*) over w as n from fixes window w as (partition by game order by t_ms, id rows 3 preceding))
select game, id, round(slope * 1e9, 3) as slope_nano from f where n = 4""")
def e18_velocity_fit(spark, d):
    """Least squares through the last four fixes."""
    w = Window.partitionBy("game").orderBy(*ORDER).rowsBetween(-3, 0)
    f = fixes(spark, d).withColumn("slope", F.regr_slope("lat", F.col("t_ms") / 1000).over(w)).withColumn("n", F.count("*").over(w))
    return f.where("n = 4").select("game", "id", F.round(F.col("slope") * 1e9, 3).alias("slope_nano"))


@query(f"""{ctes('journal_events')}, c as (select game, id, t_ms, id % 1000 as total from journal_events), p as (select *, lag(total) over (partition by game order by t_ms, id) as before from c)
select game, id, case when before is null then 0 when total >= before then total - before else total end as gained from p""")
def e19_counter_delta(spark, d):
    """Steps gained by a counter that may start over."""
    return S.counter_delta(journal_events(spark, d).withColumn("total", F.col("id") % 1000), KEYS, ORDER, "total").select("game", "id", "gained")


@query(f"""{ctes('fixes')} select game, id, round(max(value) over w, 6) as most, count(*) over w as n from fixes window w as (partition by game order by t_ms, id rows 7 preceding)""")
def e21_last_eight(spark, d):
    w = Window.partitionBy("game").orderBy(*ORDER).rowsBetween(-7, 0)
    return fixes(spark, d).select("game", "id", F.round(F.max("value").over(w), 6).alias("most"), F.count("*").over(w).alias("n"))


@query(f"""{ctes('fixes')}, h as (select *, t_ms - lag(t_ms) over (partition by game order by t_ms, id) as gap, {H('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} as step_m from fixes window w as (partition by game order by t_ms, id))
select game, count(*) as n, count(*) filter (where gap > {GAP}) as gaps, round(coalesce(sum(step_m) filter (where gap <= {GAP}), 0), 2) as walked_m, round(quantile_cont(accuracy_m, 0.5), 6) as accuracy_median,
arg_min(id, t_ms * 1000000 + id) as first_id, arg_max(id, t_ms * 1000000 + id) as last_id from h group by game""")
def d26_outing_report(spark, d):
    """Gaps, distance without the gaps, accuracy, first and last row of each game."""
    w = Window.partitionBy("game").orderBy(*ORDER)
    h = S.path_steps(fixes(spark, d), KEYS, ORDER).withColumn("gap", F.col("t_ms") - F.lag("t_ms").over(w))
    at = F.col("t_ms") * 1000000 + F.col("id")
    return h.groupBy("game").agg(
        F.count("*").alias("n"), F.count_if(F.col("gap") > GAP).alias("gaps"), F.round(F.coalesce(F.sum(F.when(F.col("gap") <= GAP, F.col("step_m"))), F.lit(0.0)), 2).alias("walked_m"), F.round(F.percentile("accuracy_m", 0.5), 6).alias("accuracy_median"), F.min_by("id", at).alias("first_id"), F.max_by("id", at).alias("last_id")
    )


@query(f"""{ctes('journal_events')}, a as (select *, row_number() over (partition by game order by t_ms, id) as n from journal_events where kind = (select min(kind) from journal_events)) select game, id, t_ms from a where n > 3""")
def i21_fresh_items(spark, d):
    """Of a list that is sent again in full, the rows after the three already applied."""
    rows = journal_events(spark, d)
    first = rows.agg(F.min("kind").alias("kind"))
    w = Window.partitionBy("game").orderBy(*ORDER)
    return rows.join(F.broadcast(first), "kind", "left_semi").withColumn("n", F.row_number().over(w)).where("n > 3").select("game", "id", "t_ms")


@query(f"""{ctes('fixes')}, s as (select *, {H('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} as step_m, (t_ms - lag(t_ms) over w) as dt from fixes where accuracy_m <= 35 window w as (partition by game order by t_ms, id))
select game, round(coalesce(sum(case when dt <= {24 * HOUR_MS} and step_m >= 6 then step_m end), 0), 2) as odometer_m from s group by game""")
def i13_odometer(spark, d):
    """Distance over plausible steps of accurate fixes."""
    w = Window.partitionBy("game").orderBy(*ORDER)
    s = S.path_steps(fixes(spark, d).where("accuracy_m <= 35"), KEYS, ORDER).withColumn("dt", F.col("t_ms") - F.lag("t_ms").over(w))
    return s.groupBy("game").agg(F.round(F.coalesce(F.sum(F.when((F.col("dt") <= 24 * HOUR_MS) & (F.col("step_m") >= 6), F.col("step_m"))), F.lit(0.0)), 2).alias("odometer_m"))


@query(f"""{ctes('fixes')} select game, id, case when lat is null or abs(lat) > 90 or abs(lon) > 180 then 'range' when accuracy_m > 30 then 'coarse' when mock then 'mock' else 'usable' end as verdict from fixes""")
def b12_usable_fix(spark, d):
    """The stateless part of a fix's check."""
    v = F.when(F.col("lat").isNull() | (F.abs("lat") > 90) | (F.abs("lon") > 180), "range").when(F.col("accuracy_m") > 30, "coarse").when(F.col("mock"), "mock").otherwise("usable")
    return fixes(spark, d).select("game", "id", v.alias("verdict"))


@query(f"""{ctes('fixes')}, v as (select game, case when accuracy_m > 30 then 'coarse' when mock then 'mock' else 'usable' end as verdict from fixes) select game, verdict, count(*) as n from v group by game, verdict""")
def d09_verdict_counts(spark, d):
    v = F.when(F.col("accuracy_m") > 30, "coarse").when(F.col("mock"), "mock").otherwise("usable")
    return fixes(spark, d).groupBy("game", v.alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""{ctes('fixes')} select game, round(quantile_cont(value, 0.95), 6) as p95, quantile_disc(value, 0.5) as p50_rank, round(sqrt(avg(value * value)), 6) as rms, list_extract(list_sort(list(value)), cast(count(*) // 2 + 1 as bigint)) as p50_index from fixes group by game""")
def d11_percentiles(spark, d):
    """The three percentile rules: between ranks, nearest rank, by index."""
    n = F.count("*")
    return fixes(spark, d).groupBy("game").agg(F.round(F.percentile("value", 0.95), 6).alias("p95"), F.expr("percentile_disc(0.5) within group (order by value)").alias("p50_rank"), F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"), F.get(F.array_sort(F.collect_list("value")), F.floor(n / 2).cast("int")).alias("p50_index"))


@query(f"{ctes('fixes')} select game, round(quantile_cont(lat, 0.5), 9) as lat, round(quantile_cont(lon, 0.5), 9) as lon from fixes group by game")
def d14_median_point(spark, d):
    return fixes(spark, d).groupBy("game").agg(F.round(F.percentile("lat", 0.5), 9).alias("lat"), F.round(F.percentile("lon", 0.5), 9).alias("lon"))


@query(f"""{ctes('fixes')}, s as (select game, sum(sin(radians(value))) as s, sum(cos(radians(value))) as c, count(*) as n from fixes group by game)
select game, round(case when sqrt(s*s+c*c)/n < 1e-9 then null else degrees(atan2(s, c)) end, 4) as mean_deg, round(sqrt(s*s + c*c) / n, 6) as resultant from s""")
def d23_circular_mean(spark, d):
    a = F.radians("value")
    s = fixes(spark, d).groupBy("game").agg(F.sum(F.sin(a)).alias("s"), F.sum(F.cos(a)).alias("c"), F.count("*").alias("n"))
    r = F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")) / F.col("n")
    return s.select("game", F.round(F.when(r >= 1e-9, F.degrees(F.atan2("s", "c"))), 4).alias("mean_deg"), F.round(r, 6).alias("resultant"))


@query(f"""{ctes('fixes')}, k as (select game, id, value, row_number() over (partition by game order by value desc, id) as r from fixes)
select game, list(round(value, 6) order by value desc, id) filter (where r <= 4) as top4, round(avg(value), 6) as mean_value, count(*) filter (where value > 100) as strong from k group by game""")
def d25_signal_summary(spark, d):
    """Mean, four largest and how many are strong."""
    return fixes(spark, d).groupBy("game").agg(F.slice(F.sort_array(F.collect_list(F.round("value", 6)), asc=False), 1, 4).alias("top4"), F.round(F.avg("value"), 6).alias("mean_value"), F.count_if(F.col("value") > 100).alias("strong"))


@query(f"""{ctes('fixes')} select count(*) filter (where accuracy_m <= 20 and not value <= 100) as gained, count(*) filter (where not accuracy_m <= 20 and value <= 100) as lost, count(*) filter (where accuracy_m <= 20 and value <= 100) as both_ from fixes""")
def d20_contingency(spark, d):
    a, b = F.col("accuracy_m") <= 20, F.col("value") <= 100
    return fixes(spark, d).agg(F.count_if(a & ~b).alias("gained"), F.count_if(~a & b).alias("lost"), F.count_if(a & b).alias("both_"))


@query(f"""{ctes('fixes')}, t as (select *, {H('40.02', '-110.98', 'lat', 'lon')} as dist from fixes) select game, min(t_ms) as found_ms from t where dist <= 400 group by game""")
def i18_discovery(spark, d):
    """When each game first came within 400 m of a place."""
    return fixes(spark, d).where(geo.distance_m(40.02, -110.98, "lat", "lon") <= 400).groupBy("game").agg(F.min("t_ms").alias("found_ms"))


@query(f"{ctes('fixes')} select distinct game, cast(floor(lat*111195.0/150.0) as bigint) as i, cast(floor(lon*111195.0*cos(radians(lat))/150.0) as bigint) as j from fixes")
def j06_visited_cells(spark, d):
    c = geo.explorer_cell("lat", "lon")
    return fixes(spark, d).select("game", c.alias("c")).select("game", F.col("c.i").alias("i"), F.col("c.j").alias("j")).distinct()


@query(f"""{ctes('journal_events')}, w as (select game, t_ms // {DAY_MS} as day, count(*) as n from journal_events group by 1, 2) select game, day, n from w""")
def k13_day_buckets(spark, d):
    return journal_events(spark, d).groupBy("game", F.expr(f"t_ms div {DAY_MS}").alias("day")).agg(F.count("*").alias("n"))
