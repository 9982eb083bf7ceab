"""Queries over quests, goals and generation: states, texts, apportionment, assignment candidates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideframe.functions import geo, text
from strideframe.operators import assignment as A
from strideframe.operators import joins as J
from strideframe.plans.catalog import query
from strideframe.plans.fixtures import H, ctes, fixes, journal_events, places, slots, spots, table

S = ctes("slots")


@query(f"{S} select location_id, tier <= 5 and list_has_all(['key', 'lamp', 'rope'], list_filter(['key', 'lamp', 'sword'], lambda x, i: i <= location_id % 4)) as unlocked from slots")
def b14_unlocked(spark, d):
    """Enough keys, and every needed item held."""
    needs = F.slice(F.array(F.lit("key"), F.lit("lamp"), F.lit("sword")), F.lit(1), (F.col("location_id") % 4).cast("int"))
    held = F.array(F.lit("key"), F.lit("lamp"), F.lit("rope"))
    return slots(spark, d).select("location_id", ((F.col("tier") <= 5) & (F.size(F.array_except(needs, held)) == 0)).alias("unlocked"))


@query(f"{S} select game, case when location_id % 7 = 0 then 'done' when tier > 8 then 'locked' when location_id % 5 = 0 then 'hidden' when location_id % 3 = 0 then 'in progress' else 'open' end as state, count(*) as n from slots group by 1, 2")
def b15_quest_states(spark, d):
    i = F.col("location_id")
    state = F.when(i % 7 == 0, "done").when(F.col("tier") > 8, "locked").when(i % 5 == 0, "hidden").when(i % 3 == 0, "in progress").otherwise("open")
    return slots(spark, d).groupBy("game", state.alias("state")).agg(F.count("*").alias("n"))


@query(f"{ctes('places', 'spots')}, r as (select p.id, s.id as r_id, p.k, {H('p.lat','p.lon','s.lat','s.lon')} as dist_m from places p join spots s on abs(p.lat - s.lat) < 0.01) select id, r_id, case when k % 5 = 0 then 'position estimated' when k % 7 = 0 then 'position uncertain' when k % 3 = 0 then 'zone is locked' when dist_m <= 50 then 'in range: counting' else concat(cast(ceil(round(dist_m, 6) / 5) * 5 as bigint), ' m away') end as reason from r where dist_m <= 90")
def b16_near_misses(spark, d):
    """Why each place nearby counts or doesn't; the first reason wins."""
    r = J.radius_join(places(spark, d), spots(spark, d), 90)
    k = F.col("k")
    away = F.concat((F.ceil(F.round("dist_m", 6) / 5) * 5).cast("bigint").cast("string"), F.lit(" m away"))
    return r.select("id", "r_id", F.when(k % 5 == 0, "position estimated").when(k % 7 == 0, "position uncertain").when(k % 3 == 0, "zone is locked").when(F.col("dist_m") <= 50, "in range: counting").otherwise(away).alias("reason"))


@query(f"{ctes('spots')} select id from spots where k % 13 <> 0 and contains(lower(name), '#0000001')")
def b17_search(spark, d):
    """Without banned places, names that hold a text whatever its case."""
    return spots(spark, d).where((F.col("k") % 13 != 0) & F.lower("name").contains("#0000001")).select("id")


@query(f"{ctes('fixes')} select id, case when accuracy_m > 35 then 'too coarse' when mock then 'from a mock app' when value > 150 then 'a jump' else 'accepted' end as detail, greatest(value - 2 * accuracy_m, 0) * 3.6 <= case when game % 2 = 0 then 25.0 else 12.0 end as speed_ok from fixes")
def b18_fix_details(spark, d):
    """Why a fix was rejected, and whether its speed, two sigmas lower, is within the mode's."""
    detail = F.when(F.col("accuracy_m") > 35, "too coarse").when(F.col("mock"), "from a mock app").when(F.col("value") > 150, "a jump").otherwise("accepted")
    floor = F.greatest(F.col("value") - 2 * F.col("accuracy_m"), F.lit(0.0)) * 3.6
    return fixes(spark, d).select("id", detail.alias("detail"), (floor <= F.when(F.col("game") % 2 == 0, 25.0).otherwise(12.0)).alias("speed_ok"))


@query("""with h as (select o_custkey as game, substr('WALKER', cast(1 + o_orderkey % 6 as int), 1) as letter from orders), n as (select letter, count(*) as need from (select unnest(string_split('WALKER', '')) as letter) group by 1),
c as (select game, letter, count(*) as have from h group by 1, 2) select game, cast(sum(least(have, need)) as bigint) as letters from c join n using (letter) group by game""")
def d16_letters(spark, d):
    """How many letters of a word are held, each as often as the word needs it."""
    need = spark.range(1).select(F.explode(F.split(F.lit("WALKER"), "")).alias("letter")).where("letter <> ''").groupBy("letter").agg(F.count("*").alias("need"))
    have = table(spark, d, "orders").select(F.col("o_custkey").alias("game"), F.substring(F.lit("WALKER"), (F.lit(1) + F.col("o_orderkey") % 6).cast("int"), F.lit(1)).alias("letter")).groupBy("game", "letter").agg(F.count("*").alias("have"))
    return have.join(F.broadcast(need), "letter").groupBy("game").agg(F.sum(F.least("have", "need")).alias("letters"))


@query(f"{S}, p as (select game, location_id, (location_id % 11) / 10.0 as progress, row_number() over (partition by game order by (location_id % 11) desc, location_id) as r from slots) select game, count(*) filter (where progress >= 1) >= 2 as reached, round(avg(progress) filter (where r <= 2), 6) as shown from p group by game")
def d17_goals(spark, d):
    """At least two goals: reached or not, and the mean progress of the best two."""
    p = slots(spark, d).withColumn("progress", (F.col("location_id") % 11) / 10.0)
    best = F.slice(F.sort_array(F.collect_list("progress"), asc=False), 1, 2)
    return p.groupBy("game").agg((F.count_if(F.col("progress") >= 1) >= 2).alias("reached"), best.alias("best")).select("game", "reached", F.round(F.aggregate("best", F.lit(0.0).cast("double"), lambda a, x: a + x) / F.size("best"), 6).alias("shown"))


@query(f"{S} select game, count(*) filter (where location_id % 7 = 0) as done, count(*) as total, count(*) filter (where tier >= 8) as keys_, string_agg(distinct substr('ABCDE', cast(1 + location_id % 5 as int), 1), '' order by substr('ABCDE', cast(1 + location_id % 5 as int), 1)) as letters from slots group by game")
def d18_head_counts(spark, d):
    letter = F.substring(F.lit("ABCDE"), (F.lit(1) + F.col("location_id") % 5).cast("int"), F.lit(1))
    return slots(spark, d).groupBy("game").agg(F.count_if(F.col("location_id") % 7 == 0).alias("done"), F.count("*").alias("total"), F.count_if(F.col("tier") >= 8).alias("keys_"), F.array_join(F.array_sort(F.collect_set(letter)), "").alias("letters"))


@query(f"{S} select game, cast(coalesce(sum(tier) filter (where location_id % 2 = 0), 0) as bigint) as carried from slots group by game")
def d19_carried(spark, d):
    return slots(spark, d).groupBy("game").agg(F.coalesce(F.sum(F.when(F.col("location_id") % 2 == 0, F.col("tier"))), F.lit(0)).cast("bigint").alias("carried"))


@query(f"{S}, r as (select *, row_number() over (partition by game order by tier desc, location_id) as r from slots) select game, location_id, r from r where r <= 4")
def g05_top_four(spark, d):
    w = Window.partitionBy("game").orderBy(F.desc("tier"), "location_id")
    return slots(spark, d).withColumn("r", F.row_number().over(w).cast("bigint")).where("r <= 4").select("game", "location_id", "r")


@query("select p_partkey, list_slice(list_filter([case when p_size % 2 = 0 then p_type end, case when p_size % 3 = 0 then p_brand end, p_name], lambda x: x is not null), 1, 2) as details from part")
def g07_first_details(spark, d):
    """The first two that are there, in a fixed order."""
    v = F.array(F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.slice(F.array_compact(v), 1, 2).alias("details"))


@query(f"{S} select location_id, row_number() over (partition by game order by case when location_id % 29 = 0 then 1 else 0 end, location_id) as place from slots")
def g08_boss_last(spark, d):
    w = Window.partitionBy("game").orderBy(F.when(F.col("location_id") % 29 == 0, 1).otherwise(0), "location_id")
    return slots(spark, d).select("location_id", F.row_number().over(w).cast("bigint").alias("place"))


@query(f"{S} select distinct game from slots where tier = 10 except select distinct game from slots where tier = 8")
def j03_new_zones(spark, d):
    s = slots(spark, d)
    return s.where("tier = 10").select("game").distinct().join(s.where("tier = 8").select("game"), "game", "left_anti")


@query("with w as (select n_nationkey as w, unnest(string_split(n_name, '')) as letter from nation), c as (select w, letter, count(*) as n from w group by all) select letter, max(n) as n from c where letter <> '' group by letter")
def j04_multiset_maximum(spark, d):
    """How often each letter is needed by the word that needs it most."""
    c = table(spark, d, "nation").select("n_nationkey", F.explode(F.split("n_name", "")).alias("letter")).where("letter <> ''").groupBy("n_nationkey", "letter").agg(F.count("*").alias("n"))
    return c.groupBy("letter").agg(F.max("n").alias("n"))


@query(f"{S}, g as (select game, count(*) as n from slots group by game) select game, n // 4 + case when part <= n % 4 then 1 else 0 end as share, part from g, range(1, 5) p(part)")
def l10_even_split(spark, d):
    g = slots(spark, d).groupBy("game").agg(F.count("*").alias("n"))
    return g.select("game", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(4).cast("bigint"))).alias("part")).select("game", (F.expr("n div 4") + F.when(F.col("part") <= F.col("n") % 4, 1).otherwise(0)).alias("share"), "part")


@query(f"{S}, g as (select game, count(*) as n from slots group by game) select game, least(greatest((n * 35 + 50) // 100, 1), greatest(n - 3, 0)) as runs from g")
def l11_run_count(spark, d):
    """35 percent, half up, at least one, and no more than the trips without three."""
    g = slots(spark, d).groupBy("game").agg(F.count("*").alias("n"))
    return g.select("game", F.least(F.greatest(F.expr("(n * 35 + 50) div 100"), F.lit(1)), F.greatest(F.col("n") - 3, F.lit(0))).alias("runs"))


@query(f"{S}, g as (select game, count(*) as n from slots group by game), u as (select game, n, least(greatest(n * 15 // 100, least(5, n)), n) as helpful from g), t as (select *, least(greatest(n * 5 // 100, 3), n - helpful) as traps from u) select game, helpful, traps, n - helpful - traps as filler from t")
def l13_item_plan(spark, d):
    """Useful items, then traps, then filler: shares with a minimum, capped by what is free; they sum to the locations."""
    g = slots(spark, d).groupBy("game").agg(F.count("*").alias("n"))
    u = g.withColumn("helpful", F.least(F.greatest(F.expr("n * 15 div 100"), F.least(F.lit(5), F.col("n"))), F.col("n")))
    t = u.withColumn("traps", F.least(F.greatest(F.expr("n * 5 div 100"), F.lit(3)), F.col("n") - F.col("helpful")))
    return t.select("game", "helpful", "traps", (F.col("n") - F.col("helpful") - F.col("traps")).alias("filler"))


@query(f"{S}, z as (select game, count(distinct tier) as zones, max(tier) as need from slots group by game) select game, min(n) as trips from z, range(1, 61) r(n) where n >= zones and n - n // zones >= need - 1 group by game")
def l14_minimum_trips(spark, d):
    """The smallest number of trips that keeps every zone reachable."""
    z = slots(spark, d).groupBy("game").agg(F.count_distinct("tier").alias("zones"), F.max("tier").alias("need"))
    n = F.filter(F.sequence(F.lit(1).cast("bigint"), F.lit(60).cast("bigint")), lambda i: (i >= F.col("zones")) & (i - F.floor(i / F.col("zones")) >= F.col("need") - 1))
    return z.select("game", F.array_min(n).alias("trips")).where("trips is not null")


@query("select o_orderkey, concat(cast(floor(o_totalprice) as bigint) // 60, ':', lpad(cast(cast(floor(o_totalprice) as bigint) % 60 as varchar), 2, '0')) as clock, concat(upper(substr(replace(replace(lower(o_orderpriority), '-', '_'), '_', ' '), 1, 1)), substr(replace(replace(lower(o_orderpriority), '-', '_'), '_', ' '), 2)) as word, regexp_replace(o_orderpriority, '[^A-Za-z0-9_-]', '', 'g') as safe from orders")
def k02_texts(spark, d):
    """Clock, words from an identifier, an identifier from words."""
    whole = F.floor("o_totalprice").cast("bigint")
    return table(spark, d, "orders").select("o_orderkey", text.clock(whole).alias("clock"), text.humanized(F.replace(F.lower("o_orderpriority"), F.lit("-"), F.lit("_"))).alias("word"), text.safe_id(F.col("o_orderpriority")).alias("safe"))


@query(f"{S} select location_id, concat(case when tier >= 8 then 'Hard' when tier >= 5 then 'Medium' else 'Easy' end, case when location_id % 2 = 0 then ' Walk' else ' Run' end, ' Quest #', 1 + location_id % 1000) as name, 8000000 + tier * 1000 + location_id % 1000 as number from slots")
def k11_names_and_ids(spark, d):
    level = F.when(F.col("tier") >= 8, "Hard").when(F.col("tier") >= 5, "Medium").otherwise("Easy")
    mode = F.when(F.col("location_id") % 2 == 0, " Walk").otherwise(" Run")
    return slots(spark, d).select("location_id", F.concat(level, mode, F.lit(" Quest #"), (1 + F.col("location_id") % 1000).cast("string")).alias("name"), (F.lit(8000000) + F.col("tier") * 1000 + F.col("location_id") % 1000).alias("number"))


@query(f"{ctes('fixes')} select id, ['north','north-east','east','south-east','south','south-west','west','north-west'][cast(floor((value * 2 % 360 + 22.5) / 45) as int) % 8 + 1] as word from fixes")
def k14_compass_words(spark, d):
    return fixes(spark, d).select("id", text.compass_word((F.col("value") * 2) % 360).alias("word"))


@query("select n_nationkey, n_name in ('UNITED STATES', 'UNITED KINGDOM') as imperial, case lower(substr(n_name, 1, 1)) when 'u' then 'high' when 'a' then 'medium' else 'unknown' end as level from nation")
def k15_enums(spark, d):
    c = F.lower(F.substring("n_name", 1, 1))
    return table(spark, d, "nation").select("n_nationkey", F.col("n_name").isin("UNITED STATES", "UNITED KINGDOM").alias("imperial"), F.when(c == "u", "high").when(c == "a", "medium").otherwise("unknown").alias("level"))


@query(f"{ctes('slots', 'spots')}, c as (select s.location_id, s.tier, p.id, {H('40.02','-110.97','p.lat','p.lon')} * 1.3 / 75.0 as minutes from slots s join spots p on s.game % 50 = p.k % 50), k as (select *, abs(minutes - (tier - 0.5) * 8) as score from c), r as (select *, row_number() over (partition by location_id order by round(score, 6), id) as n from k) select location_id, id, n, cast(floor(round(score, 6) * 100) as bigint) as score_cents from r where n <= 4")
def l02_candidates(spark, d):
    """Candidates of each slot by how far their effort is from what is wanted: the four best.

    They depend on the slot's part and tier alone: the best are found once for each of these, and slots look them up.
    """
    s = slots(spark, d).select("location_id", "tier", (F.col("game") % 50).alias("part"))
    p = spots(spark, d).select((F.col("k") % 50).alias("part"), "id", (geo.distance_m(40.02, -110.97, "lat", "lon") * 1.3 / 75.0).alias("minutes"))
    c = s.select("part", "tier").distinct().join(p, "part").withColumn("score", F.round(F.abs(F.col("minutes") - (F.col("tier") - 0.5) * 8), 6))
    w = Window.partitionBy("part", "tier").orderBy("score", "id")
    best = c.withColumn("n", F.row_number().over(w).cast("bigint")).where("n <= 4")
    return s.join(best, ["part", "tier"]).select("location_id", "id", "n", F.floor(F.col("score") * 100).cast("bigint").alias("score_cents"))


@query(f"{ctes('fixes')} select game, id, case when accuracy_m <= 12 then 'here' when accuracy_m <= 25 then 'near' else 'away' end as presence, exp(-0.5 * power(accuracy_m / 10, 2)) > 0.1 as on_road from fixes")
def i25_presence(spark, d):
    """The first rule that holds, and a Gaussian emission."""
    a = F.col("accuracy_m")
    return fixes(spark, d).select("game", "id", F.when(a <= 12, "here").when(a <= 25, "near").otherwise("away").alias("presence"), (F.exp(-0.5 * F.pow(a / 10, 2)) > 0.1).alias("on_road"))


@query(f"{S} select location_id, [0.25, 0.333, 0.5, 0.667, 0.75][list_position(list_transform([0.25, 0.333, 0.5, 0.667, 0.75], lambda f: abs(f - tier / 12.0)), list_min(list_transform([0.25, 0.333, 0.5, 0.667, 0.75], lambda f: abs(f - tier / 12.0))))] as share from slots")
def f25_friendly_share(spark, d):
    """The nearest of five fractions, the smaller of equals."""
    f = F.array(*(F.lit(x) for x in (0.25, 0.333, 0.5, 0.667, 0.75)))
    return slots(spark, d).select("location_id", F.array_min(F.transform(f, lambda x: F.struct(F.abs(x - F.col("tier") / 12.0).alias("gap"), x.alias("f"))))["f"].alias("share"))


# Greedy and seeded: rules instead of equal rows, so no SQL.
@query()
def l01_sampled_trips(spark, d):
    """Places in distance bands, never twice, spaced apart; greedy within each game."""
    s = slots(spark, d).select("game", "location_id", ((F.col("tier") + 1) / 2).cast("int").alias("tier"))
    p = spots(spark, d).select((F.col("k") % 50).alias("part"), "id", "lat", "lon", (F.col("k") % 4).alias("score"))
    return A.sample_trips(s.withColumn("part", F.col("game") % 50), p, ["part"], (40.025, -110.975), step_m=600.0, spacing_m=60.0, seed=5)


@query()
def l16_reachable(spark, d):
    """Fixpoint: locations open as the items found so far allow, until nothing new does."""
    s = slots(spark, d)
    locations = s.select("game", "location_id", ((F.col("tier") - 1) * 2).alias("needs"))
    return A.reachable(locations, ["game"], "location_id", "needs")
