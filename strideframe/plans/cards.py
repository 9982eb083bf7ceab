"""Queries over what players read: distances in their units, names of quests, goals, cards and journal entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions import cards, geo, units
from strideframe.plans.catalog import query
from strideframe.plans.fixtures import XY, H, ctes, slots, spots, xy

HOME = ("40.02", "-110.97")


def _steps(x: str, step: str, how: str = "nearest") -> str:
    q = f"({x}) / {step}"
    return {"nearest": f"cast(floor({q} + 0.5) as bigint)", "down": f"cast(floor({q} + 1e-9) as bigint)", "up": f"cast(ceil({q} - 1e-9) as bigint)"}[how]


def _large(x: str, least: int, unit: str, how: str) -> str:
    t = f"greatest({_steps(x, '0.1e0', how)}, {least})"
    return f"concat(case when {x} >= 10 then cast({_steps(x, '1.0e0', how)} as varchar) when {t} % 10 = 0 then cast({t} // 10 as varchar) else concat({t} // 10, '.', {t} % 10) end, ' {unit}')"


def _distance(m: str, imperial: str, how: str = "nearest") -> str:
    metres = f"(case when {m} < 100 then {_steps(m, '5.0e0', how)} * 5 else {_steps(m, '10.0e0', how)} * 10 end)"
    ft = f"({m}) / 0.3048e0"
    feet = f"({_steps(ft, '10.0e0', how)} * 10)"
    km, mi = f"(({m}) / 1000e0)", f"(({m}) / 1609.344e0)"
    return f"(case when {imperial} then case when {feet} < 528 then concat({feet}, ' ft') else {_large(mi, 1, 'mi', how)} end when {metres} < 1000 then concat({metres}, ' m') else {_large(km, 10, 'km', how)} end)"


@query(f"""{ctes('spots')}, m as (select id, k % 3 = 0 as imp, {H(*HOME, 'lat', 'lon')} * case when k % 5 = 0 then 0.05e0 else 1e0 end as m from spots)
select id, {_distance('m', 'imp')} as txt, {_distance('m', 'imp', 'down')} as within, {_distance('m', 'imp', 'up')} as togo,
case when imp then concat(cast(floor(m / 100 * 1000 / 1609.344e0 + 0.5) as bigint), ' mph') else concat(cast(floor(m / 100 + 0.5) as bigint), ' km/h') end as speed,
case when imp then case when {_steps('m * m / (1609.344e0 * 1609.344e0)', '0.1e0')} = 0 then '<0.1 mi²' else {_large('(m * m / (1609.344e0 * 1609.344e0))', 0, 'mi²', 'nearest')} end
  else case when {_steps('m * m / 1000000e0', '0.1e0')} = 0 then '<0.1 km²' else {_large('(m * m / 1000000e0)', 0, 'km²', 'nearest')} end end as area from m""")
def k01_distance_text(spark, d):
    """Distances from home, speeds and areas in metric or imperial units."""
    m = spots(spark, d).select("id", (F.col("k") % 3 == 0).alias("imp"), (geo.distance_m(*map(float, HOME), "lat", "lon") * F.when(F.col("k") % 5 == 0, 0.05).otherwise(1.0)).alias("m"))
    x, imp = F.col("m"), F.col("imp")
    return m.select("id", units.distance(x, imp).alias("txt"), units.distance(x, imp, "down").alias("within"), units.distance(x, imp, "up").alias("togo"), units.speed(x / 100, imp).alias("speed"), units.area(x * x, imp).alias("area"))


TARGETS = ("point", "dwell", "area", "line", "courier", "round_trip", "cells", "steps", "away", "collect")
KINDS = ("compass_rose", "street_smarts", "bench_warmer", "full_circle", "follow_the_flow", "stairmaster", "peak_bagger")
_IN = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"

_QUESTS = f"""{ctes('slots')}, q as (select location_id as k, game, tier, {_IN(TARGETS)}[1 + cast(floor(price) as bigint) % 10] as target, {_IN(KINDS)}[1 + location_id % 7] as kind, 10e0 + cast(floor(price) as bigint) % 90 as r, price % 300 / 2e0 as minutes,
  1 + location_id % 12 as twelfths, price as len_m, location_id * 10 as n, concat('Quest ', tier) as name, concat('Place ', game) as place, tier = 10 as boss, tier = 1 as fallback, game % 3 = 0 as imp, {XY('game')} from slots),
w as (select *, twelfths / 12e0 as coverage, {H(*HOME, 'lat', 'lon')} as out_m, radians(lon - ({HOME[1]})) as dlon, radians(lat) as la, radians({HOME[0]}e0) as ho from q),
v as (select *, degrees(atan2(sin(dlon) * cos(la), cos(ho) * sin(la) - sin(ho) * cos(la) * cos(dlon))) + 360 as bearing, {_distance('r', 'imp', 'down')} as within, {_distance('len_m', 'imp')} as length, cast(round_even(minutes, 0) as bigint) as whole_min,
  cast(floor(minutes + 0.5) as bigint) as m, case twelfths when 3 then 'a quarter of' when 4 then 'a third of' when 6 then 'half' when 8 then 'two thirds of' when 9 then 'three quarters of' when 12 then 'the whole' end as share, cast(round_even(coverage * 100, 0) as bigint) as percent from w),
g as (select *, case target when 'point' then concat('Get within ', within) when 'dwell' then concat('Stay ', whole_min, ' min within ', within) when 'area' then concat('Spend ', whole_min, ' min inside the area')
  when 'line' then concat('Cover ', percent, '% of this ', length, ' path') when 'courier' then concat('Pick up at A, deliver to B within ', whole_min, ' min') when 'round_trip' then 'Reach the far point, then come back home'
  when 'cells' then concat('Visit ', n, ' new map cells') when 'steps' then concat('Take ', n, ' steps') when 'away' then concat('Spend ', whole_min, ' min away from home') else concat('Bring home ', n, ' pinecones (pick up within ', within, ')') end as goal from v)"""


def _quests(spark, d):
    whole = F.floor("price").cast("bigint")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    q = slots(spark, d).select(
        F.col("location_id").alias("k"), "tier", pick(TARGETS, whole % 10).alias("target"), pick(KINDS, F.col("location_id") % 7).alias("kind"), (10.0 + whole % 90).alias("r"), (F.col("price") % 300 / 2.0).alias("minutes"), ((1 + F.col("location_id") % 12) / 12.0).alias("coverage"),
        F.col("price").alias("len_m"), (F.col("location_id") * 10).alias("n"), F.concat(F.lit("Quest "), "tier").alias("name"), F.concat(F.lit("Place "), "game").alias("place"), (F.col("game") % 3 == 0).alias("imp"), *xy("game"),
    )
    q = q.withColumn("limit_min", F.col("minutes")).withColumn("theme", F.lit("pinecones"))
    return q, {c: F.col(c) for c in q.columns}


@query(f"""{_QUESTS} select k, goal, case when boss then concat('The Big One: ', case when target = 'collect' then concat('bring home ', n, ' pinecones') else name end) when target = 'collect' then concat(name, ': bring home ', n, ' pinecones') else name end as title,
case target when 'point' then case when kind = 'compass_rose' then concat('Head ', ['north', 'north-east', 'east', 'south-east', 'south', 'south-west', 'west', 'north-west'][1 + cast(floor((bearing % 360 + 22.5) / 45) as bigint) % 8]) else 'Get here' end
  when 'dwell' then concat(case when kind = 'bench_warmer' then 'Sit ' else 'Stay ' end, whole_min, ' min') when 'area' then concat('Hang out ', whole_min, ' min')
  when 'line' then case when kind = 'stairmaster' then 'Climb all the stairs' else concat(case when kind = 'follow_the_flow' then 'Follow ' else 'Walk ' end, coalesce(share, concat(percent, '% of')), case when share = 'the whole' then ' ' else ' the ' end, case kind when 'full_circle' then 'loop' when 'follow_the_flow' then 'river' else 'trail' end) end
  when 'courier' then 'Deliver the package' when 'round_trip' then 'Out and back' when 'cells' then 'Explore somewhere new' when 'steps' then concat('Walk ', format('{{:,}}', n), ' steps')
  when 'away' then concat('Be out ', case when m < 60 then concat(m, ' min') when m = 60 then '1 hour' when m % 60 = 0 then concat(m // 60, ' hours') else concat(m // 60, ' h ', m % 60, ' min') end) else concat('Collect ', n, ' pinecones') end as headline,
case target when 'point' then case when kind = 'compass_rose' then concat({_distance('out_m', 'imp')}, ' out, then within ', within) when kind = 'street_smarts' or fallback then concat('Within ', within, ' of the pin') else concat('Within ', within) end
  when 'dwell' then concat('Within ', within, ' · leaving pauses the timer') when 'area' then 'Anywhere inside the outline'
  when 'line' then case when kind = 'stairmaster' then concat('All ', length, ' · up or down') when coverage >= 0.995 then concat('All ', length, ' · either direction') else concat({_distance('(len_m * coverage)', 'imp')}, ' of ', length, ' · either direction') end
  when 'courier' then concat('Pick up at A, drop at B in ', whole_min, ' min') when 'round_trip' then 'Touch the far point, then come home' when 'cells' then 'Walk where you haven''t been yet' when 'steps' then 'Any pace, anywhere' when 'away' then 'Time away from home' else 'Bring them home to bank' end as detail from g""")
def k10_cards(spark, d):
    """Title, goal and card of each slot's quest; prices say what it asks for."""
    q, c = _quests(spark, d)
    home = tuple(map(float, HOME))
    card = cards.card(c, geo.distance_m(*home, "lat", "lon"), geo.bearing_deg(*home, "lat", "lon"), F.col("tier") == 1, F.col("imp"))
    return q.select("k", cards.goal_text(c, F.col("imp")).alias("goal"), cards.title(c, F.col("tier") == 10).alias("title"), card.alias("card")).select("k", "goal", "title", "card.*")


@query(f"""{_QUESTS} select k, case when tier >= 8 then concat(name, ' (', place, '): ', goal) when tier >= 3 then concat('Compass (reward for ', case when tier = 3 then 'a quest' else name end, '): points home') else concat(name, ' sent to the server') end as detail from g""")
def k10_journal_details(spark, d):
    """What the journal says where a slot's quest is done, gives a reward (of an unknown quest at tier 3) or is sent."""
    q, c = _quests(spark, d)
    tier = F.col("tier")
    known = c | {"name": F.when(tier != 3, F.col("name"))}
    event = F.when(tier >= 8, "done").when(tier >= 3, "reward").otherwise("sent")
    return q.select("k", cards.journal_detail(event, known, cards.goal_text(c, F.col("imp")), F.lit("Compass"), F.lit("points home")).alias("detail"))
