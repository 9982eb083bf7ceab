"""Queries over points that keep a distance: items placed, moved and topped up in the parts of a map."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import spacing as S
from strideframe.plans.catalog import query
from strideframe.plans.fixtures import H, ctes, places, spots

PARTS, HOME, NEAR_M, FAR_M, APART_M = 5, (40.025, -110.975), 150.0, 1600.0, 150.0
N, WANT = 8, 40

POOL = f"""{ctes('spots', 'places')}, pool as (select k % {PARTS} as part, id, lat, lon, {H(HOME[0], HOME[1], 'lat', 'lon')} as d from spots),
band as (select * from pool where d between {NEAR_M} and {FAR_M * 1.5})""".replace("with ", "with recursive ", 1)


def _apart(a: str, b: str) -> str:
    return f"{H(f'{a}.lat', f'{a}.lon', f'{b}.lat', f'{b}.lon')} < {APART_M}"


def _rounds(name: str, n: int, seed: int, keep: str | None = None) -> str:
    """SQL of place_items for n points a part, as tables name{n} .. name1, each with the rows of the one before."""
    out = [f"{name}{n + 1} as (select part, 0 as k, id, lat, lon, d from band where false)"]
    for k in range(n, 0, -1):
        taken = f"select part, lat, lon from {name}{k + 1}" + (f" union all select part, lat, lon from {keep}" if keep else "")
        off = f"round(abs(d - ({NEAR_M} + ({FAR_M} - {NEAR_M}) * {k} / {n}.0)), 6)"
        pick = f"select part, {k} as k, id, lat, lon, d from band p where not exists (select 1 from ({taken}) t where t.part = p.part and {_apart('t', 'p')}) qualify row_number() over (partition by part order by {off}, md5(concat('{seed}:', id)), id) = 1"
        out.append(f"{name}{k} as materialized (select * from {name}{k + 1} union all ({pick}))")
    out.append(f"{name} as (select * from {name}1 where part in (select part from {name}1 group by part having count(*) = {n}))")
    return ", ".join(out)


ITEMS = f"{POOL}, {_rounds('placed', N, 3)}, items as (select part, k - 1 as no, id, lat, lon, (k - 1) % 3 = 0 as picked from placed)"
MOVED = N - len(range(0, N, 3))


def _pool(spark, d):
    return spots(spark, d).select((F.col("k") % PARTS).alias("part"), "id", "lat", "lon")


def _placed(spark, d):
    pool = _pool(spark, d)
    quotas = pool.select("part").distinct().withColumn("n", F.lit(N))
    return S.place_items(pool, quotas, ["part"], HOME, NEAR_M, FAR_M, APART_M, seed=3)


def _items(spark, d):
    return _placed(spark, d).select("part", (F.col("k") - 1).alias("no"), "id", "lat", "lon", ((F.col("k") - 1) % 3 == 0).alias("picked"))


@query(f"{ITEMS} select part, k - 1 as place, id, cast(round(d * 100) as bigint) as distance_cm from placed")
def l06_even_spread(spark, d):
    """Eight items a part from home outward, kept apart."""
    return _placed(spark, d).select("part", (F.col("k") - 1).alias("place"), "id", F.round(F.col("distance_m") * 100).cast("bigint").alias("distance_cm"))


@query(f"""{ITEMS}, {_rounds('again', MOVED, 4, '(select * from items where picked)')}, fresh as (select *, row_number() over (partition by part order by d, id) as at from again),
o as (select *, case when not picked then row_number() over (partition by part, picked order by no) end as at from items)
select o.part, o.no, coalesce(f.id, o.id) as id, o.picked, f.id is not null as moved from o left join fresh f on f.part = o.part and f.at = o.at""")
def l07_moved_items(spark, d):
    """Items that were not picked move; numbers and picked ones stay."""
    return S.replace_unpicked(_items(spark, d), _pool(spark, d), ["part"], HOME, NEAR_M, FAR_M, APART_M, seed=4).select("part", "no", "id", "picked", "moved")


@query(f"""{ITEMS}, live as (select * from items where not picked), near as (select part, lat, lon from live union all select k % {PARTS}, lat, lon from places),
free as (select *, row_number() over (partition by part order by md5(concat('5:', id)), id, lat, lon) as i from pool p where not exists (select 1 from near t where t.part = p.part and {_apart('t', 'p')})),
state as (select part, count(*) filter (where not picked) as n_live, max(no) as last from items group by part),
g as (select part, cast(0 as bigint) as i, cast([] as struct(id varchar, lat double, lon double)[]) as t from (select distinct part from pool)
  union all select g.part, f.i, case when len(list_filter(g.t, lambda q: {_apart('q', 'f')})) = 0 then list_append(g.t, {{'id': f.id, 'lat': f.lat, 'lon': f.lon}}) else g.t end
  from g join free f on f.part = g.part and f.i = g.i + 1 left join state s on s.part = g.part where len(g.t) < {WANT} - coalesce(s.n_live, 0)),
whole as (select part, arg_max(t, i) as t from g group by part),
added as (select part, unnest(t).id as id, unnest(range(1, len(t) + 1)) as at from whole),
r as (select part, no, id, false as added from live union all select a.part, coalesce(s.last, -1) + a.at, a.id, true from added a left join state s using (part))
select part, no, id, added, count(*) over (partition by part) >= {WANT} as full from r""")
def l08_topped_up(spark, d):
    """Items topped up to forty a part, apart from live ones, each other and all places of the part."""
    avoid = places(spark, d).select((F.col("k") % PARTS).alias("part"), "lat", "lon")
    return S.top_up(_items(spark, d), _pool(spark, d), ["part"], WANT, APART_M, seed=5, avoid=avoid).select("part", "no", "id", "added", "full")
