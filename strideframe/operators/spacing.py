"""Points that keep a distance: greedy choices as rounds of joins, whatever the size of a key.

A greedy choice in the order of priorities takes a point unless one taken before is too near. The same set comes from rounds: a
point that comes before all points left around it is taken, and the points around it go. A round compares cells by their first
point alone, so that crowded cells give no pairs; hashed priorities end after about log n rounds.

Keys are columns of both sides; rows without coordinates or id are never taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideframe.functions import geo
from strideframe.operators import joins
from strideframe.operators.graph import _written


def roll(seed: int):
    """A number of 60 bits that follows from a seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("bigint")


def _usable(pool: DataFrame, keys: list[str], seed: int) -> DataFrame:
    return pool.where("id is not null and lat is not null and lon is not null").select(*keys, "id", "lat", "lon", roll(seed).alias("roll")).distinct()


def spaced(pool: DataFrame, keys: list[str], spacing_m: float, seed: int, avoid: DataFrame | None = None) -> DataFrame:
    """(*keys, id, lat, lon, roll): what a greedy choice in the order of (roll, id, lat, lon) takes of each key's points.

    No two of a key are nearer than spacing_m, none is nearer to a point of `avoid` of that key, and every point left out is nearer
    to one of these. Repeated rows count once; an id at two spots is two points. Null keys are a key.
    """
    points = _usable(pool, keys, seed)
    if avoid is not None:
        points = joins.without_near(points, avoid, spacing_m, keys)
    if spacing_m <= 0:
        return points
    left, taken = _written(joins.cell_of(points, spacing_m), "spacing"), []
    point = F.struct("roll", "id", "lat", "lon")
    cell = ["_sf_i", "_sf_j"]
    while not left.isEmpty():
        first = left.groupBy(*keys, *cell).agg(F.min(point).alias("p"))
        around = joins.cells_in_reach(first.select(*keys, F.col("p").alias("own"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon")), spacing_m)
        a, b = around.alias("a"), first.alias("b")
        same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, *cell]])
        best = a.join(b, same).groupBy(*(F.col(f"a.{k}").alias(k) for k in keys), "own").agg(F.min("p").alias("least"))
        won = _written(best.where("own = least").select(*keys, "own.id", "own.lat", "own.lon", "own.roll"), "spacing")
        taken.append(won)
        left = _written(joins.cell_of(joins.without_near(left.drop(*cell), won, spacing_m, keys), spacing_m), "spacing")
    return reduce(DataFrame.unionByName, taken) if taken else points.limit(0)


def top_up(items: DataFrame, pool: DataFrame, keys: list[str], want: int, spacing_m: float, seed: int, avoid: DataFrame | None = None) -> DataFrame:
    """(*keys, no, id, lat, lon, added, full): each key's live items (not picked), and new ones until there are `want`.

    items: (*keys, no, id, lat, lon, picked), a null picked being false. New ones are taken in the order of the seed, spacing_m from live
    items, each other and `avoid`, and are numbered on from the largest number given so far, also to picked ones. A key of the pool
    without items starts at 0. full: whether `want` is reached; a short pool may try again later. None is taken away.
    """
    live = items.where(~F.coalesce("picked", F.lit(False)))
    near = live.select(*keys, "lat", "lon")
    fresh = spaced(pool, keys, spacing_m, seed, near if avoid is None else near.unionByName(avoid.select(*keys, "lat", "lon")))
    state = items.groupBy(*keys).agg(F.count_if(~F.coalesce("picked", F.lit(False))).alias("n_live"), F.max("no").alias("last"))
    order = Window.partitionBy(*keys).orderBy("roll", "id", "lat", "lon")
    ranked = fresh.withColumn("_sf_at", F.row_number().over(order)).where(F.col("_sf_at") <= want)
    same = reduce(lambda x, y: x & y, [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    new = ranked.alias("r").join(state.alias("s"), same, "left").where(F.col("_sf_at") + F.coalesce("n_live", F.lit(0)) <= want)
    new = new.select(*(F.col(f"r.{k}").alias(k) for k in keys), (F.coalesce("last", F.lit(-1)) + F.col("_sf_at")).cast("bigint").alias("no"), "id", "lat", "lon", F.lit(True).alias("added"))
    out = live.select(*keys, F.col("no").cast("bigint").alias("no"), "id", "lat", "lon", F.lit(False).alias("added")).unionByName(new)
    return out.withColumn("full", F.count("*").over(Window.partitionBy(*keys)) >= want)


def place_items(pool: DataFrame, quotas: DataFrame, keys: list[str], home: tuple[float, float], min_m: float, far_m: float, spacing_m: float, seed: int, keep: DataFrame | None = None) -> DataFrame:
    """(*keys, k, id, lat, lon, distance_m): n points for each key of quotas (*keys, n), outward from home.

    The k-th of n lies as near as can be (to a micrometre; ties by the seed, then id) to k/n of the way from min_m to far_m, chosen from the farthest on, spacing_m
    from the others and from `keep`. far_m is at least min_m and twice the spacing; points count from min_m to half as much again
    as far_m. A key that can't have all n has no rows. A round of joins for each k: n is a count of items, not of rows.
    """
    far = max(far_m, min_m + 2 * spacing_m)
    points = _usable(pool, keys, seed).withColumn("distance_m", geo.distance_m(F.lit(home[0]), F.lit(home[1]), "lat", "lon")).where(F.col("distance_m").between(min_m, far * 1.5))
    if keep is not None:
        points = joins.without_near(points, keep, spacing_m, keys)
    quotas = _written(quotas.where("n > 0").select(*keys, F.col("n").cast("bigint").alias("n")), "quotas")
    points = _written(points.join(quotas, keys), "items")
    most = quotas.agg(F.max("n")).first()[0] or 0
    taken = points.select(*keys, F.lit(0).cast("bigint").alias("k"), "id", "lat", "lon", "distance_m").limit(0)
    for k in range(most, 0, -1):
        before = taken.groupBy(*keys).agg(F.collect_list(F.struct("lat", "lon")).alias("taken"))
        near = F.exists("taken", lambda o: geo.distance_m(o["lat"], o["lon"], "lat", "lon") < spacing_m)
        left = points.where(F.col("n") >= k).join(before, keys, "left").where(~F.coalesce(near, F.lit(False)))
        off = F.round(F.abs(F.col("distance_m") - (min_m + (far - min_m) * k / F.col("n"))), 6)
        best = left.groupBy(*keys).agg(F.min(F.struct(off.alias("off"), "roll", "id", "lat", "lon", "distance_m")).alias("b"))
        now = _written(best.select(*keys, F.lit(k).cast("bigint").alias("k"), "b.id", "b.lat", "b.lon", "b.distance_m"), "items")
        taken = taken.unionByName(now)
    whole = taken.groupBy(*keys).agg(F.count("*").alias("n")).join(quotas, [*keys, "n"], "left_semi")
    return taken.join(whole.select(*keys), keys, "left_semi")


def replace_unpicked(items: DataFrame, pool: DataFrame, keys: list[str], home: tuple[float, float], min_m: float, far_m: float, spacing_m: float, seed: int) -> DataFrame:
    """(*keys, no, id, lat, lon, picked, moved): items (*keys, no, id, lat, lon, picked) with those not picked put elsewhere.

    Numbers and picked items stay. The new points follow place_items, apart from picked items, and fill the open numbers nearest to home
    first. A key whose pool can't give all of them keeps its items as they are (moved is false).
    """
    items = items.withColumn("picked", F.coalesce("picked", F.lit(False)))
    fresh = place_items(pool, items.groupBy(*keys).agg(F.count_if(~F.col("picked")).alias("n")), keys, home, min_m, far_m, spacing_m, seed, items.where("picked"))
    fresh = fresh.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("distance_m", "id")).alias("_sf_at"), *(F.col(c).alias(f"_sf_{c}") for c in ("id", "lat", "lon")))
    rank = F.when(~F.col("picked"), F.row_number().over(Window.partitionBy(*keys, "picked").orderBy("no")))
    out = items.withColumn("_sf_at", rank).join(fresh, [*keys, "_sf_at"], "left")
    return out.select(*keys, "no", *(F.coalesce(f"_sf_{c}", c).alias(c) for c in ("id", "lat", "lon")), "picked", F.col("_sf_id").isNotNull().alias("moved"))
