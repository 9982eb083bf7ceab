"""What quests ask for at places and without any: spots on paths, areas, lines that start beside a path, and free targets.

Joins are by cells (see joins); what is chosen of the candidates is a minimum, partial before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions import geo
from strideframe.operators import joins
from strideframe.operators.graph import _written
from strideframe.operators.segments import nearest_segments

#: What is near a path, how far quests keep apart, the least share of a line and its least length, a line's pace.
NEAR_PATH_M, SPACING_M, LEAST_SHARE, LEAST_LINE_M, LINE_PACE = 30.0, 40.0, 0.25, 150.0, 0.8
FRIENDLY_SHARES = (1 / 4, 1 / 3, 1 / 2, 2 / 3, 3 / 4)
#: Fixed values of targets without a place: cells, steps and minutes away from home, each from .. to.
CELLS, STEPS, AWAY_MIN, CELL_PACE = (3, 60), (500, 40_000), (30.0, 480.0), 0.7


def _far(lat, lon, home: tuple[float, float], least_m: float) -> Column:
    return geo.distance_m(home[0], home[1], lat, lon) >= least_m


def _edges(areas: DataFrame, id: str) -> DataFrame:
    edge = lambda p, i: F.struct(p["lat"].alias("a_lat"), p["lon"].alias("a_lon"), F.get("ring", (i + 1) % F.size("ring"))["lat"].alias("b_lat"), F.get("ring", (i + 1) % F.size("ring"))["lon"].alias("b_lon"))
    return areas.select(F.col(id).alias("seg"), F.explode(F.transform("ring", edge)).alias("e")).select("seg", "e.*")


#: Spots that are looked at for each area before all that are inside it, and how far.
FIRST_SPOTS, FIRST_M = 8, 250.0


def _inside(areas: DataFrame, at: DataFrame, id: str, home: tuple[float, float], least_m: float) -> DataFrame:
    """(id, lat, lon, m): the spot inside the ring of each area (id, lat, lon, ring) that is nearest to lat and lon.

    Mostly one of the first few near there, and then no other can be nearer; where none of these fits all spots inside count.
    """
    fits = geo.point_in_polygon("r_lat", "r_lon", F.col("ring")) & _far("r_lat", "r_lon", home, least_m)
    m = F.round(geo.distance_m("lat", "lon", "r_lat", "r_lon"), 6)
    first = joins.nearest_within(areas.select(id, "lat", "lon", "ring"), at, FIRST_M, [id], FIRST_SPOTS, "lat").select(id, m.alias("m"), fits.alias("fits"), F.col("r_lat").alias("lat"), F.col("r_lon").alias("lon"))
    first = first.groupBy(id).agg(F.min(F.when(F.col("fits"), F.struct("m", "lat", "lon"))).alias("p"), F.max("m").alias("last"), F.count("*").alias("n"))
    # One that was not looked at may be as near, in six digits, as the last of the first.
    sure = F.col("p.m") < F.when(F.col("n") < FIRST_SPOTS, FIRST_M - 1e-3).otherwise(F.col("last"))
    first = _written(first.where(sure).select(id, "p.lat", "p.lon", "p.m"), "inside-first")
    rest = areas.join(first, id, "left_anti").select(F.col(id).alias("_sf_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "ring")
    every = joins.polygon_join(at, rest).where(_far("lat", "lon", home, least_m)).withColumn("m", F.round(geo.distance_m("p_lat", "p_lon", "lat", "lon"), 6))
    every = every.groupBy(F.col("_sf_id").alias(id)).agg(F.min(F.struct("m", "lat", "lon")).alias("p")).select(id, "p.lat", "p.lon", "p.m")
    return first.unionByName(every)


def _beside(areas: DataFrame, at: DataFrame, id: str, edge_m: float, home: tuple[float, float], least_m: float) -> DataFrame:
    """(id, lat, lon, m): the spot at most edge_m from the edges of each area (id, lat, lon, ring) that is nearest to lat and lon."""
    found = joins.segment_join(at, _edges(areas, id), edge_m).where(_far("lat", "lon", home, least_m)).select(F.col("seg").alias(id), "lat", "lon")
    found = found.join(areas.select(id, F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), id)
    return found.select(id, "lat", "lon", F.round(geo.distance_m("p_lat", "p_lon", "lat", "lon"), 6).alias("m")).groupBy(id).agg(F.min(F.struct("m", "lat", "lon")).alias("p")).select(id, "p.lat", "p.lon", "p.m")


def _on_paths(places: DataFrame, paths: DataFrame, id: str, near_m: float) -> DataFrame:
    """(id, lat, lon): the place on a path that is nearest to each place, within near_m; ties by the path's id."""
    found = nearest_segments(places.select(id, "lat", "lon"), paths.select("seg", "a_lat", "a_lon", "b_lat", "b_lon"), near_m, [id], 1, digits=6)
    return found.select(id, geo.closest_on_segment("lat", "lon", "a_lat", "a_lon", "b_lat", "b_lon").alias("p")).select(id, "p.lat", "p.lon")


def settle(places: DataFrame, paths: DataFrame, spots: DataFrame, home: tuple[float, float], least_m: float = 0.0, id: str = "id", near_m: float = NEAR_PATH_M) -> DataFrame:
    """(id, lat, lon, how): the place to go to for each place that can be reached; the others have no row.

    places: id (one row each), lat, lon, ring (array of lat, lon, not closed; null or under three corners: none). paths: seg and
    ends. spots: lat, lon on paths. First the nearest place on a path within near_m ("path"), then the spot nearest to the place
    inside the ring ("inside"), then one within near_m of its edge ("edge"); all at least least_m from home. Ties: the southern,
    then the western spot.
    """
    own = places.where("lat is not null and lon is not null")
    at = spots.select("lat", "lon").where("lat is not null and lon is not null").distinct()
    # Each step is for those that the ones before leave.
    first = _written(_on_paths(own, paths, id, near_m).where(_far("lat", "lon", home, least_m)).withColumn("how", F.lit("path")), "on-paths")
    areas = _written(own.where(F.size("ring") >= 3).select(id, "lat", "lon", "ring").join(first, id, "left_anti"), "areas")
    inside = _written(_inside(areas, at, id, home, least_m).select(id, "lat", "lon", F.lit("inside").alias("how")), "inside")
    beside = _beside(areas.join(inside, id, "left_anti"), at, id, near_m, home, least_m).select(id, "lat", "lon", F.lit("edge").alias("how"))
    return first.unionByName(inside).unionByName(beside)


def settle_areas(areas: DataFrame, paths: DataFrame, spots: DataFrame, home: tuple[float, float], least_m: float = 0.0, id: str = "id", near_m: float = NEAR_PATH_M) -> DataFrame:
    """(id, lat, lon, how): where an area (id, ring) to spend time in is marked; areas that can't be reached have no row.

    The spot inside it that is nearest to its middle ("inside"), else the middle where a path is within near_m ("middle"), else
    the spot at its edge nearest to the middle ("edge").
    """
    # From an array of one, so that the middle is computed once an area and its formula isn't spelled out wherever it is read.
    middles = areas.where(F.size("ring") >= 3).select(id, "ring", F.explode(F.array(geo.point_inside(F.col("ring")))).alias("p")).select(id, "ring", "p.lat", "p.lon")
    middles = _written(middles, "middles")
    at = spots.select("lat", "lon").where("lat is not null and lon is not null").distinct()
    # Each step is for those that the ones before leave.
    inside = _written(_inside(middles, at, id, home, least_m).select(id, "lat", "lon", F.lit("inside").alias("how")), "inside")
    rest = _written(middles.join(inside, id, "left_anti"), "middles")
    near = nearest_segments(rest.select(id, "lat", "lon").where(_far("lat", "lon", home, least_m)), paths.select("seg", "a_lat", "a_lon", "b_lat", "b_lon"), near_m, [id])
    near = _written(near.select(id, "lat", "lon", F.lit("middle").alias("how")), "near-middles")
    beside = _beside(rest.join(near, id, "left_anti"), at, id, near_m, home, least_m).select(id, "lat", "lon", F.lit("edge").alias("how"))
    return inside.unionByName(near).unionByName(beside)


def lines_from_paths(lines: DataFrame, paths: DataFrame, id: str = "id", step_m: float = 10.0, near_m: float = NEAR_PATH_M) -> DataFrame:
    """(id, pts): lines (id, pts: array of lat, lon) from where they first come near a path, in steps of step_m; others have no row.

    A closed line is turned to start there. An open one is cut there, from the end that leaves more of it (the first, if equal).
    """
    dense = lines.where(F.size("pts") >= 2).select(id, geo.densify(F.col("pts"), step_m).alias("pts"))
    each = dense.select(id, F.posexplode("pts").alias("i", "p")).select(id, "i", "p.lat", "p.lon")
    near = joins.segment_join(each, paths.select("seg", "a_lat", "a_lon", "b_lat", "b_lon"), near_m)
    ends = near.groupBy(id).agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    n, closed = F.size("pts"), F.get("pts", F.lit(0)) == F.get("pts", F.size("pts") - 1)
    front, back = F.slice("pts", F.col("lo") + 1, n - F.col("lo")), F.reverse(F.slice("pts", F.lit(1), F.col("hi") + 1))
    turned = F.concat(front, F.slice("pts", F.lit(2), F.col("lo")))
    return dense.join(ends, id).select(id, F.when(closed & (n >= 4), turned).when(geo.polyline_m(back) > geo.polyline_m(front), back).otherwise(front).alias("pts"))


def line_share(len_m: Column, want_min: Column, travel: Column, full_min: Column, most: Column, whole: Column) -> Column:
    """The share of a line that takes about the minutes wanted: at most `most`, no less than a quarter or 150 m of it, one with a
    friendly name if one fits. whole: lines of a kind that is asked for as far as possible."""
    floor = F.least(F.greatest(F.lit(LEAST_SHARE), LEAST_LINE_M / len_m), most)
    raw = F.least(F.greatest((want_min - travel) / full_min, floor), most)
    fits = F.filter(F.array(*map(F.lit, FRIENDLY_SHARES)), lambda f: (f >= floor - 1e-9) & (f <= most + 1e-9))
    best = F.array_min(F.transform(fits, lambda f: F.struct(F.abs(f - raw).alias("off"), f.alias("share"))))["share"]
    return F.when(whole | (raw >= most - 1e-9), most).otherwise(F.coalesce(best, raw))


def effort_min(verify: Column, dist_m: Column, mode: Column, minutes: Column) -> Column:
    """Minutes that a target at a place takes: the way there (both ways of a round trip), and the stay."""
    way = geo.travel_min(dist_m, mode)
    return F.when(verify.isin("dwell", "area"), way + minutes).when(verify == "round_trip", way * 2).otherwise(way)


def free_targets(slots: DataFrame, pool: DataFrame, home: tuple[float, float], least_m: float, used: DataFrame | None = None, cell_m: float = geo.EXPLORER_CELL_M) -> DataFrame:
    """slots plus spot, lat, lon, n, away_min and effort: targets that need no place of the map; no row where no spot fits.

    slots: verify (reach, sector, dwell, round_trip, cells, steps, away), sector (0 north .. 3 west, for sector), mode, want_min,
    minutes (of a dwell). A spot is the one of the pool (id, lat, lon) whose way from home is nearest to the one wanted, to a
    metre; ties: nearer home, then by id. Spots under least_m from home or within SPACING_M of `used` are left out.

    The pool counts as a spot for each metre from home and sector, and slots as the metres that they want: both are bounded by
    the reach in metres, whatever the tables, and meet in one sort by metre; slots then look their spot up.
    """
    if used is not None:
        pool = joins.without_near(pool.withColumn("_sf_all", F.lit(0)), used.withColumn("_sf_all", F.lit(0)), SPACING_M, ["_sf_all"]).drop("_sf_all")
    at = pool.where("lat is not null and lon is not null").select("id", "lat", "lon", geo.distance_m(home[0], home[1], "lat", "lon").alias("m"), (F.floor((geo.bearing_deg(home[0], home[1], "lat", "lon") + 45) / 90) % 4).cast("int").alias("own"))
    at = at.where(F.col("m") >= least_m).withColumn("sector", F.explode(F.array(F.lit(-1), "own"))).withColumn("metre", F.round("m").cast("bigint"))
    at = at.groupBy("sector", "metre").agg(F.min(F.struct("id", "lat", "lon", "m")).alias("spot"))
    pace = geo.by_mode("mode", geo.M_PER_MIN)
    one_way = F.when(F.col("verify") == "dwell", F.greatest(F.col("want_min") - F.col("minutes"), F.lit(1.0))).when(F.col("verify") == "round_trip", F.col("want_min") / 2).when(F.col("verify").isin("reach", "sector"), F.col("want_min"))
    rows = slots.withColumn("_sf_sector", F.when(F.col("verify") == "sector", F.col("sector")).otherwise(-1)).withColumn("_sf_metre", F.round(geo.dist_for(one_way, F.col("mode"))).cast("bigint"))
    wanted = rows.where("_sf_metre is not null").select(F.col("_sf_sector").alias("sector"), F.col("_sf_metre").alias("metre")).distinct()
    below = joins.asof_join(wanted, at, ["sector"], "metre", ["spot"]).drop("r_metre").withColumnRenamed("r_spot", "below")
    up = lambda df: df.withColumn("metre", -F.col("metre"))
    both = up(joins.asof_join(up(below), up(at), ["sector"], "metre", ["spot"]).drop("r_metre"))
    off = lambda s: F.abs(F.round(s).cast("bigint") - F.col("metre"))
    above = F.col("below").isNull() | (F.col("r_spot").isNotNull() & (off(F.col("r_spot.m")) < off(F.col("below.m"))))
    found = both.select(F.col("sector").alias("_sf_sector"), F.col("metre").alias("_sf_metre"), F.when(above, F.col("r_spot")).otherwise(F.col("below")).alias("_sf_spot"))
    out = rows.join(found, ["_sf_sector", "_sf_metre"], "left")
    clamp = lambda x, ends: F.least(F.greatest(x, F.lit(ends[0])), F.lit(ends[1]))
    cells, steps = F.col("verify") == "cells", F.col("verify") == "steps"
    a_cell, a_step = cell_m / (pace * CELL_PACE), 1 / geo.by_mode("mode", geo.STEPS_PER_MIN)
    out = out.withColumn("n", F.when(cells, clamp(F.round(F.col("want_min") / a_cell).cast("bigint"), CELLS)).when(steps, clamp(F.round(F.col("want_min") / a_step).cast("bigint"), STEPS)))
    out = out.withColumn("away_min", F.when(F.col("verify") == "away", clamp(F.col("want_min") * 3, AWAY_MIN)))
    effort = F.when(cells, F.col("n") * a_cell).when(steps, F.col("n") * a_step).when(F.col("verify") == "away", F.col("want_min")).otherwise(effort_min(F.col("verify"), F.col("_sf_spot.m"), F.col("mode"), F.col("minutes")))
    out = out.withColumn("spot", F.col("_sf_spot.id")).withColumn("lat", F.col("_sf_spot.lat")).withColumn("lon", F.col("_sf_spot.lon")).withColumn("effort", effort)
    return out.where("effort is not null").drop("_sf_sector", "_sf_metre", "_sf_spot")
