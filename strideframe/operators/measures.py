"""Measures of shown positions, loose ends of a street graph, evidence for a fix's source, and goals reached once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideframe.functions import geo
from strideframe.operators import joins as J

#: A pin that moves by more than this against its estimate has jumped.
PIN_JUMP_M = 3.0


def stationary_jitter(windows: DataFrame, shown: DataFrame, key: str, t: str, tie: str, bucket: int = 3_600_000) -> DataFrame:
    """(key, rms_m, path_m_per_min, drift_m_per_min, held_share) of the positions shown (t, lat, lon) while standing still.

    windows: (key, from_ms, to_ms), both ends included; those with fewer than two positions don't count, and a key without any
    other has no row. rms_m is about the median point of each window.
    """
    inside = J.intervals_join(shown.select(key, t, tie, "lat", "lon"), windows.select(key, "from_ms", "to_ms"), [key], t, bucket)
    w = Window.partitionBy(key, "from_ms").orderBy(t, tie)
    before = lambda c: F.lag(c).over(w)
    steps = inside.withColumn("step", geo.distance_m(before("lat"), before("lon"), F.col("lat"), F.col("lon"))).withColumn("held", (before("lat") == F.col("lat")) & (before("lon") == F.col("lon")))
    order, at = F.struct(t, tie), F.struct("lat", "lon")
    per = steps.groupBy(key, "from_ms", "to_ms").agg(
        F.percentile("lat", F.lit(0.5)).alias("m_lat"), F.percentile("lon", F.lit(0.5)).alias("m_lon"), F.count("*").alias("n"), F.sum("step").alias("path"), F.count_if("held").alias("held"), F.min_by(at, order).alias("a"), F.max_by(at, order).alias("b")
    ).where("n > 1")
    minutes = (F.col("to_ms") - F.col("from_ms")) / 60_000.0
    per = per.withColumn("minutes", minutes).withColumn("drift", geo.distance_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) / F.col("minutes"))
    off = inside.join(per.select(key, "from_ms", "m_lat", "m_lon"), [key, "from_ms"]).groupBy(key).agg(F.sum(F.pow(geo.distance_m("lat", "lon", "m_lat", "m_lon"), F.lit(2.0))).alias("sq"))
    whole = per.groupBy(key).agg(F.sum("n").alias("n"), F.sum("path").alias("path"), F.sum("minutes").alias("minutes"), F.max("drift").alias("drift_m_per_min"), (F.sum("held") / F.sum(F.col("n") - 1)).alias("held_share"))
    return whole.join(off, key).select(key, F.sqrt(F.col("sq") / F.col("n")).alias("rms_m"), (F.col("path") / F.col("minutes")).alias("path_m_per_min"), "drift_m_per_min", "held_share")


def matching_stats(rows: DataFrame, key: str, t: str, tie: str) -> DataFrame:
    """(key, matched_share, switches_per_min, off_share, pin_jumps_per_min) of rows (t, seg, matched, est_lat, est_lon, lat, lon).

    A null segment is off the streets; going from or to it is a switch. A pin jumps where its offset from the estimate changes
    by more than PIN_JUMP_M. A key's time is a second at least.
    """
    w = Window.partitionBy(key).orderBy(t, tie)
    m, b = geo.distance_m("est_lat", "est_lon", "lat", "lon"), F.radians(geo.bearing_deg("est_lat", "est_lon", "lat", "lon"))
    r = rows.select(key, t, tie, "seg", "matched", m.alias("m"), b.alias("b")).select("*", (F.col("m") * F.sin("b")).alias("e"), (F.col("m") * F.cos("b")).alias("n"))
    later = F.lag(t).over(w).isNotNull()
    r = r.withColumn("switch", later & ~F.lag("seg").over(w).eqNullSafe(F.col("seg"))).withColumn("jump", F.hypot(F.col("e") - F.lag("e").over(w), F.col("n") - F.lag("n").over(w)) > PIN_JUMP_M)
    minutes = F.greatest((F.max(t) - F.min(t)) / 60_000.0, F.lit(1 / 60))
    return r.groupBy(key).agg(
        (F.count_if("matched") / F.count("*")).alias("matched_share"), (F.count_if("switch") / minutes).alias("switches_per_min"), (F.count_if(F.col("seg").isNull()) / F.count("*")).alias("off_share"), (F.count_if("jump") / minutes).alias("pin_jumps_per_min")
    )


def loose_ends(segments: DataFrame, loose: str = "loose", join_m: float = 12.0) -> DataFrame:
    """(node, to_node, dist_m): links from each loose end (a node of one segment only, which is loose) to the nearest other node.

    segments: a, a_lat, a_lon, b, b_lat, b_lon and the flag. The segment's own other end is no candidate; ties go to the
    smaller node.
    """
    ends = segments.select(F.inline(F.array(*(F.struct(F.col(x).alias("node"), F.col(f"{x}_lat").alias("lat"), F.col(f"{x}_lon").alias("lon"), F.col(y).alias("other"), F.col(loose).alias("loose")) for x, y in ("ab", "ba")))))
    nodes = ends.groupBy("node").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.count("*").alias("degree"), F.first("other").alias("other"), F.bool_or("loose").alias("loose"))
    free = nodes.where("degree = 1 and loose").select("node", "lat", "lon", "other")
    # Of three one at least is neither the node itself nor its other end.
    near = J.nearest_within(free, nodes.select("node", "lat", "lon"), join_m, ["node"], 3, "node").where("r_node <> node and r_node <> other")
    return near.groupBy("node").agg(F.min(F.struct("dist_m", "r_node")).alias("x")).select("node", F.col("x.r_node").alias("to_node"), F.col("x.dist_m").alias("dist_m"))


def sources_by_evidence(fixes: DataFrame, statuses: DataFrame, keys: list[str], t: str, gps_on: Column, valid_ms: int = 30_000) -> DataFrame:
    """fixes with `source`: a fused one counts as network where GPS is off or the last satellite status (at most valid_ms old) uses none."""
    known = J.asof_join(fixes.withColumn("_sf_on", gps_on), statuses, keys, t, ["used"])
    none = F.coalesce((F.col(t) - F.col(f"r_{t}") <= valid_ms) & (F.col("r_used") == 0), F.lit(False))
    return known.withColumn("source", F.when((F.col("source") == "fused") & (~F.col("_sf_on") | none), "network").otherwise(F.col("source"))).drop("_sf_on", "r_used", f"r_{t}")


def goals_reached(done: DataFrame, key: str, item: str, t: str, tie: str, need: int) -> DataFrame:
    """(key, t, tie) of the event that reaches `need` different items, once a key, however often an item is reported."""
    first = done.groupBy(key, item).agg(F.min(F.struct(t, tie)).alias("at")).select(key, "at.*")
    return first.withColumn("_sf_n", F.row_number().over(Window.partitionBy(key).orderBy(t, tie))).where(F.col("_sf_n") == need).drop("_sf_n")


def step_history(readings: DataFrame, key: str, keep_ms: int = 120_000) -> DataFrame:
    """(key, t_ms, kept, steps, last_event_ms): at each time of a step counter's readings, how many of the last keep_ms count,
    the steps from the first of them to the last, and the time of the sensor's last event (null: none yet).

    readings: (key, t_ms, id, total, event). Of readings at one time an event counts before a fallback, then the smaller id. A
    total below the one before starts over. All are windows: islands by resets, a frame by time, an as-of maximum.
    """
    first = F.min(F.struct((~F.col("event")).alias("fallback"), "id", "total"))
    one = readings.where("t_ms is not null and total is not null").groupBy(key, "t_ms").agg(first.alias("r"))
    by_time = Window.partitionBy(key).orderBy("t_ms")
    one = one.select(key, "t_ms", F.col("r.total").alias("total"), F.when(~F.col("r.fallback"), F.col("t_ms")).alias("event_ms"))
    one = one.withColumn("reset", F.coalesce(F.col("total") < F.lag("total").over(by_time), F.lit(False)).cast("int"))
    one = one.withColumn("since", F.sum("reset").over(by_time)).withColumn("last_event_ms", F.max("event_ms").over(by_time))
    recent = Window.partitionBy(key, "since").orderBy("t_ms").rangeBetween(-keep_ms, 0)
    return one.select(key, "t_ms", F.count("*").over(recent).alias("kept"), (F.col("total") - F.first("total").over(recent)).alias("steps"), "last_event_ms")
