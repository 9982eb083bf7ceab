"""Ordered operators per key: islands, running totals, thinning, streaks, sliding windows.

Every window is partitioned by the caller's key, so that a key's rows meet once and nothing is ordered globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideframe.functions import geo


def ordered(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def path_steps(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """points plus step_m, the distance from the row before (null for the first)."""
    w = ordered(keys, order)
    return points.withColumn("step_m", geo.distance_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))


def path_length(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return path_steps(points, keys, order).groupBy(*keys).agg(F.coalesce(F.sum("step_m"), F.lit(0.0)).alias("length_m"), F.count("*").alias("n"))


def islands(rows: DataFrame, keys: list[str], order: list[str], t: str, max_gap: int) -> DataFrame:
    """rows plus island (from 1): a new one where t is more than max_gap after the row before; equal to it still joins."""
    w = ordered(keys, order)
    gap = F.col(t) - F.lag(t).over(w)
    return rows.withColumn("_sf_new", F.when(gap.isNull() | (gap > max_gap), 1).otherwise(0)).withColumn("island", F.sum("_sf_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_sf_new")


def runs(rows: DataFrame, keys: list[str], order: list[str], same: Column) -> DataFrame:
    """rows plus run (from 1): a new one wherever `same` isn't true (null counts as not)."""
    w = ordered(keys, order)
    return rows.withColumn("_sf_same", F.coalesce(same, F.lit(False))).withColumn("run", F.sum(F.when(F.col("_sf_same"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_sf_same")


def milestones(rows: DataFrame, keys: list[str], order: list[str], amount: str) -> DataFrame:
    """rows plus at, the running total, and position (from 1)."""
    w = ordered(keys, order)
    return rows.withColumn("at", F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("position", F.row_number().over(w))


def every_nth(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first row of each key and every n-th after it."""
    return rows.withColumn("_sf_n", F.row_number().over(ordered(keys, order))).where((F.col("_sf_n") - 1) % n == 0).drop("_sf_n")


def even_sample(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most about `most` rows a key, evenly spaced."""
    step = F.greatest(F.floor(F.count("*").over(Window.partitionBy(*keys)) / most), F.lit(1))
    numbered = rows.withColumn("_sf_n", F.row_number().over(ordered(keys, order)) - 1).withColumn("_sf_s", step)
    return numbered.where(F.col("_sf_n") % F.col("_sf_s") == 0).drop("_sf_n", "_sf_s")


def streaks(days: DataFrame, keys: list[str], day: str, today: Column) -> DataFrame:
    """(*keys, streak): consecutive days that end today, or yesterday where today is empty."""
    distinct = days.select(*keys, F.col(day).alias("d"), today.alias("today")).where("d <= today").distinct()
    run = distinct.withColumn("r", F.col("d") - F.row_number().over(Window.partitionBy(*keys).orderBy("d")))
    lengths = run.groupBy(*keys, "r").agg(F.max("d").alias("last"), F.count("*").alias("n"), F.max("today").alias("today"))
    return lengths.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("last") >= F.col("today") - 1, F.col("n"))), F.lit(0)).cast("bigint").alias("streak"))


def counter_delta(rows: DataFrame, keys: list[str], order: list[str], total: str) -> DataFrame:
    """rows plus gained since the row before; a counter that went down started over."""
    before = F.lag(total).over(ordered(keys, order))
    return rows.withColumn("gained", F.when(before.isNull(), F.lit(0)).when(F.col(total) >= before, F.col(total) - before).otherwise(F.col(total)))


def sliding(rows: DataFrame, keys: list[str], t: str, back: int, **aggregates) -> DataFrame:
    """rows plus aggregates (name=function of the window) over t - back .. t."""
    w = Window.partitionBy(*keys).orderBy(t).rangeBetween(-back, 0)
    return rows.withColumns({name: of(w) for name, of in aggregates.items()})


def still_windows(rows: DataFrame, keys: list[str], t: str, speed: str, below: float = 0.2, least_ms: int = 20_000) -> DataFrame:
    """(*keys, from_ms, to_ms) of standing still for at least least_ms; a window ends at the first moving row, or the last row."""
    w = Window.partitionBy(*keys).orderBy(t)
    marked = rows.withColumn("_sf_still", F.col(speed) < below)
    marked = runs(marked, keys, [t], F.col("_sf_still") == F.lag("_sf_still").over(w)).withColumn("_sf_next", F.lead(t).over(w))
    ends = marked.where("_sf_still").groupBy(*keys, "run").agg(F.min(t).alias("from_ms"), F.max(F.coalesce("_sf_next", t)).alias("to_ms"))
    return ends.where(F.col("to_ms") - F.col("from_ms") >= least_ms).drop("run")


def first_after(rows: DataFrame, keys: list[str], t: str, start: Column, reached: Column) -> DataFrame:
    """(*keys, lag_ms): from start to the first row at or after it where `reached` holds; null if none."""
    return rows.groupBy(*keys).agg((F.min(F.when(reached & (F.col(t) >= start), F.col(t))) - F.min(start)).alias("lag_ms"))


def fixed_spacing(segments: DataFrame, key: str, order: str, spacing_m: float) -> DataFrame:
    """(key, k, lat, lon): places every spacing_m along each key's segments (a_lat, a_lon, b_lat, b_lon), from its start on.

    What is left of a segment carries over to the next. Where a segment ends just at a place, the next begins with that place
    again (k goes on counting).
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.withColumn("_sf_m", geo.distance_m("a_lat", "a_lon", "b_lat", "b_lon"))
    carry = F.coalesce(F.sum("_sf_m").over(w), F.lit(0.0)) % spacing_m
    rows = rows.withColumn("_sf_at", F.when(carry == 0, 0.0).otherwise(spacing_m - carry))
    rows = rows.withColumn("_sf_n", F.when(F.col("_sf_at") <= F.col("_sf_m"), F.floor((F.col("_sf_m") - F.col("_sf_at")) / spacing_m) + 1).otherwise(0))
    rows = rows.withColumn("_sf_k", F.coalesce(F.sum("_sf_n").over(w), F.lit(0))).where("_sf_n > 0").withColumn("_sf_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_sf_n") - 1)))
    t = F.when(F.col("_sf_m") > 0, (F.col("_sf_at") + F.col("_sf_s") * spacing_m) / F.col("_sf_m")).otherwise(0.0)
    on = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * t
    return rows.select(key, (F.col("_sf_k") + F.col("_sf_s")).alias("k"), on("a_lat", "b_lat").alias("lat"), on("a_lon", "b_lon").alias("lon"))


def straight_links(segments: DataFrame, step_m: float, slack: float = 0.05) -> DataFrame:
    """segments whose length is a step, give or take."""
    m = geo.distance_m("a_lat", "a_lon", "b_lat", "b_lon")
    return segments.where(m.between(step_m * (1 - slack), step_m * (1 + slack)))
