"""Traces as they grow: online simplification in a bounded window, and a feed of what changed for readers who keep a cursor.

A trace is given out as rows (epoch, seq, run, lat, lon) that are never rewritten within an epoch. Thinning at the cap starts a
new epoch, which gives everything again. A reader's cursor is the epoch and the number of rows it has; with another epoch, or
rows missing in between, it reloads. Rows are keyed, so that a batch that comes twice changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideframe.functions.geo import M_PER_DEG
from strideframe.streaming.fold import fold
from strideframe.streaming.machines import Machine, Row


def off_line_m(p: list[float], a: list[float], b: list[float]) -> float:
    """Metres from p to the segment a-b, on the plane at p."""
    k = M_PER_DEG * math.cos(math.radians(p[0]))
    ax, ay, bx, by = (a[1] - p[1]) * k, (a[0] - p[0]) * M_PER_DEG, (b[1] - p[1]) * k, (b[0] - p[0]) * M_PER_DEG
    dx, dy = bx - ax, by - ay
    share = min(1.0, max(0.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(ax + share * dx, ay + share * dy)


@dataclass
class TraceSimplifier(Machine):
    """Points of a track kept so that every point lies within within_m of the line between the kept ones around it.

    A point joins the window while the line from the last kept point to it passes all points of the window closely enough; else,
    or when the window is full, the window's newest point is kept. A gap of over gap_ms, or a row without a place, ends the run
    and keeps what its window's newest point is. At `cap` kept points every other one of each run goes, its ends excepted, and
    all are given out again under the next epoch: the state holds cap points and a window at most.
    """

    within_m: float = 2.0
    window: int = 64
    cap: int = 20_000
    gap_ms: int = 120_000
    output = "epoch bigint, seq bigint, run bigint, lat double, lon double"

    def start(self) -> Row:
        return {"epoch": 0, "kept": [], "wait": [], "run": -1, "t": None}

    def _keep(self, s: Row, p: list[float]) -> list[tuple]:
        s["kept"].append([s["run"], *p])
        if len(s["kept"]) < self.cap:
            return [(s["epoch"], len(s["kept"]) - 1, s["run"], *p)]
        runs: dict[int, list] = {}
        for run, *q in s["kept"]:
            runs.setdefault(run, []).append(q)
        s["kept"] = [[run, *q] for run, own in runs.items() for i, q in enumerate(own) if i % 2 == 0 or i == len(own) - 1]
        s["epoch"] += 1
        return [(s["epoch"], i, *row) for i, row in enumerate(s["kept"])]

    def _break(self, s: Row) -> list[tuple]:
        out = self._keep(s, s["wait"][-1]) if s["wait"] else []
        s["wait"], s["t"] = [], None
        return out

    def step(self, s: Row, r: Row) -> list[tuple]:
        lat, lon = r["lat"], r["lon"]
        if lat is None or lon is None or math.isnan(lat) or math.isnan(lon):
            return self._break(s)
        out, p, t = [], [float(lat), float(lon)], int(r["t_ms"])
        if s["t"] is not None and t - s["t"] > self.gap_ms:
            out = self._break(s)
        if s["t"] is None:
            s["run"] += 1
            out += self._keep(s, p)
        else:
            last = s["kept"][-1][1:]
            if len(s["wait"]) >= self.window or any(off_line_m(w, last, p) > self.within_m for w in s["wait"]):
                out += self._keep(s, s["wait"][-1])
                s["wait"] = []
            s["wait"].append(p)
        s["t"] = t
        return out


def traces(fixes: DataFrame, key: str, **how) -> DataFrame:
    """(key, epoch, seq, run, lat, lon) of (key, t_ms, lat, lon): the whole feed of each key's track, whose runs end with its rows."""
    rows = fixes.select(key, "t_ms", "lat", "lon")
    ends = rows.groupBy(key).agg(F.max("t_ms").alias("t_ms")).select(key, (F.col("t_ms") + 1).alias("t_ms"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    return fold(rows.unionByName(ends), key, ["t_ms", "lat", "lon"], TraceSimplifier(**how))


def current(feed: DataFrame, key: str) -> DataFrame:
    """The feed's rows of each key's newest epoch, each once."""
    newest = Window.partitionBy(key)
    rows = feed.dropDuplicates([key, "epoch", "seq"]).withColumn("_sf_newest", F.max("epoch").over(newest))
    return rows.where(F.col("epoch") == F.col("_sf_newest")).drop("_sf_newest")


def since(feed: DataFrame, cursors: DataFrame, key: str) -> DataFrame:
    """What each reader has to take: current rows plus `reset`, whether it starts anew.

    cursors: (key, epoch, have), the rows a reader has of an epoch. A key without a cursor, or with one of another epoch or
    beyond the feed, gets everything.
    """
    own = cursors.select(key, F.col("epoch").alias("_sf_epoch"), F.col("have").alias("_sf_have"))
    rows = current(feed, key).withColumn("_sf_n", F.count("*").over(Window.partitionBy(key))).join(own, key, "left")
    fits = F.coalesce((F.col("_sf_epoch") == F.col("epoch")) & (F.col("_sf_have") <= F.col("_sf_n")), F.lit(False))
    rows = rows.withColumn("reset", ~fits)
    return rows.where(F.col("reset") | (F.col("seq") >= F.col("_sf_have"))).drop("_sf_epoch", "_sf_have", "_sf_n")


def feed_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's rows in a folder of its own, written over when the batch comes again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def received(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def incomplete(feed: DataFrame, key: str) -> DataFrame:
    """(key) of the keys whose newest epoch lacks rows, as when a batch was dropped: these reload."""
    return current(feed, key).groupBy(key).agg(F.count("*").alias("n"), F.max("seq").alias("last")).where("n <= last").select(key)
