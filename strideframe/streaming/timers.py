"""Event-time timers: what happens because time passes, with no new row (Spark's transformWithState).

A dwell completes when its time is up, and a field of picked items refills a while after its first pick. State and timers live
in the state store, one set for each key; a timer fires when the watermark has passed it, also in a trigger that brings the key
no row. The batch forms give the same rows from a whole table by windows and a fold, and stop at the newest row of all, as the
stream's watermark does.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from strideframe.streaming.fold import fold
from strideframe.streaming.machines import Machine, Row

RESPAWN_MS = 3 * 60 * 60_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rows(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Texts as plain objects: Spark nests these columns in a struct, which Arrow-backed texts don't go into."""
    return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(columns)})


class DwellTimers(StatefulProcessor):
    """(key, done_ms) once a key's rows have been inside for need_ms without a row that says otherwise.

    Rows: t_ms, inside. The stretch's start is a value, its end a timer; a row outside takes both away.
    """

    def __init__(self, need_ms: int):
        self.need_ms = need_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("dwell", "since bigint, done boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        since, done = self.state.get() if self.state.exists() else (None, False)
        was, out = since, []
        for pdf in rows:
            for t, inside in sorted(zip(pdf["t_ms"].tolist(), pdf["inside"].tolist())):
                if done:
                    break
                if since is not None and t >= since + self.need_ms:
                    out.append(since + self.need_ms)
                    done, since = True, None
                elif inside:
                    since = t if since is None else since
                else:
                    since = None
        if was is not None and was != since:
            self.handle.deleteTimer(was + self.need_ms)
        if since is not None and was != since:
            self.handle.registerTimer(since + self.need_ms)
        self.state.update((since, done))
        yield _rows([(key[0], t) for t in out], ["key", "done_ms"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.update((None, True))
        yield _rows([(key[0], expiredTimerInfo.getExpiryTimeInMs())], ["key", "done_ms"])


class RespawnTimers(StatefulProcessor):
    """(key, t_ms, live, what) of items picked up and of refills: a field of `full` items, `respawn_ms` after the first pick.

    Rows: t_ms, picked (how many items a row takes, as far as there are any). Later picks don't put off the refill.
    """

    def __init__(self, full: int, respawn_ms: int = RESPAWN_MS):
        self.full, self.respawn_ms = full, respawn_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("field", "live bigint, due bigint")
        self.taken = handle.getMapState("taken", "at bigint", "n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        live, due = self.state.get() if self.state.exists() else (self.full, None)
        was, out = due, []
        for pdf in rows:
            for t, picked in sorted(zip(pdf["t_ms"].tolist(), pdf["picked"].tolist())):
                if due is not None and t >= due:  # the rows are ahead of the watermark
                    out.append((due, self.full, "refilled"))
                    live, due = self.full, None
                took = min(live, picked)
                if took:
                    live -= took
                    due = t + self.respawn_ms if due is None else due
                    out.append((t, live, "picked"))
                    self.taken.updateValue((t,), ((self.taken.getValue((t,))[0] if self.taken.containsKey((t,)) else 0) + took,))
        if was != due:
            if was is not None:
                self.handle.deleteTimer(was)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((live, due))
        yield _rows([(key[0], *x) for x in out], ["key", "t_ms", "live", "what"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.update((self.full, None))
        self.taken.clear()  # what was taken is back
        yield _rows([(key[0], expiredTimerInfo.getExpiryTimeInMs(), self.full, "refilled")], ["key", "t_ms", "live", "what"])


def _timed(rows: DataFrame, key: str, event_time: str, late: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    kind = dict(rows.dtypes)[key]
    rows = rows if key == "key" else rows.withColumnRenamed(key, "key")
    return rows.withWatermark(event_time, late).groupBy("key").transformWithStateInPandas(processor, f"key {kind}, {schema}", "Append", "EventTime")


def dwell_stream(rows: DataFrame, key: str, need_ms: int, event_time: str = "ts", late: str = "1 minute") -> DataFrame:
    """(key, done_ms) over a stream of (key, event_time, t_ms, inside). Needs the state store PROVIDER."""
    return _timed(rows, key, event_time, late, DwellTimers(need_ms), "done_ms bigint")


def respawn_stream(rows: DataFrame, key: str, full: int, respawn_ms: int = RESPAWN_MS, event_time: str = "ts", late: str = "1 minute") -> DataFrame:
    """(key, t_ms, live, what) over a stream of (key, event_time, t_ms, picked). Needs the state store PROVIDER."""
    return _timed(rows, key, event_time, late, RespawnTimers(full, respawn_ms), "t_ms bigint, live bigint, what string")


def dwell_times(rows: DataFrame, key: str, need_ms: int, inside: Column, order: str = "t_ms") -> DataFrame:
    """(key, done_ms): when each key first has been inside for need_ms, by rows up to the newest of all. Windows only."""
    own = Window.partitionBy("key").orderBy("t_ms", F.col("inside").cast("int"))
    flagged = rows.select(F.col(key).alias("key"), F.col(order).alias("t_ms"), F.coalesce(inside, F.lit(False)).alias("inside"))
    newest = flagged.agg(F.max("t_ms").alias("newest"))  # one row
    # A stretch's rows have the same number of rows outside before them; it ends with the row outside that follows.
    runs = flagged.withColumn("run", F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("until", F.lead("t_ms").over(own)).where("inside")
    spans = runs.groupBy("key", "run").agg(F.min("t_ms").alias("since"), F.max("t_ms").alias("last"), F.max_by("until", F.struct("t_ms", F.col("until").isNull())).alias("until"))
    due = F.col("since") + need_ms
    ended = spans.join(F.broadcast(newest)).where(due <= F.coalesce(F.col("until"), F.col("newest")))
    return ended.groupBy("key").agg(F.min(due).alias("done_ms"))


class Refills(Machine):
    """The batch form of RespawnTimers, for fold(): rows t_ms, picked and newest, the newest time of all."""

    output = "t_ms bigint, live bigint, what string"

    def __init__(self, full: int, respawn_ms: int = RESPAWN_MS):
        self.full, self.respawn_ms = full, respawn_ms

    def start(self) -> Row:
        return {"live": self.full, "due": None}

    def step(self, s: Row, r: Row) -> list[tuple]:
        out, t = [], int(r["t_ms"])
        if s["due"] is not None and t >= s["due"]:
            out.append((s["due"], self.full, "refilled"))
            s["live"], s["due"] = self.full, None
        took = min(s["live"], int(r["picked"]))
        if took:
            s["live"] -= took
            s["due"] = t + self.respawn_ms if s["due"] is None else s["due"]
            out.append((t, s["live"], "picked"))
        return out


def refills(rows: DataFrame, key: str, full: int, respawn_ms: int = RESPAWN_MS) -> DataFrame:
    """(key, t_ms, live, what) of (key, t_ms, picked): a row of nothing picked, at the newest time of all, ends each key."""
    rows = rows.select(F.col(key).alias("key"), "t_ms", "picked")
    ends = rows.select("key").distinct().join(F.broadcast(rows.agg(F.max("t_ms").alias("t_ms")))).select("key", "t_ms", F.lit(0).cast(dict(rows.dtypes)["picked"]).alias("picked"))
    return fold(rows.unionByName(ends), "key", ["t_ms", "picked"], Refills(full, respawn_ms))
