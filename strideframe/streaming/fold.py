"""Runs a state machine per key, over a batch or a stream.

A machine has start() -> state, a dict that JSON can hold, and step(state, row) -> output rows; it changes state in place.
A batch is dealt by key and sorted within its partitions, and rows pass through one at a time: memory holds one state, not one
key's rows, however hot the key. A stream keeps the state in the state store; rows of a trigger are sorted before they are
stepped, and rows later than what the machine allows are the machine's to refuse.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Machine(Protocol):
    #: Columns of the output rows, as DDL, after the key.
    output: str

    def start(self) -> dict[str, Any]: ...

    def step(self, state: dict[str, Any], row: dict[str, Any]) -> list[tuple]: ...


def _schema(df: DataFrame, key: str, machine: Machine) -> tuple[str, list[str]]:
    return f"{key} {dict(df.dtypes)[key]}, {machine.output}", [key, *(c.strip().split()[0] for c in machine.output.split(","))]


def fold(rows: DataFrame, key: str, order: list[str], machine: Machine) -> DataFrame:
    """What the machine gives out for each key's rows in their order."""
    schema, columns = _schema(rows, key, machine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if state is None or row[key] != now:
                    now, state = row[key], machine.start()
                out += [(now, *x) for x in machine.step(state, row)]
            yield pd.DataFrame(out, columns=columns)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def fold_stream(rows: DataFrame, key: str, order: list[str], machine: Machine, event_time: str | None = None, late: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """The same over a streaming DataFrame, in append mode.

    With event_time, a timestamp column, a key's state goes once the watermark (`late` behind the newest row) is idle_ms past
    its last row, so that the store doesn't grow with keys of the past; Spark leaves out rows
    older than the watermark. Without it states stay for good.
    """
    schema, columns = _schema(rows, key, machine)
    zone = rows.sparkSession.conf.get("spark.sql.session.timeZone")  # pandas gets times of that zone, without it

    def run(keys: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        known = json.loads(state.get[0]) if state.exists else {"state": machine.start(), "newest": 0}
        pdf = pd.concat(list(pdfs)).sort_values(order, kind="stable")
        newest = known["newest"]
        if event_time:
            times = pdf.pop(event_time)
            if times.notna().any():  # of rows without a time the state stays as old as it is
                newest = known["newest"] = max(newest, int(times.max().tz_localize(zone, ambiguous=True, nonexistent="shift_forward").timestamp() * 1000))
        out = [(keys[0], *x) for row in pdf.to_dict("records") for x in machine.step(known["state"], row)]
        state.update((json.dumps(known),))
        if event_time:
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=columns)

    if event_time:
        rows = rows.withWatermark(event_time, late)
    timeout = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", timeout)
