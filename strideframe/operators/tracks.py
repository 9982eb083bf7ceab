"""Track operators that look both ways along one track, held whole: smoothing and turns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions.geo import M_PER_DEG


def smoothed(t_s: np.ndarray, z: np.ndarray, sigma: np.ndarray, accel: float) -> np.ndarray:
    """Positions and speeds (n x 4) of a constant-velocity track: a Kalman pass forward, a Rauch-Tung-Striebel pass back."""
    n = len(t_s)
    if not n:
        return np.empty((0, 4))
    x, p = np.zeros((n, 4)), np.zeros((n, 4, 4))
    ahead_x, ahead_p, moves = np.zeros((n, 4)), np.zeros((n, 4, 4)), np.zeros((n, 4, 4))
    h = np.eye(2, 4)
    for k in range(n):
        if k == 0:
            m, c = np.array([z[0, 0], z[0, 1], 0.0, 0.0]), np.diag([sigma[0] ** 2, sigma[0] ** 2, 4.0, 4.0])
        else:
            dt = t_s[k] - t_s[k - 1]
            f = np.eye(4)
            f[0, 2] = f[1, 3] = dt
            q = np.kron([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]], np.eye(2)) * accel**2
            moves[k], ahead_x[k], ahead_p[k] = f, f @ x[k - 1], f @ p[k - 1] @ f.T + q
            s = h @ ahead_p[k] @ h.T + np.eye(2) * sigma[k] ** 2
            gain = np.linalg.solve(s, h @ ahead_p[k]).T
            m = ahead_x[k] + gain @ (z[k] - ahead_x[k][:2])
            c = (np.eye(4) - gain @ h) @ ahead_p[k]
        x[k], p[k] = m, (c + c.T) / 2
    for k in range(n - 2, -1, -1):
        g = np.linalg.solve(ahead_p[k + 1].T, moves[k + 1] @ p[k]).T
        x[k] = x[k] + g @ (x[k + 1] - ahead_x[k + 1])
        p[k] = p[k] + g @ (p[k + 1] - ahead_p[k + 1]) @ g.T
    return x


def smooth_tracks(fixes: DataFrame, keys: list[str], accel: float = 0.3, worst_m: float = 35.0) -> DataFrame:
    """(*keys, t_ms, lat, lon, speed_mps) of the fixes good enough, smoothed; of equal times the first counts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["accuracy_m"] <= worst_m].sort_values(["t_ms", "accuracy_m", "lat", "lon"]).drop_duplicates("t_ms")
        if own.empty:
            return pd.DataFrame(columns=[*keys, "t_ms", "lat", "lon", "speed_mps"])
        lat0, lon0 = own["lat"].iloc[0], own["lon"].iloc[0]
        k = M_PER_DEG * math.cos(math.radians(lat0))
        x = smoothed((own["t_ms"] - own["t_ms"].iloc[0]).to_numpy() / 1000, np.column_stack([(own["lon"] - lon0) * k, (own["lat"] - lat0) * M_PER_DEG]), np.maximum(2.0, own["accuracy_m"].to_numpy() / 1.515), accel)
        return own[[*keys, "t_ms"]].assign(lat=lat0 + x[:, 1] / M_PER_DEG, lon=lon0 + x[:, 0] / k, speed_mps=np.hypot(x[:, 2], x[:, 3]))

    types = dict(fixes.dtypes)
    return fixes.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "t_ms bigint, lat double, lon double, speed_mps double"]))


def turns(t_ms, lat, lon, reach_m: float = 10.0, sharp_deg: float = 60.0, apart_m: float = 20.0) -> list[tuple[int, float]]:
    """(t_ms, change in degrees): where the course from the first point reach_m before to that reach_m after bends sharply;
    of turns within apart_m of each other the sharpest."""
    n = len(t_ms)
    k = M_PER_DEG * math.cos(math.radians(lat[0])) if n else 0.0
    e, m = [(x - lon[0]) * k for x in lon], [(y - lat[0]) * M_PER_DEG for y in lat]
    far = lambda i, j: math.hypot(e[i] - e[j], m[i] - m[j])
    found: list[tuple[int, float]] = []
    for i in range(n):
        a = next((j for j in range(i - 1, -1, -1) if far(i, j) >= reach_m), None)
        b = next((j for j in range(i + 1, n) if far(i, j) >= reach_m), None)
        if a is None or b is None:
            continue
        bend = math.degrees(math.atan2(e[b] - e[i], m[b] - m[i]) - math.atan2(e[i] - e[a], m[i] - m[a]))
        bend = abs((bend + 180) % 360 - 180)
        if bend <= sharp_deg:
            continue
        if found and far(found[-1][0], i) < apart_m:
            if bend > found[-1][1]:
                found[-1] = (i, bend)
        else:
            found.append((i, bend))
    return [(int(t_ms[i]), bend) for i, bend in found]


def detect_turns(track: DataFrame, keys: list[str], **how) -> DataFrame:
    """(*keys, t_ms, bend_deg). Tracks pass through sorted, one at a time; short ones in great number cost no group each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, types = None, [], None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * (len(keys) + 2)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [*types, pa.int64(), pa.float64()])], names=[*keys, "t_ms", "bend_deg"])

        def done() -> list[tuple]:
            return [(*now, *r) for r in turns(*zip(*own), **how)] if own else []

        for batch in batches:
            types, rows = [batch.schema.field(k).type for k in keys], []
            for *key, t, lat, lon in zip(*(batch.column(c).to_pylist() for c in (*keys, "t_ms", "lat", "lon"))):
                if key != now:
                    rows += done()
                    now, own = key, []
                own.append((t, math.nan if lat is None else lat, math.nan if lon is None else lon))
            yield out(rows)
        if own:
            yield out(done())

    types = dict(track.dtypes)
    rows = track.select(*keys, "t_ms", "lat", "lon").repartition(*keys).sortWithinPartitions(*keys, *(F.asc_nulls_last(c) for c in ("t_ms", "lat", "lon")))
    return rows.mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "t_ms bigint, bend_deg double"]))
