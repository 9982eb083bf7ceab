"""Polylines that recursion or greed shapes: simplification and stitching, as Arrow-batched functions of one row or one group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions.geo import EARTH_RADIUS_M, M_PER_DEG

POINTS = "array<struct<lat:double,lon:double>>"


def metres(a, b) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(h))


def simplified(points: list[tuple[float, float]], tolerance_m: float) -> list[tuple[float, float]]:
    """Douglas-Peucker on the plane at the first point, with a stack instead of recursion."""
    if len(points) < 3:
        return list(points)
    p = np.array(points, float)
    xy = np.column_stack([(p[:, 1] - p[0, 1]) * M_PER_DEG * math.cos(math.radians(p[0, 0])), (p[:, 0] - p[0, 0]) * M_PER_DEG])
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    spans = [(0, len(p) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        d, own = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
        length2 = d @ d
        t = np.clip(own @ d / length2, 0, 1) if length2 else np.zeros(len(own))
        off = np.linalg.norm(own - t[:, None] * d, axis=1)
        k = int(off.argmax())
        if off[k] > tolerance_m:
            keep[a + 1 + k] = True
            spans += [(a, a + 1 + k), (a + 1 + k, b)]
    return [points[i] for i in np.flatnonzero(keep)]


def simplified_pinned(points: list[tuple[float, float]], pinned: list[bool], tolerance_m: float) -> list[tuple[float, float]]:
    """Pieces between pinned points are simplified by themselves."""
    marks = [i for i in range(len(points)) if i in (0, len(points) - 1) or (i < len(pinned) and pinned[i])]
    out = [points[0]] if points else []
    for a, b in zip(marks, marks[1:]):
        out += simplified(points[a : b + 1], tolerance_m)[1:]
    return out


def simplify(points: Column, tolerance_m: float) -> Column:
    @F.pandas_udf(POINTS)
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda ps: [{"lat": a, "lon": b} for a, b in simplified([(p["lat"], p["lon"]) for p in ps], tolerance_m)])

    return of(points)


def stitched(lines: list[list[tuple[float, float]]], join_m: float = 8.0) -> list[list[tuple[float, float]]]:
    """Lines chained where ends are within join_m: the longest first, each taking the nearest free end until none is left."""
    left = sorted((list(x) for x in lines if x), key=lambda x: -sum(map(metres, x, x[1:])))
    out = []
    while left:
        chain = left.pop(0)
        while True:
            ends = [(metres(end, line[i]), k, at_end, i) for k, line in enumerate(left) for at_end, end in ((True, chain[-1]), (False, chain[0])) for i in (0, -1)]
            best = min((e for e in ends if e[0] <= join_m), default=None)
            if best is None:
                break
            _, k, at_end, i = best
            line = left.pop(k)
            line = line if (i == 0) == at_end else line[::-1]
            chain = chain + line[metres(chain[-1], line[0]) == 0 :] if at_end else line[: len(line) - (metres(line[-1], chain[0]) == 0)] + chain
        out.append(chain)
    return out


def is_closed(points: list[tuple[float, float]], within_m: float = 15.0) -> bool:
    return len(points) > 2 and metres(points[0], points[-1]) < within_m


def stitch(ways: DataFrame, keys: list[str], join_m: float = 8.0) -> DataFrame:
    """(*keys, part, pts, closed): ways (*keys, pts) chained within each trail, which bounds a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = sorted([(p["lat"], p["lon"]) for p in pts] for pts in pdf["pts"])
        rows = [(*(pdf[k].iloc[0] for k in keys), n, [{"lat": a, "lon": b} for a, b in c], is_closed(c)) for n, c in enumerate(stitched(lines, join_m))]
        return pd.DataFrame(rows, columns=[*keys, "part", "pts", "closed"])

    types = dict(ways.dtypes)
    return ways.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), f"part int, pts {POINTS}, closed boolean"]))
