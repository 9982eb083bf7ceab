"""How a phone is carried: the angle between where it points and where its owner goes, learned from courses, and anew when it changes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from strideframe.operators.heading import NONE_DEG, PER_S_DEG2, UNKNOWN_DEG2
from strideframe.streaming.machines import Machine, Row


def turned(deg: float) -> float:
    """Into (-180, 180]."""
    return 180.0 - (180.0 - deg) % 360.0


@dataclass
class CarryOffset(Machine):
    """A row for each course that tells something: id, offset_deg, sigma_deg, steady, confidence, changed.

    Rows: id, t_ms, course_deg, course_sigma_deg, azimuth_deg, azimuth_sigma_deg, rate_deg_s (how fast the compass turns). A Kalman
    filter of one angle, whose variance grows with time. Courses while the compass turns at quick_deg_s or faster, or with
    nulls, are left out, as are those not newer than the last. What an angle is off by, in sigmas, adds to a sum for its side,
    by `clip` at most and less `drift`; a sum over `alarm` (three courses at least) means that the phone is carried otherwise now:
    the offset is unknown again and starts at that angle. Until then angles off by more than `clip` sigmas don't move it.
    A pause of over pause_ms forgets the sums. steady: at least `few` courses in the last steady_ms whose remainders point one way.
    """

    quick_deg_s: float = 30.0
    drift: float = 0.5
    alarm: float = 6.0
    clip: float = 3.0
    pause_ms: int = 8_000
    steady_ms: int = 30_000
    few: int = 5
    least_steady: float = 0.6
    output = "id bigint, t_ms bigint, course_deg double, offset_deg double, sigma_deg double, steady boolean, confidence double, changed boolean"

    def start(self) -> Row:
        return {"offset": 0.0, "var": UNKNOWN_DEG2, "t": None, "right": 0.0, "left": 0.0, "rest": []}

    def step(self, s: Row, r: Row) -> list[tuple]:
        values = [r[k] for k in ("t_ms", "course_deg", "course_sigma_deg", "azimuth_deg", "azimuth_sigma_deg", "rate_deg_s")]
        if any(v is None or math.isnan(v) for v in values) or values[-1] >= self.quick_deg_s or (s["t"] is not None and values[0] <= s["t"]):
            return []
        t, course, course_sigma, azimuth, azimuth_sigma, _ = values
        since = 0 if s["t"] is None else t - s["t"]
        if since > self.pause_ms:
            s["right"] = s["left"] = 0.0
        s["t"], s["var"] = int(t), min(UNKNOWN_DEG2, s["var"] + PER_S_DEG2 * since / 1000)
        noise = course_sigma**2 + azimuth_sigma**2
        off = turned(course - azimuth - s["offset"])
        sigmas = off / math.sqrt(s["var"] + noise)
        part = max(-self.clip, min(self.clip, sigmas))
        s["right"], s["left"] = max(0.0, s["right"] + part - self.drift), max(0.0, s["left"] - part - self.drift)
        changed = max(s["right"], s["left"]) > self.alarm
        if changed:
            s.update(offset=turned(course - azimuth), var=UNKNOWN_DEG2, right=0.0, left=0.0, rest=[])
        elif abs(sigmas) <= self.clip:
            gain = s["var"] / (s["var"] + noise)
            s["offset"], s["var"] = turned(s["offset"] + gain * off), s["var"] * (1 - gain)
            s["rest"] = [x for x in s["rest"] if t - x[0] <= self.steady_ms] + [[int(t), off]]
        sigma, steady = math.sqrt(s["var"]), self._steady(s["rest"], t)
        sure = max(0.0, min(1.0, 1 - sigma / NONE_DEG)) if steady else 0.0
        return [(r["id"], int(t), float(course), s["offset"], sigma, steady, sure, changed)]

    def _steady(self, rest: list, t: float) -> bool:
        angles = [math.radians(x) for at, x in rest if t - at <= self.steady_ms]
        if len(angles) < self.few:
            return False
        return math.hypot(sum(map(math.sin, angles)), sum(map(math.cos, angles))) / len(angles) >= self.least_steady
