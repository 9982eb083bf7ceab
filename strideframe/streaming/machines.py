"""State machines over fixes, counters and readings. Times are milliseconds, distances metres."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from strideframe.functions.geo import EARTH_RADIUS_M, EXPLORER_CELL_M, M_PER_DEG

Row = dict[str, Any]
#: Coarser fixes don't count for quests.
MAX_ACCURACY_M = 35.0


def metres(a_lat: float, a_lon: float, b_lat: float, b_lon: float) -> float:
    p, q = math.radians(a_lat), math.radians(b_lat)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b_lon - a_lon) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(h))


class Machine:
    output = ""

    def start(self) -> Row:
        return {}


@dataclass
class JournalThrottle(Machine):
    """Rows worth writing: the first, and those 5 s or 5 m from the last one written, or before it in time, or of another kind."""

    every_ms: int = 5_000
    every_m: float = 5.0
    output = "id bigint, t_ms bigint"

    def step(self, s: Row, r: Row) -> list[tuple]:
        last = s.get("last")
        kind = bool(r.get("simulated", False))
        if last and last[3] == kind and 0 <= r["t_ms"] - last[0] < self.every_ms and metres(last[1], last[2], r["lat"], r["lon"]) < self.every_m:
            return []
        s["last"] = [int(r["t_ms"]), r["lat"], r["lon"], kind]
        return [(r["id"], r["t_ms"])]


@dataclass
class DistanceTicks(Machine):
    """A row whenever `every` metres have been covered since the last one; the rest isn't carried over."""

    every: float = 1_000.0
    output = "id bigint, walked double"

    def step(self, s: Row, r: Row) -> list[tuple]:
        if "lat" in s:
            s["sum"] = s.get("sum", 0.0) + metres(s["lat"], s["lon"], r["lat"], r["lon"])
        s["lat"], s["lon"] = r["lat"], r["lon"]
        if s.get("sum", 0.0) < self.every:
            return []
        out = [(r["id"], s["sum"])]
        s["sum"] = 0.0
        return out


@dataclass
class PlainFilter(Machine):
    """The baseline filter: coarse fixes and jumps are refused, the third jump in a row is believed; an odometer over the rest."""

    fastest_kmh: float = 100.0
    output = "id bigint, verdict string, odometer_m double"

    def step(self, s: Row, r: Row) -> list[tuple]:
        total = s.setdefault("total", 0.0)
        if r["accuracy_m"] > MAX_ACCURACY_M:
            return [(r["id"], "blurry", total)]
        last = s.get("last")
        seconds = (r["t_ms"] - last[0]) / 1000 if last else 0
        if last and 1 <= seconds <= 120:
            beyond = metres(last[1], last[2], r["lat"], r["lon"]) - last[3] - r["accuracy_m"]
            if max(0.0, beyond) / seconds * 3.6 > self.fastest_kmh and s.get("refused", 0) < 2:
                s["refused"] = s.get("refused", 0) + 1
                return [(r["id"], "gated", total)]
        s["refused"] = 0
        anchor = s.get("anchor") if last and r["t_ms"] - last[0] <= 300_000 else None
        if anchor is None:
            anchor = [r["lat"], r["lon"]]
        elif (d := metres(*anchor, r["lat"], r["lon"])) >= max(6.0, r["accuracy_m"]):
            total, anchor = total + d, [r["lat"], r["lon"]]
        s.update(total=total, anchor=anchor, last=[int(r["t_ms"]), r["lat"], r["lon"], r["accuracy_m"]])
        return [(r["id"], "used", total)]


@dataclass
class QuestTracker(Machine):
    """One quest's progress over fixes; a row for each fix that counts, until it is done.

    kind: reach, dwell (best stretch without leaving), courier (from a to b within limit_min), round_trip (far point, then home),
    cells (n different ones), line (share of points passed within r).
    """

    kind: str
    target: tuple[float, float] = (0.0, 0.0)
    to: tuple[float, float] = (0.0, 0.0)
    home: tuple[float, float] = (0.0, 0.0)
    r: float = 30.0
    minutes: float = 5.0
    limit_min: float = 30.0
    n: int = 5
    coverage: float = 0.8
    line: list[tuple[float, float]] = field(default_factory=list)
    output = "id bigint, progress double, done boolean"

    def step(self, s: Row, r: Row) -> list[tuple]:
        if s.get("done") or r["accuracy_m"] > MAX_ACCURACY_M:
            return []
        progress = getattr(self, f"_{self.kind}")(s, r, lambda p, within=self.r: metres(*p, r["lat"], r["lon"]) <= within)
        s["done"] = progress >= 1.0
        return [(r["id"], progress, s["done"])]

    def _reach(self, s: Row, r: Row, near) -> float:
        return float(near(self.target))

    def _dwell(self, s: Row, r: Row, near) -> float:
        if near(self.target):
            s.setdefault("since", int(r["t_ms"]))
            s["best"] = max(s.get("best", 0), int(r["t_ms"]) - s["since"])
        else:
            s.pop("since", None)
        return min(1.0, s.get("best", 0) / (self.minutes * 60_000))

    def _courier(self, s: Row, r: Row, near) -> float:
        taken = s.get("taken")
        if taken is None:
            if near(self.target):
                s["taken"] = int(r["t_ms"])
        elif r["t_ms"] - taken > self.limit_min * 60_000:
            del s["taken"]
        elif near(self.to):
            return 1.0
        return 0.5 if "taken" in s else 0.0

    def _round_trip(self, s: Row, r: Row, near) -> float:
        if near(self.home, 50.0):
            if s.get("far"):
                return 1.0
            s["out"] = False
        else:
            s["out"] = True
            s["far"] = s.get("far", False) or near(self.target)
        return 0.5 if s.get("far") else 0.1 if s["out"] else 0.0

    def _cells(self, s: Row, r: Row, near) -> float:
        k = M_PER_DEG / EXPLORER_CELL_M
        cell = [math.floor(r["lat"] * k), math.floor(r["lon"] * k * math.cos(math.radians(r["lat"])))]
        if cell not in s.setdefault("seen", []):
            s["seen"].append(cell)
        return min(1.0, len(s["seen"]) / self.n)

    def _line(self, s: Row, r: Row, near) -> float:
        passed = s.setdefault("passed", [False] * len(self.line))
        for i, p in enumerate(self.line):
            passed[i] = passed[i] or near(p)
        return min(1.0, sum(passed) / max(1, len(passed)) / self.coverage)


@dataclass
class Debounce(Machine):
    """A reading's changes once they have lasted: hold_ms, or leave_ms for leaving true; the first reading counts at once."""

    hold_ms: int = 45_000
    leave_ms: int = 5_000
    output = "t_ms bigint, value boolean"

    def step(self, s: Row, r: Row) -> list[tuple]:
        out, now, value = [], int(r["t_ms"]), bool(r["value"])
        if "stable" not in s:
            s["stable"] = value
            return [(now, value)]
        if "due" in s and now >= s["due"]:
            s["stable"] = s["pending"]
            out.append((s.pop("due"), s.pop("pending")))
        if value == s["stable"]:
            s.pop("due", None), s.pop("pending", None)
        elif s.get("pending") != value:
            s["pending"], s["due"] = value, now + (self.leave_ms if s["stable"] else self.hold_ms)
        return out


@dataclass
class AwayTime(Machine):
    """Time spent over 100 m from home, credited between fixes, at most cap_ms for each gap."""

    home: tuple[float, float]
    cap_ms: int = 300_000
    output = "id bigint, away_ms bigint"

    def step(self, s: Row, r: Row) -> list[tuple]:
        if r["accuracy_m"] > MAX_ACCURACY_M:
            return []
        away, before = metres(*self.home, r["lat"], r["lon"]) > 100, s.get("t")
        if before is not None and s["away"] and away and r["t_ms"] > before:
            s["sum"] = s.get("sum", 0) + min(self.cap_ms, int(r["t_ms"]) - before)
        s["t"], s["away"] = int(r["t_ms"]), away
        return [(r["id"], s.get("sum", 0))]


@dataclass
class HomeWatch(Machine):
    """home, checking or away, by fixes against a circle with their accuracy as the margin; a check that isn't settled expires."""

    home: tuple[float, float]
    radius_m: float = 50.0
    expire_ms: int = 60_000
    arrive: int = 2
    output = "t_ms bigint, state string"

    def start(self) -> Row:
        return {"state": "checking", "inside": 0}

    def _to(self, s: Row, state: str, t: int) -> list[tuple]:
        changed = s["state"] != state
        s.update(state=state, inside=0, since=t)
        return [(t, state)] if changed else []

    def step(self, s: Row, r: Row) -> list[tuple]:
        t, d = int(r["t_ms"]), metres(*self.home, r["lat"], r["lon"])
        outside, inside = d - r["accuracy_m"] > self.radius_m, d + r["accuracy_m"] <= self.radius_m
        out: list[tuple] = []
        if s["state"] == "checking" and t - s.setdefault("since", t) > self.expire_ms:
            out += self._to(s, "home", t)
        if outside and s["state"] != "away":
            out += self._to(s, "away", t)
        elif inside and s["state"] == "checking":
            out += self._to(s, "home", t)
        elif s["state"] == "away":
            s["inside"] = s["inside"] + 1 if inside else 0
            if s["inside"] >= self.arrive:
                out += self._to(s, "home", t)
        return out


@dataclass
class TrapTimer(Machine):
    """Timed effects: a row with kind and duration_ms starts one or replaces the one of its kind; rows give those that have ended by then."""

    output = "t_ms bigint, kind string"

    def step(self, s: Row, r: Row) -> list[tuple]:
        running, t = s.setdefault("until", {}), int(r["t_ms"])
        ended = sorted((at, k) for k, at in running.items() if at <= t)
        for _, k in ended:
            del running[k]
        if r.get("kind") and r.get("duration_ms"):
            running[r["kind"]] = t + int(r["duration_ms"])
        return [(at, k) for at, k in ended]


@dataclass
class SavePolicy(Machine):
    """Rows at which to save: the first, eventful ones, and those every_ms from the last save, before or after it."""

    every_ms: int = 30_000
    output = "id bigint, t_ms bigint"

    def step(self, s: Row, r: Row) -> list[tuple]:
        t = int(r["t_ms"])
        if not r["eventful"] and "last" in s and abs(t - s["last"]) < self.every_ms:
            return []
        s["last"] = t
        return [(r["id"], t)]


@dataclass
class Throttle(Machine):
    """Rows gap_ms or more after the last one that passed; a row before it in time passes too."""

    gap_ms: int = 1_000
    output = "id bigint, t_ms bigint"

    def step(self, s: Row, r: Row) -> list[tuple]:
        t = int(r["t_ms"])
        if "last" in s and 0 <= t - s["last"] < self.gap_ms:
            return []
        s["last"] = t
        return [(r["id"], t)]


@dataclass
class NearMissLog(Machine):
    """Near misses worth a line: of a place without one, of another reason than its last, or every_ms after it."""

    every_ms: int = 30_000
    output = "id bigint, place string, reason string"

    def step(self, s: Row, r: Row) -> list[tuple]:
        place, t = str(r["place"]), int(r["t_ms"])
        last = s.get(place)
        if last and last[0] == r["reason"] and t - last[1] < self.every_ms:
            return []
        s[place] = [r["reason"], t]
        return [(r["id"], place, r["reason"])]
