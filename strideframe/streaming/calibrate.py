"""How long a walker's steps are: a scale on the step model, learned from stretches of good fixes, and learned anew when it changes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from strideframe.streaming.bridge import step_metres
from strideframe.streaming.machines import Machine, Row, metres


@dataclass
class StepCalibrator(Machine):
    """A row for each stretch of walking that tells something: id, scale, sigma, observed, changed (whether the scale was given up).

    Rows: id, t_ms, lat, lon, uncertainty_m, good (an accepted fix of a walker), steps (since the row before). A stretch is of
    good rows at most gap_ms apart, at least window_ms and least_m long (by spots path_m apart, so that noise isn't distance). Its
    metres over those its steps predict are an observation of the scale, for a Kalman filter of one number. The sums of what
    observations exceed the scale by, and fall short of it, in sigmas less `drift` each, start at 0; where one passes `alarm`
    the scale counts as unknown again, and the next stretches settle it.
    """

    window_ms: int = 60_000
    least_m: float = 80.0
    gap_ms: int = 10_000
    path_m: float = 15.0
    start_sigma: float = 0.15
    unknown_var: float = 0.04
    per_minute: float = 1e-4
    noise: float = 1.5
    drift: float = 0.25
    alarm: float = 3.0
    bounds: tuple[float, float] = (0.6, 1.4)
    output = "id bigint, scale double, sigma double, observed double, changed boolean"

    def start(self) -> Row:
        return {"scale": 1.0, "var": self.start_sigma**2, "above": 0.0, "below": 0.0, "stretch": None}

    def _begin(self, r: Row) -> Row:
        return {"from": int(r["t_ms"]), "to": int(r["t_ms"]), "spot": [r["lat"], r["lon"]], "m": 0.0, "steps": 0, "unc": float(r["uncertainty_m"])}

    def step(self, s: Row, r: Row) -> list[tuple]:
        w, t = s["stretch"], int(r["t_ms"])
        if not r["good"]:
            s["stretch"] = None
            return []
        if w is None or not 0 <= t - w["to"] <= self.gap_ms:
            s["stretch"] = self._begin(r)
            return []
        w["steps"], w["to"] = w["steps"] + int(r["steps"]), t
        on = metres(*w["spot"], r["lat"], r["lon"])
        if on < self.path_m:
            return []
        w["m"], w["spot"] = w["m"] + on, [r["lat"], r["lon"]]
        span = w["to"] - w["from"]
        if span < self.window_ms or w["m"] < self.least_m:
            return []
        s["stretch"] = self._begin(r)
        model = step_metres(w["steps"], span / 1000)
        if model <= 0:
            return []
        return [(r["id"], *self._learn(s, w["m"] / model, self.noise * (w["unc"] + float(r["uncertainty_m"])) / 2 / (model * s["scale"]), span))]

    def _learn(self, s: Row, observed: float, sigma: float, span_ms: int) -> tuple:
        off = (observed - s["scale"]) / sigma
        s["above"], s["below"] = max(0.0, s["above"] + off - self.drift), max(0.0, s["below"] - off - self.drift)
        s["var"] += self.per_minute * span_ms / 60_000
        changed = max(s["above"], s["below"]) > self.alarm
        if changed:
            s["var"], s["above"], s["below"] = max(s["var"], self.unknown_var), 0.0, 0.0
        gain = s["var"] / (s["var"] + sigma**2)
        s["scale"] = min(self.bounds[1], max(self.bounds[0], s["scale"] + gain * (observed - s["scale"])))
        s["var"] *= 1 - gain
        return s["scale"], math.sqrt(s["var"]), observed, changed
