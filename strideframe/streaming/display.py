"""What a map shows: positions held still while standing, and the last estimate carried on to the time it is asked for."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions import geo
from strideframe.operators import joins
from strideframe.streaming.machines import Machine, Row, metres

#: A radius that holds 68 % in sigmas of one axis; how far ahead, and from which ages on, an estimate is carried.
RADIUS_SIGMAS, AHEAD_MS, PREDICTED_MS, STALE_MS, LEAST_SPEED_SIGMA = 1.515, 3_000, 6_000, 30_000, 0.5


@dataclass
class Hold(Machine):
    """Each estimate's position as shown: the place a hold began at, while it lasts.

    Two thresholds: a hold begins where standing is likely (p_still over likely) and the speed low with no steps for quiet_ms, and
    ends with steps, or when `leave` estimates in a row are farther from its place than exit_m or two sigmas; without any steps,
    than quiet_m or 3.5 sigmas. Rows: id, t_ms, lat, lon, uncertainty_m, speed_mps, p_still, steps (since the row before, null: 0).
    """

    likely: float = 0.8
    slow_mps: float = 0.3
    quiet_ms: int = 10_000
    leave: int = 2
    exit_m: float = 3.0
    quiet_m: float = 15.0
    output = "id bigint, held boolean, lat double, lon double"

    def step(self, s: Row, r: Row) -> list[tuple]:
        t, steps = int(r["t_ms"]), r.get("steps")
        if steps is not None and not math.isnan(steps) and steps > 0:
            s["stepped"], s["counter"] = t, True
            s.pop("at", None)
        quiet = t - s.get("stepped", -math.inf) >= self.quiet_ms
        if "at" in s:
            sigma = r["uncertainty_m"] / RADIUS_SIGMAS
            limit = max(self.quiet_m, 3.5 * sigma) if s.get("counter") and quiet else max(self.exit_m, 2 * sigma)
            s["far"] = s["far"] + 1 if metres(*s["at"], r["lat"], r["lon"]) > limit else 0
            if s["far"] >= self.leave:
                del s["at"]
        elif r["p_still"] > self.likely and r["speed_mps"] < self.slow_mps and quiet:
            s["at"], s["far"] = [r["lat"], r["lon"]], 0
        held = "at" in s
        return [(r["id"], held, *(s["at"] if held else (r["lat"], r["lon"])))]


def shown(asked: DataFrame, estimates: DataFrame, key: str, speed_sigma: float = LEAST_SPEED_SIGMA) -> DataFrame:
    """asked (key, t_ms, ...) plus what a map shows then: lat, lon, uncertainty_m, age_ms, source (null before any estimate).

    estimates: (key, t_ms, id, lat, lon, uncertainty_m, speed_mps, course_deg, standing). The last one at or before the time goes
    on along its course for three seconds at most, unless it stands or has no course; uncertainty grows with its age, and from six
    seconds on it is `predicted`, from thirty `stale`. A join as of the time and expressions; nothing is kept for a query.
    """
    values = ["id", "lat", "lon", "uncertainty_m", "speed_mps", "course_deg", "standing"]
    row = joins.asof_join(asked, estimates.select(key, "t_ms", *values), [key], "t_ms", values)
    age = F.col("t_ms") - F.col("r_t_ms")
    ahead = F.when(F.coalesce("r_standing", F.lit(False)) | F.col("r_course_deg").isNull(), 0.0).otherwise(F.col("r_speed_mps") * F.least(age, F.lit(AHEAD_MS)) / 1000)
    spot = geo.destination("r_lat", "r_lon", F.coalesce("r_course_deg", F.lit(0.0)), ahead)
    source = F.when(age > STALE_MS, "stale").when(age > PREDICTED_MS, "predicted").when(age.isNotNull(), "fresh")
    grown = F.col("r_uncertainty_m") + F.greatest(F.lit(speed_sigma), F.lit(LEAST_SPEED_SIGMA)) * age / 1000
    return row.select(*asked.columns, spot["lat"].alias("lat"), spot["lon"].alias("lon"), grown.alias("uncertainty_m"), age.alias("age_ms"), source.alias("source"))
