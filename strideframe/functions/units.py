"""Distances, speeds and areas as text in a player's units, as Column expressions.

Numbers lean to clean values: short distances are steps of 5 or 10 m (10 ft), longer ones have one decimal under ten, dropped where
it is 0. A limit rounds down and what is left to go rounds up. Null, NaN and infinite values read as a dash, negative ones as 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a mile and a foot, where feet turn into miles (a tenth), what no value reads as, slack for noise.
M_PER_MILE, M_PER_FOOT, FEET_UNTIL, NO_VALUE, SLACK = 1609.344, 0.3048, 528, "–", 1e-9


def steps_of(x: Column, step, rounding: str = "nearest") -> Column:
    """How many steps x >= 0 is: the nearest number, or the one below (down) or above (up), but for noise."""
    q = x / step
    return {"nearest": F.floor(q + 0.5), "down": F.floor(q + SLACK), "up": F.ceil(q - SLACK)}[rounding]


def _large(x: Column, least_tenths: int, unit: str, rounding: str) -> Column:
    tenths = F.greatest(steps_of(x, 0.1, rounding), F.lit(least_tenths))
    whole, rest = F.floor(tenths / 10), tenths % 10
    short = F.when(rest == 0, whole.cast("string")).otherwise(F.concat(whole, F.lit("."), rest))
    return F.concat(F.when(x >= 10, steps_of(x, 1.0, rounding).cast("string")).otherwise(short), F.lit(f" {unit}"))


def _shown(x: Column, text: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), NO_VALUE).otherwise(text)


def distance(m: Column, imperial: Column | None = None, rounding: str = "nearest") -> Column:
    imperial = F.lit(False) if imperial is None else imperial
    x = F.greatest(m, F.lit(0.0))
    # The rounded value decides about the unit: 996 m are 1 km.
    metres = F.when(x < 100, steps_of(x, 5.0, rounding) * 5).otherwise(steps_of(x, 10.0, rounding) * 10)
    feet = steps_of(x / M_PER_FOOT, 10.0, rounding) * 10
    metric = F.when(metres < 1000, F.concat(metres, F.lit(" m"))).otherwise(_large(x / 1000, 10, "km", rounding))
    return _shown(m, F.when(imperial, F.when(feet < FEET_UNTIL, F.concat(feet, F.lit(" ft"))).otherwise(_large(x / M_PER_MILE, 1, "mi", rounding))).otherwise(metric))


def speed(kmh: Column, imperial: Column) -> Column:
    whole = lambda x: F.floor(F.abs(x) + 0.5) * F.signum(x).cast("bigint")
    return _shown(kmh, F.when(imperial, F.concat(whole(kmh * 1000 / M_PER_MILE), F.lit(" mph"))).otherwise(F.concat(whole(kmh), F.lit(" km/h"))))


def area(m2: Column, imperial: Column) -> Column:
    x = F.greatest(m2, F.lit(0.0))

    def of(v: Column, unit: str) -> Column:
        return F.when((v > 0) & (steps_of(v, 0.1) == 0), f"<0.1 {unit}").otherwise(_large(v, 0, unit, "nearest"))

    return _shown(m2, F.when(imperial, of(x / (M_PER_MILE * M_PER_MILE), "mi²")).otherwise(of(x / 1_000_000, "km²")))
