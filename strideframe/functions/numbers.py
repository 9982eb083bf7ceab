"""Numbers of the game's rules as Column expressions: saturating casts, steps, effort, phrases for shares and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT, LONG = (1 << 31) - 1, (1 << 63) - 1


def _saturated(x: Column, top: int, kind: str) -> Column:
    """Whole numbers beyond the type's range become its ends, NaN becomes 0, null stays null."""
    # As a double the top of a long is one too high: it is taken as the end itself.
    return F.when(F.isnan(x), F.lit(0).cast(kind)).when(x >= float(top), F.lit(top).cast(kind)).when(x <= float(-top - 1), F.lit(-top - 1).cast(kind)).otherwise(x.cast(kind))


def floor_long(x: Column) -> Column:
    return _saturated(_whole(x, F.floor), LONG, "bigint")


def floor_int(x: Column) -> Column:
    return _saturated(_whole(x, F.floor), INT, "int")


def round_long(x: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    return _saturated(_whole(x, lambda v: F.signum(v) * F.floor(F.abs(v) + 0.5)), LONG, "bigint")


def _whole(x: Column, how) -> Column:
    # floor() gives a long: doubles of 2 ** 53 and more are whole as they are.
    return F.when(F.abs(x) < float(1 << 53), how(x).cast("double")).otherwise(x)


def step_factor(over: Column, each: float = 0.05, least: float = 0.5) -> Column:
    """How much a step counts with so many items too many in the bag."""
    return F.greatest(F.lit(1.0) - F.lit(each) * over, F.lit(least))


def tilt_deg(pitch_deg: Column, roll_deg: Column) -> Column:
    """Degrees from lying flat."""
    cosine = F.cos(F.radians(pitch_deg)) * F.cos(F.radians(roll_deg))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


#: Fixed values of the cadence model: length in metres = BASE + PER_HZ * steps a second, within these limits.
BASE, PER_HZ, SHORTEST, LONGEST = 0.25, 0.25, 0.5, 1.1


def step_length_m(cadence_hz: Column) -> Column:
    return F.least(F.greatest(BASE + PER_HZ * cadence_hz, F.lit(SHORTEST)), F.lit(LONGEST))


def cadence_for(speed_mps: Column, scale: Column) -> Column:
    """Steps a second that cover a speed by the unlimited cadence model: the positive root of a quadratic."""
    a = PER_HZ * scale
    return (F.sqrt(a * a + 4.0 * a * speed_mps) - a) / (2.0 * a)


def effort_tier(minutes: Column, per_tier: int, low: int = 1, high: int = 10) -> Column:
    return F.least(F.greatest(F.ceil(minutes / per_tier), F.lit(low)), F.lit(high)).cast("bigint")


def tier_distance_km(tier: Column, per_tier: int, speed_kmh: Column) -> Column:
    return speed_kmh * (tier * per_tier) / 60.0


#: Friendly words for shares of a line.
SHARES = ((1 / 4, "a quarter of"), (1 / 3, "a third of"), (1 / 2, "half"), (2 / 3, "two thirds of"), (3 / 4, "three quarters of"), (1.0, "the whole"))


def share_phrase(share: Column, within: float = 1e-6) -> Column:
    """The words of a share; null where none fits."""
    return F.coalesce(*(F.when(F.abs(share - x) < within, F.lit(words)) for x, words in SHARES))


def duration_words(minutes: Column) -> Column:
    m = round_long(F.greatest(minutes, F.lit(0.0)))
    h, rest = F.floor(m / 60), m % 60
    return F.when(h == 0, F.concat(rest, F.lit(" min"))).when((h == 1) & (rest == 0), F.lit("1 hour")).when(rest == 0, F.concat(h, F.lit(" hours"))).otherwise(F.concat(h, F.lit(" h "), rest, F.lit(" min")))
