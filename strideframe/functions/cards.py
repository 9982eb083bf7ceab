"""What quests are called and what they ask for, in words, as Column expressions.

A quest's columns: target (point, dwell, area, line, courier, round_trip, cells, steps, away, collect), r (metres), minutes, coverage
(a line's share), len_m, limit_min, n, theme, kind (catalog id), name and place; those that a target doesn't have may be null.
A target that isn't listed has null texts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from strideframe.functions import numbers, units
from strideframe.functions.text import compass_word

#: Kinds at which one sits, and what lines of a kind are called.
SIT_KINDS = ("bench_warmer", "picnic_break", "under_the_roof")
LINES = {"full_circle": ("Walk", "loop"), "ridge_runner": ("Walk", "ridge"), "follow_the_flow": ("Follow", "river"), "towpath_tour": ("Walk", "towpath")}
ANY_LINE = ("Walk", "trail")


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _whole(x: Column) -> Column:
    """As numbers without decimals are printed: halves to the even one."""
    return F.bround(x, 0).cast("bigint")


def _by_target(q: Mapping[str, Column], texts: dict[str, Column]) -> Column:
    return F.coalesce(*(F.when(q["target"] == k, v) for k, v in texts.items()))


def goal_text(q: Mapping[str, Column], imperial: Column) -> Column:
    """What has to be done, in one line."""
    within = units.distance(q["r"], imperial, "down")
    return _by_target(q, {
        "point": _text("Get within ", within),
        "dwell": _text("Stay ", _whole(q["minutes"]), " min within ", within),
        "area": _text("Spend ", _whole(q["minutes"]), " min inside the area"),
        "line": _text("Cover ", _whole(q["coverage"] * 100), "% of this ", units.distance(q["len_m"], imperial), " path"),
        "courier": _text("Pick up at A, deliver to B within ", _whole(q["limit_min"]), " min"),
        "round_trip": F.lit("Reach the far point, then come back home"),
        "cells": _text("Visit ", q["n"], " new map cells"),
        "steps": _text("Take ", q["n"], " steps"),
        "away": _text("Spend ", _whole(q["minutes"]), " min away from home"),
        "collect": _text("Bring home ", q["n"], " ", q["theme"], " (pick up within ", within, ")"),
    })


def title(q: Mapping[str, Column], boss: Column) -> Column:
    """A quest's name; one that collects tells what, and a boss's has its label before it, with one colon alone."""
    asks = _text("bring home ", q["n"], " ", q["theme"])
    collects = F.coalesce(q["target"] == "collect", F.lit(False))
    label = F.lit("The Big One: ")
    return F.when(boss, F.concat(label, F.when(collects, asks).otherwise(q["name"]))).when(collects, F.concat(q["name"], F.lit(": "), asks)).otherwise(q["name"])


def card(q: Mapping[str, Column], out_m: Column, bearing: Column, fallback: Column, imperial: Column) -> Column:
    """struct<headline, detail> of a quest's card; out_m and bearing: from home to its place."""
    kind, r = q["kind"], units.distance(q["r"], imperial, "down")
    within = _text("Within ", r)
    line = lambda i: F.coalesce(*(F.when(kind == k, w[i]) for k, w in LINES.items()), F.lit(ANY_LINE[i]))
    stairs, length = kind == "stairmaster", units.distance(q["len_m"], imperial)
    share = F.coalesce(numbers.share_phrase(q["coverage"]), _text(_whole(q["coverage"] * 100), "% of"))
    the = F.when(share == "the whole", " ").otherwise(" the ")
    along = F.when(q["coverage"] >= 0.995, _text("All ", length)).otherwise(_text(units.distance(q["len_m"] * q["coverage"], imperial), " of ", length))
    rose = kind == "compass_rose"
    heads = {
        "point": F.when(rose, _text("Head ", compass_word(bearing))).otherwise("Get here"),
        "dwell": _text(F.when(kind.isin(*SIT_KINDS), "Sit ").otherwise("Stay "), _whole(q["minutes"]), " min"),
        "area": _text("Hang out ", _whole(q["minutes"]), " min"),
        "line": F.when(stairs, "Climb all the stairs").otherwise(_text(line(0), " ", share, the, line(1))),
        "courier": F.lit("Deliver the package"),
        "round_trip": F.lit("Out and back"),
        "cells": F.lit("Explore somewhere new"),
        "steps": _text("Walk ", F.format_number(q["n"], 0), " steps"),
        "away": _text("Be out ", numbers.duration_words(q["minutes"])),
        "collect": _text("Collect ", q["n"], " ", q["theme"]),
    }
    details = {
        "point": F.when(rose, _text(units.distance(out_m, imperial), " out, then within ", r)).when((kind == "street_smarts") | fallback, _text(within, " of the pin")).otherwise(within),
        "dwell": _text(within, " · leaving pauses the timer"),
        "area": F.lit("Anywhere inside the outline"),
        "line": F.when(stairs, _text("All ", length, " · up or down")).otherwise(_text(along, " · either direction")),
        "courier": _text("Pick up at A, drop at B in ", _whole(q["limit_min"]), " min"),
        "round_trip": F.lit("Touch the far point, then come home"),
        "cells": F.lit("Walk where you haven't been yet"),
        "steps": F.lit("Any pace, anywhere"),
        "away": F.lit("Time away from home"),
        "collect": F.lit("Bring them home to bank"),
    }
    return F.struct(_by_target(q, heads).alias("headline"), _by_target(q, details).alias("detail"))


def journal_detail(event: Column, q: Mapping[str, Column], goal: Column, item: Column, blurb: Column) -> Column:
    """What a journal says about an event: done, reward (of an item, with what the item does) or sent; null for others.

    A reward whose quest isn't known is for "a quest".
    """
    done = _text(q["name"], " (", q["place"], "): ", goal)
    reward = _text(item, " (reward for ", F.coalesce(q["name"], F.lit("a quest")), "): ", blurb)
    return F.when(event == "done", done).when(event == "reward", reward).when(event == "sent", _text(q["name"], " sent to the server"))
