"""Checks of game documents as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Versions that can be read, and the goals there are: fixed values.
VERSIONS = (5,)
GOALS = ("treasure_hunt", "all_trips")
_SCHEMA = "schema_version bigint, goals array<string>, goal_requirement string, goal_need bigint, zones array<struct<name:string>>"


def slot_error(text: Column, versions: tuple[int, ...] = VERSIONS, goals: tuple[str, ...] = GOALS) -> Column:
    """Why a slot document can't be played, or null. The version is looked at first, then zones, then goals in their order."""
    d = F.from_json(text, _SCHEMA)
    g = d["goals"]
    fault = lambda x, i: F.when(~x.isin(*goals), F.concat(F.lit("unknown goal "), x)).when(F.array_position(g, x) <= i, F.concat(F.lit("goal listed twice: "), x))
    need = F.coalesce(d["goal_need"], F.lit(0))
    return (
        F.when(d.isNull() | d["schema_version"].isNull(), "bad document")
        .when(~d["schema_version"].isin(*versions), F.concat(F.lit("unsupported version "), d["schema_version"].cast("string")))
        .when(g.isNull() | d["zones"].isNull(), "bad document")
        .when(F.size(d["zones"]) == 0, "no zones")
        .when(F.size(g) == 0, "no goal")
        .otherwise(F.coalesce(F.get(F.array_compact(F.transform(g, fault)), F.lit(0)), F.when((d["goal_requirement"] == "at_least") & ~need.between(1, F.size(g)), F.concat(F.lit("need out of range: "), need.cast("string")))))
    )
