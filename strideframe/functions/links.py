"""Addresses and links of map features as Column expressions; null where a feature has none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def address(street: Column, number: Column, city: Column) -> Column:
    """[number ]street[, city]; null without a street."""
    return F.when(street.isNotNull(), F.concat_ws(", ", F.concat_ws(" ", number, street), city))


def is_web(url: Column) -> Column:
    return F.lower(url).rlike("^https?://")


def wikipedia_url(tag: Column) -> Column:
    """language:title, the language of 2 to 12 letters or hyphens."""
    language, title = F.split_part(tag, F.lit(":"), F.lit(1)), F.btrim(F.substring(tag, F.instr(tag, ":") + 1, F.length(tag)))
    return F.when(F.contains(tag, F.lit(":")) & language.rlike("^[A-Za-z-]{2,12}$") & (title != ""), F.concat(F.lit("https://"), language, F.lit(".wikipedia.org/wiki/"), F.replace(title, F.lit(" "), F.lit("_"))))


def feature_url(feature_id: Column) -> Column:
    """n, w or r and digits; null for any other id."""
    kind = F.when(F.startswith(feature_id, F.lit("n")), "node").when(F.startswith(feature_id, F.lit("w")), "way").otherwise("relation")
    return F.when(feature_id.rlike("^[nwr][0-9]+$"), F.concat(F.lit("https://www.openstreetmap.org/"), kind, F.lit("/"), F.substring(feature_id, F.lit(2), F.length(feature_id))))
