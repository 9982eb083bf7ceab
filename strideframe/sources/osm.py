"""Map responses (JSON with `elements`) as DataFrames, by explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions import geo

_POINT = "struct<lat:double,lon:double>"
ELEMENT = f"struct<type:string,id:bigint,lat:double,lon:double,center:{_POINT},geometry:array<{_POINT}>,tags:map<string,variant>>"
BODY = f"struct<elements:array<{ELEMENT}>,remark:string>"
_OSM_ID = "^[nwr][0-9]+$"


def elements(bodies: DataFrame, body: str = "body", strict: bool = True) -> DataFrame:
    """One row for each element of each response, with its place `ordinal`. A body without elements is an error if strict, else no row."""
    parsed = bodies.withColumn("_sf_b", F.from_json(body, BODY))
    have = F.col("_sf_b.elements")
    if strict:
        have = F.when(have.isNull(), F.raise_error(F.coalesce("_sf_b.remark", F.lit("no elements"))).cast(f"array<{ELEMENT}>")).otherwise(have)
    rows = parsed.select(*(c for c in bodies.columns if c != body), F.posexplode(have).alias("ordinal", "_sf_e"))
    return rows.select(*(c for c in rows.columns if c != "_sf_e"), "_sf_e.*").withColumn("tags", string_tags(F.col("tags")))


def string_tags(tags: Column) -> Column:
    """map<string,string>: tags with other values are dropped."""
    kept = F.map_filter(F.coalesce(tags, F.create_map().cast("map<string,variant>")), lambda k, v: F.schema_of_variant(v) == "STRING")
    return F.transform_values(kept, lambda k, v: v.cast("string"))


def features(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(id, point, name, tags, geometry): elements with a type, an id and a place; a name that is an id is none."""
    e = elements(bodies, body).where("type is not null and id is not null")
    own = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))
    middle = F.when(F.size("geometry") > 0, geo.centroid(F.col("geometry")))
    name = F.when(~F.coalesce(F.col("tags")["name"].rlike(_OSM_ID), F.lit(False)), F.col("tags")["name"])
    rows = e.withColumn("point", F.coalesce(own, F.col("center"), middle)).where("point is not null")
    return rows.select(F.concat(F.substring("type", 1, 1), F.col("id").cast("string")).alias("id"), "point", name.alias("name"), "tags", F.coalesce("geometry", F.array().cast(f"array<{_POINT}>")).alias("geometry"), "ordinal")


def candidates(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(id, point, name, score) of named places; score by what else is known of them."""
    e = elements(bodies, body)
    has = lambda k: F.map_contains_key("tags", k)
    point = F.coalesce("center", F.struct("lat", "lon"))
    score = 1 + 2 * (has("wikidata") | has("wikipedia")).cast("int") + has("historic").cast("int") + has("tourism").cast("int")
    rows = e.where(F.col("type").isNotNull() & F.col("id").isNotNull() & F.col("tags")["name"].isNotNull()).withColumn("point", point).where("point.lat is not null and point.lon is not null")
    return rows.select(F.concat(F.substring("type", 1, 1), F.col("id").cast("string")).alias("id"), "point", F.col("tags")["name"].alias("name"), score.alias("score"))


def thinned(points: Column) -> Column:
    """Without points equal to the one before."""
    return F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))


def raw_ways(bodies: DataFrame, way_class, body: str = "body") -> DataFrame:
    """(id, class, pts) of ways of two points or more; way_class: a function of the tags."""
    e = elements(bodies, body).where("type = 'way' and id is not null and geometry is not null").withColumn("pts", thinned(F.col("geometry")))
    return e.where(F.size("pts") >= 2).select("id", way_class(F.col("tags")).cast("int").alias("class"), "pts")
