"""Queries over map data: tags, kinds, ways, segments, tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideframe.functions import geo, text
from strideframe.operators import joins as J
from strideframe.plans.catalog import query
from strideframe.plans.fixtures import XY, H, ctes, places, spots, table, tags, way_points, xy
from strideframe.plans.spatial import SEGMENTS, _segments
from strideframe.sources import files, osm

HIGHWAY = ["residential", "footway", "steps", "path", "service", "track", "crossing", "pedestrian", "tertiary"]
SURFACE = ["asphalt", "gravel; paved", None, "dirt", "paved", None, "sand"]
BICYCLE = [None, "yes", "no", None, "private"]
MOTOR = [None, "no", None, "yes"]
FOOTWAY = [None, "sidewalk", None, None, "crossing", None, None, None, None, None, None]
FOOT = [None, None, "no", None, None, "private"]
_LISTS = {"highway": HIGHWAY, "surface": SURFACE, "bicycle": BICYCLE, "motor_vehicle": MOTOR, "footway": FOOTWAY, "foot": FOOT}


def tagged(spark, d) -> DataFrame:
    """(fid, name, tags, lat, lon): features whose tags follow from their ids."""
    pick = lambda values: F.get(F.array(*(F.lit(v) for v in values)), (F.col("fid") % len(values)).cast("int"))
    rows = tags(spark, d).select("fid", F.when(F.col("fid") % 4 != 0, F.col("v")).alias("name"), *xy("fid"), *(pick(v).alias(k) for k, v in _LISTS.items()), "v")
    made = F.map_filter(F.create_map(*(x for k in _LISTS for x in (F.lit(k), F.col(k))), F.lit("type"), F.col("v")), lambda k, v: v.isNotNull())
    return rows.select("fid", "name", "lat", "lon", made.alias("tags"))


def _sql_list(values):
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


TAGGED = f"tagged as (select fid, case when fid % 4 <> 0 then v end as name, {XY('fid')}, v, " + ", ".join(f"({_sql_list(v)})[fid % {len(v)} + 1] as {k}" for k, v in _LISTS.items()) + " from tags)"
T = f"{ctes('tags')}, {TAGGED}"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
ROUGH = f"(coalesce(highway = 'steps', false) or case when surface is not null then len(list_filter([trim(x) for x in string_split(surface, ';')], lambda x: x in {_IN(text.UNPAVED)})) > 0 else coalesce(highway in {_IN(text.UNMARKED)}, false) end)"
SIDE = "(coalesce(footway in ('sidewalk', 'crossing'), false) or coalesce(highway = 'crossing', false))"
CLASS = f"""(case when foot in ('no','private','use_sidepath') then 0 else 1 end
 + case when highway = 'steps' then 0 when highway in ('footway','pedestrian') and not coalesce(bicycle in ('yes','designated','permissive'), false) then 0 when coalesce(bicycle in ('no','private','use_sidepath'), false) then 0 else 2 end
 + case when highway in {_IN(text.CAR_WAYS)} and not coalesce(motor_vehicle in ('no','private'), false) then 4 else 0 end + case when {SIDE} then 8 else 0 end)"""

#: Kinds: (name, groups of tags, excluded tags, whether a name is asked for, least number of features).
KINDS = [
    ("walkway", [[("highway", ["footway", "pedestrian"])], [("footway", ["sidewalk"])]], [], False, 1),
    ("trail", [[("highway", ["path", "track"]), ("surface", ["dirt", "gravel", "sand"])]], [("bicycle", ["no"])], False, 5),
    ("named stop", [[("highway", ["crossing"])], [("highway", ["steps"]), ("surface", ["*"])]], [("foot", ["no"])], True, 2),
    ("tin", [[("type", ["*"]), ("bicycle", ["yes"])]], [], True, 10_000_000),
]
KINDS_SQL = """k as (
 select fid, 'walkway' as kind from tagged where highway in ('footway','pedestrian') or footway = 'sidewalk'
 union all select fid, 'trail' from tagged where highway in ('path','track') and len(list_filter([trim(x) for x in string_split(surface, ';')], lambda x: x in ('dirt','gravel','sand'))) > 0 and coalesce(bicycle <> 'no', true)
 union all select fid, 'named stop' from tagged where (highway = 'crossing' or (highway = 'steps' and surface is not null)) and coalesce(foot <> 'no', true) and name is not null
 union all select fid, 'tin' from tagged where bicycle = 'yes' and name is not null)"""


def kind_rows(rows: DataFrame) -> DataFrame:
    """(fid, kind) for each kind that a feature is of: the kinds are compiled to one wide projection, and nothing is joined."""

    def one(name: str, any_of, none_of, named: bool) -> Column:
        return F.when(text.matches_kind(F.col("tags"), any_of, none_of, F.col("name") if named else None), F.lit(name))

    kinds = F.array_compact(F.array(*(one(*k[:4]) for k in KINDS)))
    return rows.select("fid", F.explode(kinds).alias("kind"))


@query(f"{T} select fid, len(list_filter([trim(x) for x in string_split(surface, ';')], lambda x: x in ('gravel', 'sand'))) > 0 as loose, bicycle is not null as said from tagged where surface is not null")
def b01_tag_condition(spark, d):
    t = tagged(spark, d).where(F.map_contains_key("tags", "surface"))
    return t.select("fid", text.tag_holds(F.col("tags")["surface"], ["gravel", "sand"]).alias("loose"), text.tag_holds(F.col("tags")["bicycle"], ["*"]).alias("said"))


@query(f"{T}, {KINDS_SQL} select fid, kind from k")
def c01_feature_kinds(spark, d):
    return kind_rows(tagged(spark, d))


@query(f"{T}, {KINDS_SQL} select fid, list(kind order by kind) as kinds from k group by fid")
def c02_kinds_of_place(spark, d):
    return kind_rows(tagged(spark, d)).groupBy("fid").agg(F.array_sort(F.collect_list("kind")).alias("kinds"))


@query(f"{T}, {KINDS_SQL}, o as (select kind, count(*) as n from k group by kind) select c.kind, coalesce(o.n, 0) as n from (values ('walkway', 1), ('trail', 5), ('named stop', 2), ('tin', 10000000), ('free', 0)) c(kind, least) left join o using (kind) where c.kind = 'free' or coalesce(o.n, 0) >= greatest(c.least, 1)")
def d03_offers(spark, d):
    """Kinds with enough features; a kind without a predicate is always offered."""
    catalog = spark.createDataFrame([(k[0], k[4], False) for k in KINDS] + [("free", 0, True)], "kind string, least bigint, free boolean")
    n = kind_rows(tagged(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))
    offers = F.broadcast(catalog).join(n, "kind", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return offers.where(F.col("free") | (F.col("n") >= F.greatest("least", F.lit(1)))).select("kind", "n")


@query(f"{T}, {KINDS_SQL}, o as (select kind, count(*) as n from k group by kind) select kind, n, row_number() over (order by n desc, kind) as place from o")
def g03_offers_in_order(spark, d):
    """By count, then name; the kinds are few."""
    n = kind_rows(tagged(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "kind")).cast("bigint"))


@query(f"{T} select fid, {ROUGH} as rough, {SIDE} as side from tagged")
def b04_rough_and_side(spark, d):
    t = F.col("tags")
    return tagged(spark, d).select("fid", text.is_rough(t).alias("rough"), text.is_side(t).alias("side"))


@query(f"{T} select fid, {CLASS} as class, {CLASS} & 4 <> 0 as by_car from tagged")
def b05_way_class(spark, d):
    c = text.way_class(F.col("tags"))
    return tagged(spark, d).select("fid", c.alias("class"), (c.bitwiseAND(F.lit(4)) != 0).alias("by_car"))


@query(f"{T}, z as (select fid, {ROUGH} as rough, fid % 40 as zone from tagged), c as (select zone, count(*) filter (where not rough) as paved from z group by zone) select z.fid from z join c using (zone) where not z.rough or c.paved < 33")
def b19_surface_preference(spark, d):
    """Rough points count only where a zone has few paved ones."""
    z = tagged(spark, d).select("fid", text.is_rough(F.col("tags")).alias("rough"), (F.col("fid") % 40).alias("zone"))
    paved = z.groupBy("zone").agg(F.count_if(~F.col("rough")).alias("paved"))
    return z.join(paved, "zone").where(~F.col("rough") | (F.col("paved") < 33)).select("fid")


@query(f"{ctes('way_points')}, p as (select way_id, i, cast(round(lat * 10000000) as bigint) as y, cast(round(lon * 10000000) as bigint) as x, max(i) over (partition by way_id) as last from way_points) select y, x, sum(case when i = 0 or i = last then 1 else 2 end) as uses from p group by y, x having count(distinct way_id) > 1")
def c04_shared_vertices(spark, d):
    """How often a vertex is used by several ways: once for an end, twice inside."""
    p = way_points(spark, d).withColumn("last", F.max("i").over(Window.partitionBy("way_id"))).withColumn("v", geo.vertex_key("lat", "lon"))
    return p.groupBy("v.y", "v.x").agg(F.sum(F.when((F.col("i") == 0) | (F.col("i") == F.col("last")), 1).otherwise(2)).alias("uses"), F.count_distinct("way_id").alias("ways")).where("ways > 1").drop("ways")


@query(f"{ctes('way_points')}, {SEGMENTS}, u as (select least(concat(a_lat,',',a_lon), concat(b_lat,',',b_lon)) as p, greatest(concat(a_lat,',',a_lon), concat(b_lat,',',b_lon)) as q, min(way_id) as way_id, bit_or(way_id % 8) as class, bit_and(way_id % 16 // 8) as side, max({H('least(a_lat,b_lat)','case when a_lat <= b_lat then a_lon else b_lon end','greatest(a_lat,b_lat)','case when a_lat <= b_lat then b_lon else a_lon end')}) as len from segments group by 1, 2) select way_id, class, side, round(len, 3) as len_m from u")
def n01_unique_segments(spark, d):
    """Undirected segments once each; the modes of their copies together, beside the road only if all are."""
    a, b = F.concat_ws(",", "a_lat", "a_lon"), F.concat_ws(",", "b_lat", "b_lon")
    low = F.col("a_lat") <= F.col("b_lat")
    length = geo.distance_m(F.least("a_lat", "b_lat"), F.when(low, F.col("a_lon")).otherwise(F.col("b_lon")), F.greatest("a_lat", "b_lat"), F.when(low, F.col("b_lon")).otherwise(F.col("a_lon")))
    u = _segments(spark, d).groupBy(F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).agg(F.min("way_id").alias("way_id"), F.bit_or(F.col("way_id") % 8).alias("class"), F.bit_and(F.expr("way_id % 16 div 8")).alias("side"), F.max(length).alias("len"))
    return u.select("way_id", "class", "side", F.round("len", 3).alias("len_m"))


@query(f"{ctes('way_points')}, {SEGMENTS}, n as (select a_lat as lat, a_lon as lon from segments union all select b_lat, b_lon from segments) select round(lat, 9) as lat, round(lon, 9) as lon, count(*) as degree from n group by 1, 2")
def d22_node_degree(spark, d):
    s = _segments(spark, d)
    n = s.select(F.explode(F.array(F.struct(F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon")), F.struct(F.col("b_lat").alias("lat"), F.col("b_lon").alias("lon")))).alias("p"))
    return n.groupBy(F.round("p.lat", 9).alias("lat"), F.round("p.lon", 9).alias("lon")).agg(F.count("*").alias("degree"))


@query(f"{ctes('way_points')}, {SEGMENTS} select way_id % 50 as zone, round(sum({H('a_lat','a_lon','b_lat','b_lon')}), 1) as length_m, round(sum({H('a_lat','a_lon','b_lat','b_lon')}) filter (where way_id % 3 = 0), 1) as rough_m, count(distinct way_id) as streets from segments group by 1")
def d04_zone_statistics(spark, d):
    """Length, rough length and number of streets of each zone."""
    s = _segments(spark, d).withColumn("len", geo.distance_m("a_lat", "a_lon", "b_lat", "b_lon"))
    return s.groupBy((F.col("way_id") % 50).alias("zone")).agg(F.round(F.sum("len"), 1).alias("length_m"), F.round(F.sum(F.when(F.col("way_id") % 3 == 0, F.col("len"))), 1).alias("rough_m"), F.count_distinct("way_id").alias("streets"))


@query(f"{ctes('way_points')} select way_id % 97 as street, cast(floor(lat / 0.005) as bigint) as ci, cast(floor(lon / 0.005) as bigint) as cj, arg_min(i, way_id * 1000 + i) as i, min(way_id * 1000 + i) as ordinal from way_points group by 1, 2, 3")
def d07_first_point_per_cell(spark, d):
    at = F.col("way_id") * 1000 + F.col("i")
    return way_points(spark, d).groupBy((F.col("way_id") % 97).alias("street"), F.floor(F.col("lat") / 0.005).alias("ci"), F.floor(F.col("lon") / 0.005).alias("cj")).agg(F.min_by("i", at).alias("i"), F.min(at).alias("ordinal"))


@query(f"""{T}, g as (select fid % 100 as trail, fid, surface, case fid % 3 when 0 then 'yes' when 1 then 'no' end as lit, fid % 17 as len from tagged), s as (select trail, surface, sum(len) as len from g where surface is not null group by 1, 2), b as (select trail, arg_max(surface, {{'l': len, 's': surface}}) as surface from s group by 1)
select g.trail, max(b.surface) as surface, case when count(lit) = 0 then null when bool_and(lit = 'yes') then 'yes' when bool_and(lit = 'no') then 'no' else 'partial' end as lit, arg_min(surface_or, fid) as first_surface from (select *, coalesce(surface, '-') as surface_or from g) g left join b using (trail) group by g.trail""")
def d08_trail_tags(spark, d):
    """The surface of most length (ties: the last by name), lit yes, no or partial, the first surface."""
    g = tagged(spark, d).select((F.col("fid") % 100).alias("trail"), "fid", F.col("tags")["surface"].alias("surface"), F.when(F.col("fid") % 3 == 0, "yes").when(F.col("fid") % 3 == 1, "no").alias("lit"), (F.col("fid") % 17).alias("len"))
    most = g.where("surface is not null").groupBy("trail", "surface").agg(F.sum("len").alias("len")).groupBy("trail").agg(F.max_by("surface", F.struct("len", "surface")).alias("surface"))
    lit = F.when(F.count("lit") == 0, None).when(F.bool_and(F.col("lit") == "yes"), "yes").when(F.bool_and(F.col("lit") == "no"), "no").otherwise("partial")
    return g.groupBy("trail").agg(lit.alias("lit"), F.min_by(F.coalesce("surface", F.lit("-")), "fid").alias("first_surface")).join(most, "trail", "left").select("trail", "surface", "lit", "first_surface")


def bodies(spark, d) -> DataFrame:
    """Map responses as JSON, one for each 50 places: points, ways with a middle, ways with geometry alone, and elements without a place."""
    p = spots(spark, d).withColumn("way", F.col("k") % 4 != 0)
    tag_text = F.concat(F.lit('{"name":"'), F.when(F.col("k") % 10 == 0, F.concat(F.lit("n"), F.col("k"))).otherwise(F.col("name")), F.lit('","layer":'), F.col("k").cast("string"), F.when(F.col("k") % 3 == 0, ',"tourism":"viewpoint"').otherwise(""), F.when(F.col("k") % 5 == 0, ',"wikidata":"Q1"').otherwise(""), F.lit("}"))
    at = F.concat(F.lit('"lat":'), F.col("lat").cast("string"), F.lit(',"lon":'), F.col("lon").cast("string"))
    place = F.when(F.col("k") % 4 == 0, at).when(F.col("k") % 4 == 1, F.concat(F.lit('"center":{'), at, F.lit("}"))).when(F.col("k") % 4 == 2, F.concat(F.lit('"geometry":[{'), at, F.lit("},{"), at, F.lit("}]"))).otherwise('"bounds":1')
    element = F.concat(F.lit('{"type":"'), F.when(F.col("way"), "way").otherwise("node"), F.lit('","id":'), F.col("k").cast("string"), F.lit(","), place, F.lit(',"tags":'), tag_text, F.lit("}"))
    return p.groupBy(F.expr("k div 50").alias("tile")).agg(F.concat(F.lit('{"elements":['), F.concat_ws(",", F.collect_list(element)), F.lit("]}")).alias("body"))


@query(f"{ctes('spots')} select concat(case when k % 4 = 0 then 'n' else 'w' end, k) as id, round(lat, 7) as lat, round(lon, 7) as lon, case when k % 10 <> 0 then name end as name, 1 + case when k % 3 = 0 then 1 else 0 end as n_tags from spots where k % 4 <> 3")
def a01_features(spark, d):
    """Features of map responses: three ways to have a place, a name that is an id, a tag that is a number."""
    f = osm.features(bodies(spark, d))
    return f.select("id", F.round("point.lat", 7).alias("lat"), F.round("point.lon", 7).alias("lon"), "name", (F.size("tags") - F.map_contains_key("tags", "wikidata").cast("int")).alias("n_tags"))


@query(f"{ctes('spots')} select concat(case when k % 4 = 0 then 'n' else 'w' end, k) as id, case when k % 10 = 0 then concat('n', k) else name end as name, 1 + 2 * cast(k % 5 = 0 as int) + cast(k % 3 = 0 as int) as score from spots where k % 4 in (0, 1)")
def a02_candidates(spark, d):
    return osm.candidates(bodies(spark, d)).select("id", "name", "score")


@query(f"{ctes('way_points')}, p as (select way_id, i, round(lat, 2) as lat, round(lon, 2) as lon from way_points), q as (select *, lag(lat) over w as a, lag(lon) over w as o from p window w as (partition by way_id order by i)) select way_id, count(*) filter (where a is null or a <> lat or o <> lon) as n from q group by way_id having count(*) filter (where a is null or a <> lat or o <> lon) >= 2")
def a03_raw_ways(spark, d):
    """Ways without points equal to the one before; single points are none."""
    p = way_points(spark, d).groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.round("lat", 2).alias("lat"), F.round("lon", 2).alias("lon")))), lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("pts"))
    return p.select("way_id", F.size(osm.thinned(F.col("pts"))).cast("bigint").alias("n")).where("n >= 2")


@query(f"{ctes('places', 'spots')}, a as (select k as id, lat, name from places), b as (select k as id, lat + 1 as lat, name from spots) select coalesce(a.id, b.id) as id, round(case when a.id is not null and a.id % 3 <> 0 then a.lat else coalesce(b.lat, a.lat) end, 7) as lat, case when a.id is null then b.name else a.name end as name from a full join b on a.id = b.id")
def c03_merge_by_id(spark, d):
    """Outer union: the later list fills what is missing, here for every third id."""
    a = places(spark, d).select(F.col("k").alias("id"), "lat", "name")
    b = spots(spark, d).select(F.col("k").alias("id"), (F.col("lat") + 1).alias("lat"), "name")
    m = J.merge_by_id(a, b, "id", F.col("a.id") % 3 == 0, "lat")
    return m.select("id", F.round("lat", 7).alias("lat"), "name")


@query(f"{ctes('places', 'spots')}, u as (select 0 as list, id, name, lat from places union all select 1, id, name, lat from spots), r as (select *, row_number() over (partition by id order by list) as n from u) select id, name, round(lat, 7) as lat from r where n = 1")
def j05_first_wins(spark, d):
    u = places(spark, d).select(F.lit(0).alias("list"), "id", "name", "lat").unionByName(spots(spark, d).select(F.lit(1).alias("list"), "id", "name", "lat"))
    return u.groupBy("id").agg(F.min_by(F.struct("name", "lat"), "list").alias("x")).select("id", "x.name", F.round("x.lat", 7).alias("lat"))


@query("select p_brand, list(distinct lower(p_type) order by lower(p_type)) as selectors from part where p_size < 10 group by p_brand")
def j02_union_of_selectors(spark, d):
    return table(spark, d, "part").where("p_size < 10").groupBy("p_brand").agg(F.array_sort(F.collect_set(F.lower("p_type"))).alias("selectors"))


@query(f"{ctes('places', 'spots')} select name from (select k, name from places union all select k, name from spots)")
def j01_union_all(spark, d):
    return places(spark, d).select("name").unionByName(spots(spark, d).select("name"))


@query(f"{T} select fid, concat(coalesce('bicycle=' || bicycle || ',', ''), coalesce('foot=' || foot || ',', ''), 'highway=', highway) as evidence, coalesce(surface, bicycle, '-') as first_value from tagged where coalesce(bicycle, '') <> 'yes'")
def k06_tag_texts(spark, d):
    """Tags as sorted evidence, and the first value by priority."""
    t = F.col("tags")
    pairs = F.array_sort(F.array_compact(F.array(*(F.when(t[k].isNotNull(), F.concat(F.lit(f"{k}="), t[k])) for k in ("highway", "foot", "bicycle")))))
    return tagged(spark, d).where(F.coalesce(t["bicycle"], F.lit("")) != "yes").select("fid", F.concat_ws(",", pairs).alias("evidence"), F.coalesce(text.first_of(t, ["surface", "bicycle"]), F.lit("-")).alias("first_value"))
