"""Joins by distance and by time, as equi-joins on grid cells and time buckets with a residual condition.

No join here needs all pairs: the smaller side's rows go to the cells they can reach, and the cell is the join key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideframe.functions import geo


def _height(cell_m):
    return cell_m / geo.M_PER_DEG * 1.001


def _columns(row: Column, height: float) -> Column:
    """How many cells a row of them has round the earth: at least as wide as high where the row is nearest to a pole."""
    far = F.least(F.lit(90.0), F.greatest(F.abs(row * height), F.abs((row + 1) * height)))
    return F.greatest(F.lit(1.0), F.floor(360.0 * F.cos(F.radians(far)) / height))


def _column(lon: Column, columns: Column) -> Column:
    return F.floor((lon + 180.0) / 360.0 * columns)


def cell_of(rows: DataFrame, radius_m: float | Column, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """rows plus their cell (_sf_i, _sf_j): as high as the radius and, in each row of cells, about as wide."""
    height = _height(radius_m)
    i = F.floor(F.col(lat) / height)
    return rows.withColumn("_sf_i", i).withColumn("_sf_j", F.pmod(_column(F.col(lon), _columns(F.col("_sf_i"), height)), _columns(F.col("_sf_i"), height)).cast("bigint"))


def cells_in_reach(rows: DataFrame, radius_m: float | Column, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """rows once for each cell (_sf_i, _sf_j) that a point within radius_m may have."""
    height = _height(radius_m)
    at, lo = F.col(lat), F.col(lon)
    row = F.floor(at / height)
    out = rows.withColumn("_sf_i", F.explode(F.sequence(row - 1, row + 1)))
    # How far in longitude the radius reaches from that latitude; all round where a pole is within it.
    sine = F.sin(F.least(F.lit(math.pi / 2), F.lit(radius_m) / geo.EARTH_RADIUS_M)) * 1.001 / F.greatest(F.lit(1e-12), F.cos(F.radians(at)))
    n = _columns(F.col("_sf_i"), height)
    reach = F.when(sine >= 1.0, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), sine))))
    columns = F.when(reach * 2 >= 360.0 * (1 - 2 / n), F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.transform(F.sequence(_column(lo - reach, n).cast("bigint"), _column(lo + reach, n).cast("bigint")), lambda c: F.pmod(c, n.cast("bigint"))))
    return out.withColumn("_sf_j", F.explode(columns))


def radius_join(left: DataFrame, right: DataFrame, radius_m: float, min_m: float = 0.0, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Pairs at most radius_m (and at least min_m) apart: left's columns, right's with the prefix r_, and dist_m.

    Cells are as high as the radius and, in each row, about as wide, so that pairs are found at any latitude and across
    longitude 180. Rows without coordinates have no pairs.
    """
    a = cell_of(left, radius_m, lat, lon)
    b = cells_in_reach(right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)), radius_m, f"r_{lat}", f"r_{lon}")
    # From an array of one, so that the distance is computed once a pair and not again in the filter (see segment_join).
    pairs = a.join(b, ["_sf_i", "_sf_j"]).withColumn("dist_m", F.explode(F.array(geo.distance_m(lat, lon, f"r_{lat}", f"r_{lon}"))))
    return pairs.where((F.col("dist_m") <= radius_m) & (F.col("dist_m") >= min_m)).drop("_sf_i", "_sf_j")


def without_near(left: DataFrame, right: DataFrame, radius_m: float, by: list[str]) -> DataFrame:
    """left's rows with no row of right of the same `by` (nulls are equal) nearer than radius_m.

    An anti join on key and cell: no pairs come out, however many rows of right are near. Rows of either side without
    coordinates are near nothing.
    """
    if radius_m <= 0:
        return left
    b = right.select(*(F.col(k).alias(f"_sf_r_{k}") for k in by), F.col("lat").alias("_sf_lat"), F.col("lon").alias("_sf_lon")).where("_sf_lat is not null and _sf_lon is not null").distinct()
    b = cells_in_reach(b, radius_m, "_sf_lat", "_sf_lon").withColumnsRenamed({"_sf_i": "_sf_ri", "_sf_j": "_sf_rj"})
    same = (F.col("_sf_i") == F.col("_sf_ri")) & (F.col("_sf_j") == F.col("_sf_rj"))
    for k in by:
        same &= F.col(k).eqNullSafe(F.col(f"_sf_r_{k}"))
    return cell_of(left, radius_m).join(b, same & (geo.distance_m("lat", "lon", "_sf_lat", "_sf_lon") < radius_m), "left_anti").drop("_sf_i", "_sf_j")


def nearest(pairs: DataFrame, keys: list[str], k: int = 1, tie: str = "r_id") -> DataFrame:
    """The k nearest of each key, ties by id: partial in each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy("dist_m", tie)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _levels(radius_m: float) -> list[float]:
    """The radius, half of it and so on, down to about a metre."""
    out = [radius_m]
    while out[-1] > 2 and len(out) < 12:
        out.append(out[-1] / 2)
    return out


def _at_levels(rows: DataFrame, levels: list[float], lat: str, lon: str) -> DataFrame:
    """rows once for each level, with their cell of that level."""
    each = rows.withColumn("_sf_level", F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1))))
    return cell_of(each, F.get(F.array(*map(F.lit, levels)), F.col("_sf_level")), lat, lon)


def _bounded(left: DataFrame, placed: DataFrame, levels: list[float], k: int, by: list[str], lat: str, lon: str) -> DataFrame:
    """left plus _sf_bound: k rows of placed at least are within so many metres (null: not known).

    A cell with k rows bounds the distance by its own rows' extent, wherever in the cell a row of left is: along the meridian,
    then along the row's own parallel. The least bound of all levels counts. Positions are looked up once each.
    """
    cell = ["_sf_level", "_sf_i", "_sf_j", *by]
    full = placed.groupBy(*cell).agg(F.count("*").alias("_sf_n"), *(f(c).alias(f"_sf_{n}_{x}") for c, x in ((lat, "lat"), (lon, "lon")) for f, n in ((F.min, "lo"), (F.max, "hi")))).where(F.col("_sf_n") >= k)
    at = _at_levels(left.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(lat, lon, *by).distinct(), levels, lat, lon)
    off = lambda c, x: F.greatest(F.abs(F.col(f"_sf_lo_{x}") - F.col(c)), F.abs(F.col(f"_sf_hi_{x}") - F.col(c)))
    bound = (off(lat, "lat") + off(lon, "lon") * F.cos(F.radians(lat))) * (math.pi / 180 * geo.EARTH_RADIUS_M * (1 + 1e-9)) + 1e-6
    known = at.join(full, cell).groupBy(lat, lon, *by).agg(F.min(bound).alias("_sf_bound"))
    return left.join(known, [lat, lon, *by], "left").select(*left.columns, "_sf_bound")


def nearest_within(left: DataFrame, right: DataFrame, radius_m: float, keys: list[str], k: int = 1, tie: str = "id", by: list[str] = [], lat: str = "lat", lon: str = "lon") -> DataFrame:  # noqa: B006
    """nearest(radius_join(left, right, radius_m), keys, k, r_tie) without its pairs; by: columns that are equal on both sides.

    Cells of half, a quarter and so on of the radius say how near k rows are at most, so that each row of left is joined at the
    finest level that holds its k nearest: pairs are some dozens a row, however dense right is. Of right's rows on one spot the
    first k count.
    """
    levels = _levels(radius_m)
    spot = Window.partitionBy(lat, lon, *by).orderBy(tie)
    own = right.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("_sf_n", F.row_number().over(spot)).where(F.col("_sf_n") <= k).drop("_sf_n")
    placed = _at_levels(own, levels, lat, lon)
    a = _bounded(left, placed, levels, k, by, lat, lon)
    level = F.lit(0)
    for i, r in enumerate(levels):
        level = F.when(F.col("_sf_bound") <= r, i).otherwise(level)
    a = a.withColumn("_sf_level", level)
    a = cells_in_reach(a, F.get(F.array(*map(F.lit, levels)), F.col("_sf_level")), lat, lon)
    b = placed.select("_sf_level", "_sf_i", "_sf_j", *by, *(F.col(c).alias(f"r_{c}") for c in right.columns))
    pairs = a.join(b, ["_sf_level", "_sf_i", "_sf_j", *by]).withColumn("dist_m", F.explode(F.array(geo.distance_m(lat, lon, f"r_{lat}", f"r_{lon}"))))
    pairs = pairs.where(F.col("dist_m") <= F.least(F.lit(float(radius_m)), F.col("_sf_bound")))
    return nearest(pairs.select(*left.columns, *(f"r_{c}" for c in right.columns), "dist_m"), keys, k, f"r_{tie}")


def with_near(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """left's rows with a row of right within radius_m: most are known by a row in their own cell; the others are looked up."""
    levels = _levels(radius_m)
    spots = right.where("lat is not null and lon is not null").select("lat", "lon").distinct()
    a = _bounded(left, _at_levels(spots, levels, "lat", "lon"), levels, 1, [], "lat", "lon")
    known = F.coalesce(F.col("_sf_bound") <= radius_m, F.lit(False))
    b = cells_in_reach(spots.select(F.col("lat").alias("_sf_lat"), F.col("lon").alias("_sf_lon")), radius_m, "_sf_lat", "_sf_lon").withColumnsRenamed({"_sf_i": "_sf_ri", "_sf_j": "_sf_rj"})
    near = (F.col("_sf_i") == F.col("_sf_ri")) & (F.col("_sf_j") == F.col("_sf_rj")) & (geo.distance_m("lat", "lon", "_sf_lat", "_sf_lon") <= radius_m)
    rest = cell_of(a.where(~known), radius_m).join(b, near, "left_semi")
    return a.where(known).select(*left.columns).unionByName(rest.select(*left.columns))


def segment_join(points: DataFrame, segments: DataFrame, radius_m: float, cell_m: float = 250.0) -> DataFrame:
    """points x segments (seg, a_lat, a_lon, b_lat, b_lon) within radius_m; plus dist_m.

    A point has one cell; a segment goes to the cells that it comes within the radius of, row by row. cell_m: about a tenth of
    the length of a segment keeps both the cells and the pairs few. Cells widen with the latitude and wrap at longitude 180.

    What belongs to one side alone (the scale at the point, the segment's extent) is computed before the join, so that a pair
    costs a few products, once.
    """
    height = _height(max(cell_m, radius_m))
    margin = _height(radius_m)
    row = lambda c: F.floor(c / height)
    # The second end's longitude goes on from the first one's.
    ends = segments.withColumn("_sf_b", geo.unwrap_lon("b_lon", "a_lon"))
    a_lat, b_lat, a_lon, b_lon = map(F.col, ("a_lat", "b_lat", "a_lon", "_sf_b"))
    rows = ends.withColumn("_sf_i", F.explode(F.sequence(row(F.least(a_lat, b_lat) - margin), row(F.greatest(a_lat, b_lat) + margin))))
    # The part of the segment that is within the radius of a row of cells says which columns can be near.
    share = lambda lat: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (lat - a_lat) / F.nullif(b_lat - a_lat, F.lit(0.0))))
    at = lambda t: a_lon + (b_lon - a_lon) * t
    t1, t2 = (F.when(a_lat == b_lat, whole).otherwise(share(edge)) for whole, edge in ((0.0, F.col("_sf_i") * height - margin), (1.0, (F.col("_sf_i") + 1) * height + margin)))
    wide = margin / F.greatest(F.lit(1e-6), F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(a_lat), F.abs(b_lat)) + margin))))
    spans = rows.withColumn("_sf_n", _columns(F.col("_sf_i"), height).cast("bigint")).withColumn("_sf_from", at(t1)).withColumn("_sf_to", at(t2)).withColumn("_sf_wide", wide)
    spans = spans.withColumn("_sf_lo", _column(F.least("_sf_from", "_sf_to") - F.col("_sf_wide"), F.col("_sf_n")).cast("bigint"))
    spans = spans.withColumn("_sf_hi", _column(F.greatest("_sf_from", "_sf_to") + F.col("_sf_wide"), F.col("_sf_n")).cast("bigint")).drop("_sf_from", "_sf_to", "_sf_wide")
    whole_row = F.col("_sf_hi") - F.col("_sf_lo") >= F.col("_sf_n") - 1
    cells = spans.withColumn("_sf_j", F.explode(F.sequence(F.when(whole_row, 0).otherwise(F.col("_sf_lo")), F.when(whole_row, F.col("_sf_n") - 1).otherwise(F.col("_sf_hi")))))
    cells = cells.withColumn("_sf_j", F.pmod("_sf_j", "_sf_n")).drop("_sf_n", "_sf_lo", "_sf_hi", "_sf_b")
    cells = cells.withColumn("_sf_dx", geo.unwrap_lon("b_lon", "a_lon") - F.col("a_lon")).withColumn("_sf_dy", F.col("b_lat") - F.col("a_lat"))
    placed = points.withColumn("_sf_i", row(F.col("lat"))).withColumn("_sf_j", F.pmod(_column(F.col("lon"), _columns(F.col("_sf_i"), height)), _columns(F.col("_sf_i"), height)).cast("bigint"))
    placed = placed.withColumn("_sf_k", geo.M_PER_DEG * F.cos(F.radians("lat")))
    return _metres(placed.join(cells, ["_sf_i", "_sf_j"])).where(F.col("dist_m") <= radius_m).select(*points.columns, *segments.columns, "dist_m")


def segment_metres(pairs: DataFrame) -> DataFrame:
    """pairs (lat, lon, a_lat, a_lon, b_lat, b_lon) plus dist_m, as segment_join computes it."""
    sides = pairs.withColumn("_sf_dx", geo.unwrap_lon("b_lon", "a_lon") - F.col("a_lon")).withColumn("_sf_dy", F.col("b_lat") - F.col("a_lat"))
    return _metres(sides.withColumn("_sf_k", geo.M_PER_DEG * F.cos(F.radians("lat"))))


def _metres(pairs: DataFrame) -> DataFrame:
    # Each step is a projection of its own, read once by the next.
    lon = F.col("a_lon") - F.col("lon")
    lon = F.when(F.abs(lon) <= 180.0, lon).otherwise(geo.unwrap_lon("a_lon", "lon") - F.col("lon"))
    steps = pairs.select(*pairs.columns, (lon * F.col("_sf_k")).alias("_sf_x"), ((F.col("a_lat") - F.col("lat")) * geo.M_PER_DEG).alias("_sf_y"), (F.col("_sf_dx") * F.col("_sf_k")).alias("_sf_u"), (F.col("_sf_dy") * geo.M_PER_DEG).alias("_sf_v"))
    x, y, u, v = (F.col(f"_sf_{c}") for c in "xyuv")
    steps = steps.withColumn("_sf_t", F.when(u * u + v * v == 0.0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x * u + y * v) / F.nullif(u * u + v * v, F.lit(0.0))))))
    steps = steps.withColumn("_sf_ex", x + F.col("_sf_t") * u).withColumn("_sf_ey", y + F.col("_sf_t") * v)
    # From an array of one, so that the filter stays behind: moved into the join it would spell out the whole formula, too long to be compiled.
    steps = steps.withColumn("dist_m", F.explode(F.array(F.sqrt(F.col("_sf_ex") * F.col("_sf_ex") + F.col("_sf_ey") * F.col("_sf_ey")))))
    return steps


def polygon_join(points: DataFrame, areas: DataFrame, ring: str = "ring") -> DataFrame:
    """points x areas that hold them, by cells: areas go to those of their box. Boxes must not cross longitude 180.

    Cells are tiles, or a half, a quarter and so on of them, so that a box has few and a small one no large cell's points; points
    go to one cell of each size that areas have.
    """
    edge = lambda of, f: of(F.transform(ring, lambda p: p[f]))
    box = areas.withColumns({"_sf_s": edge(F.array_min, "lat"), "_sf_n": edge(F.array_max, "lat"), "_sf_w": edge(F.array_min, "lon"), "_sf_e": edge(F.array_max, "lon")})
    size = F.greatest(F.col("_sf_n") - F.col("_sf_s"), F.col("_sf_e") - F.col("_sf_w"))
    finest = 12
    level = F.lit(0)
    for k in range(1, finest + 1):
        level = F.when(size <= geo.TILE_DEG / 2**k, k).otherwise(level)
    box = box.withColumn("_sf_level", level)
    levels = sorted(r[0] for r in box.select("_sf_level").distinct().collect())
    n = F.pow(F.lit(2.0), F.col("_sf_level")) / geo.TILE_DEG
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) * n), F.floor(F.col(b) * n)))
    cells = box.withColumn("_sf_i", span("_sf_s", "_sf_n")).withColumn("_sf_j", span("_sf_w", "_sf_e"))
    placed = points.withColumn("_sf_level", F.explode(F.array(*map(F.lit, levels or [0])))).withColumn("_sf_i", F.floor(F.col("lat") * n)).withColumn("_sf_j", F.floor(F.col("lon") * n))
    pairs = placed.join(cells, ["_sf_level", "_sf_i", "_sf_j"]).where(F.col("lat").between(F.col("_sf_s"), F.col("_sf_n")) & F.col("lon").between(F.col("_sf_w"), F.col("_sf_e")))
    return pairs.where(geo.point_in_polygon("lat", "lon", F.col(ring))).select(*points.columns, *areas.columns)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], t: str, values: list[str], first_before: bool = False) -> DataFrame:
    """left plus right's values (prefix r_) of its last row at or before t, both with columns *keys and t.

    One sort by key and time: the rows are put together and the last value is carried on. first_before: rows of left before
    any of right get right's first row instead of null. Right's rows of equal time are taken by the largest values.
    """
    carry = F.struct(F.col(t).alias("r_t"), *(F.col(v).alias(f"r_{v}") for v in values))
    a = left.withColumn("_sf_left", F.struct(*left.columns)).select(*keys, t, F.lit(1).alias("_sf_side"), "_sf_left").withColumn("_sf_row", F.lit(None).cast(right.select(carry.alias("x")).schema["x"].dataType))
    b = right.select(*keys, t, F.lit(0).alias("_sf_side"), F.lit(None).cast(a.schema["_sf_left"].dataType).alias("_sf_left"), carry.alias("_sf_row"))
    w = Window.partitionBy(*keys).orderBy(t, "_sf_side", "_sf_row")
    row = F.last("_sf_row", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if first_before:
        row = F.coalesce(row, F.first("_sf_row", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return a.unionByName(b).withColumn("_sf_row", row).where("_sf_side = 1").select("_sf_left.*", *(F.col(f"_sf_row.r_{v}") for v in values), F.col("_sf_row.r_t").alias(f"r_{t}"))


def interpolated(left: DataFrame, track: DataFrame, keys: list[str], t: str) -> DataFrame:
    """left plus i_lat, i_lon: the track's position at t, linear between its rows and clamped at its ends."""
    row = F.struct(F.col(t).alias("t"), "lat", "lon")
    a = left.select(*keys, t, F.lit(1).alias("_sf_side"), F.struct(*left.columns).alias("_sf_left"), F.lit(None).cast(track.select(row.alias("x")).schema["x"].dataType).alias("_sf_row"))
    b = track.select(*keys, t, F.lit(0).alias("_sf_side"), F.lit(None).cast(a.schema["_sf_left"].dataType).alias("_sf_left"), row.alias("_sf_row"))
    w = Window.partitionBy(*keys).orderBy(t, "_sf_side", "_sf_row")
    before = F.last("_sf_row", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_sf_row", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = a.unionByName(b).withColumn("p", before).withColumn("n", after).where("_sf_side = 1").withColumn("p", F.coalesce("p", "n")).withColumn("n", F.coalesce("n", "p"))
    f = F.when(F.col("n.t") == F.col("p.t"), 0.0).otherwise((F.col(t) - F.col("p.t")) / F.greatest(F.col("n.t") - F.col("p.t"), F.lit(1)))
    return both.select("_sf_left.*", (F.col("p.lat") + (F.col("n.lat") - F.col("p.lat")) * f).alias("i_lat"), (F.col("p.lon") + (F.col("n.lon") - F.col("p.lon")) * f).alias("i_lon"))


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], t: str, tolerance: int, values: list[str]) -> DataFrame:
    """left inner right's row nearest in time within tolerance (ties: the earlier), by buckets as wide as the tolerance."""
    bucket = F.floor(F.col(t) / tolerance)
    a = left.withColumn("_sf_b", bucket)
    b = right.select(*keys, F.col(t).alias("r_t"), *(F.col(v).alias(f"r_{v}") for v in values), F.explode(F.sequence(bucket - 1, bucket + 1)).alias("_sf_b"))
    pairs = a.join(b, [*keys, "_sf_b"]).where(F.abs(F.col(t) - F.col("r_t")) <= tolerance)
    w = Window.partitionBy(*keys, *(c for c in left.columns if c not in keys)).orderBy(F.abs(F.col(t) - F.col("r_t")), "r_t", *(f"r_{v}" for v in values))
    return pairs.withColumn("_sf_n", F.row_number().over(w)).where("_sf_n = 1").drop("_sf_n", "_sf_b")


def intervals_join(rows: DataFrame, intervals: DataFrame, keys: list[str], t: str, bucket: int) -> DataFrame:
    """rows inrow intervals (from_ms, to_ms) that hold their time, both ends included, by time buckets."""
    spans = intervals.withColumn("_sf_b", F.explode(F.sequence(F.floor(F.col("from_ms") / bucket), F.floor(F.col("to_ms") / bucket))))
    return rows.withColumn("_sf_b", F.floor(F.col(t) / bucket)).join(spans, [*keys, "_sf_b"]).where(F.col(t).between(F.col("from_ms"), F.col("to_ms"))).drop("_sf_b")


def merge_by_id(first: DataFrame, second: DataFrame, key: str, fill: Column, column: str) -> DataFrame:
    """Outer union by id: rows of second only fill `column` of first where `fill` holds, or come in whole."""
    a, b = first.alias("a"), second.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    pick = lambda c: F.when(F.col(f"a.{key}").isNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return joined.select(*(F.when(F.col(f"a.{key}").isNotNull() & ~fill, F.col(f"a.{c}")).otherwise(F.coalesce(f"b.{c}", f"a.{c}")).alias(c) if c == column else pick(c).alias(c) for c in first.columns))
