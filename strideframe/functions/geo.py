"""Geometry on the sphere as Column expressions: they stay inside generated code, so no operator needs a UDF for it.

Points are latitude and longitude in degrees; polylines and rings are arrays of struct<lat, lon>.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
M_PER_DEG = 111_195.0
TILE_DEG = 0.02
EXPLORER_CELL_M = 150.0


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def _sq(x: Column) -> Column:
    return x * x


def distance_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance (haversine)."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    h = _sq(F.sin(F.radians(lat2 - lat1) / 2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * _sq(F.sin(F.radians(lon2 - lon1) / 2))
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(h))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from the first to the second point, in [0, 360)."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))) + 360.0, F.lit(360.0))


def destination(lat, lon, bearing, dist_m) -> Column:
    """struct<lat, lon> reached from a point."""
    lat, lon, bearing, dist_m = map(_c, (lat, lon, bearing, dist_m))
    d, b, lat1 = dist_m / EARTH_RADIUS_M, F.radians(bearing), F.radians(lat)
    lat2 = F.asin(F.sin(lat1) * F.cos(d) + F.cos(lat1) * F.sin(d) * F.cos(b))
    lon2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(lat1), F.cos(d) - F.sin(lat1) * F.sin(lat2))
    return F.struct(F.degrees(lat2).alias("lat"), F.degrees(lon2).alias("lon"))


def unwrap_lon(lon, around) -> Column:
    """The longitude equal to lon within 180 degrees of around."""
    lon, around = _c(lon), _c(around)
    return around + F.pmod(lon - around + 180.0, F.lit(360.0)) - 180.0


def normal_lon(lon) -> Column:
    lon = _c(lon)
    return F.when(lon.between(-180, 180), lon).otherwise(unwrap_lon(lon, 0.0))


def wrap_deg(x) -> Column:
    """An angle in (-180, 180]."""
    return 180.0 - F.pmod(180.0 - _c(x), F.lit(360.0))


def wrap_deg_low(x) -> Column:
    """An angle in [-180, 180): the other rule at the seam."""
    return F.pmod(_c(x) + 180.0, F.lit(360.0)) - 180.0


def _flat(lat, lon, to_lat, to_lon) -> tuple[Column, Column]:
    """East and north metres of the second point from the first, at the first one's scale."""
    return (unwrap_lon(to_lon, lon) - lon) * M_PER_DEG * F.cos(F.radians(lat)), (to_lat - lat) * M_PER_DEG


def _along(lat, lon, a_lat, a_lon, b_lat, b_lon) -> tuple[Column, Column, Column, Column, Column]:
    (ax, ay), (bx, by) = _flat(lat, lon, a_lat, a_lon), _flat(lat, lon, b_lat, b_lon)
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.nullif(len2, F.lit(0.0)))))
    return ax, ay, dx, dy, t


def segment_distance_m(lat, lon, a_lat, a_lon, b_lat, b_lon) -> Column:
    """Distance to a segment on the plane that touches the earth at the point."""
    ax, ay, dx, dy, t = _along(*map(_c, (lat, lon, a_lat, a_lon, b_lat, b_lon)))
    return F.sqrt(_sq(ax + t * dx) + _sq(ay + t * dy))


def closest_on_segment(lat, lon, a_lat, a_lon, b_lat, b_lon) -> Column:
    """struct<lat, lon>, by blending the ends."""
    lat, lon, a_lat, a_lon, b_lat, b_lon = map(_c, (lat, lon, a_lat, a_lon, b_lat, b_lon))
    t = _along(lat, lon, a_lat, a_lon, b_lat, b_lon)[4]
    return F.struct((a_lat + (b_lat - a_lat) * t).alias("lat"), (a_lon + (b_lon - a_lon) * t).alias("lon"))


def point_in_polygon(lat, lon, ring: Column) -> Column:
    """Even-odd rule over an array of vertices; works across longitude 180."""
    lat, lon = _c(lat), _c(lon)
    first = F.get(ring, F.lit(0))["lon"]
    x = unwrap_lon(lon, first)
    n = F.size(ring)

    def crossed(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i - 1 + n, n))
        ax, bx = unwrap_lon(a["lon"], first), unwrap_lon(b["lon"], first)
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (x < (bx - ax) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + ax)

    odd = F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(crossed(i), F.lit(False)))) % 2 == 1
    return F.when(n < 1, False).otherwise(odd)


def centroid(points: Column) -> Column:
    """struct<lat, lon>: the mean of the vertices."""
    n, around = F.greatest(F.size(points), F.lit(1)), F.coalesce(F.get(points, F.lit(0))["lon"], F.lit(0.0))
    mean = lambda f: F.aggregate(points, F.lit(0.0), lambda a, p: a + f(p)) / n
    return F.struct(mean(lambda p: p["lat"]).alias("lat"), normal_lon(mean(lambda p: unwrap_lon(p["lon"], around))).alias("lon"))


def polyline_m(points: Column) -> Column:
    pairs = F.arrays_zip(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))).alias("a"), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))).alias("b"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + distance_m(p["a"]["lat"], p["a"]["lon"], p["b"]["lat"], p["b"]["lon"]))


def densify(points: Column, step_m: float) -> Column:
    """Points at most step_m apart, both ends kept."""

    def piece(i: Column) -> Column:
        a, b = F.get(points, i - 1), F.get(points, i)
        n = F.greatest(F.ceil(distance_m(a["lat"], a["lon"], b["lat"], b["lon"]) / step_m), F.lit(1)).cast("int")
        dlon = unwrap_lon(b["lon"], a["lon"]) - a["lon"]
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((a["lat"] + (b["lat"] - a["lat"]) * (k / n)).alias("lat"), normal_lon(a["lon"] + dlon * (k / n)).alias("lon")))

    whole = F.flatten(F.transform(F.sequence(F.lit(1), F.size(points) - 1), piece))
    return F.when(F.size(points) < 2, points).otherwise(F.concat(whole, F.slice(points, F.size(points), F.lit(1))))


def ring_area_m2(points: Column) -> Column:
    """Shoelace formula on the plane at the first vertex."""
    n, o = F.size(points), F.get(points, F.lit(0))
    x = lambda p: (p["lon"] - o["lon"]) * M_PER_DEG * F.cos(F.radians(o["lat"]))
    y = lambda p: (p["lat"] - o["lat"]) * M_PER_DEG
    cross = lambda s, i: s + x(F.get(points, i)) * y(F.get(points, (i + 1) % n)) - x(F.get(points, (i + 1) % n)) * y(F.get(points, i))
    return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), cross)) / 2


def circle_ring(lat, lon, radius_m, n: int = 32) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: destination(lat, lon, i * (360.0 / n), radius_m))


def tile(lat, lon) -> Column:
    """struct<row, col> on the fixed grid of 0.02 degrees; columns wrap round."""
    cols = int(360 / TILE_DEG)
    return F.struct(F.floor(_c(lat) / TILE_DEG).cast("int").alias("row"), (F.pmod(F.floor(_c(lon) / TILE_DEG) + cols // 2, F.lit(cols)) - cols // 2).cast("int").alias("col"))


def circle_tiles(lat, lon, radius_m, n: int = 720) -> Column:
    """array<struct<row, col>>: the tiles that a round zone's outline passes (n samples), and those whose centre is inside."""
    lat, lon, radius_m = map(_c, (lat, lon, radius_m))
    ring = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: destination(lat, lon, i * (360.0 / n), radius_m))
    flat = F.transform(ring, lambda p: F.struct(F.floor(p["lat"] / TILE_DEG).cast("int").alias("row"), F.floor(unwrap_lon(p["lon"], lon) / TILE_DEG).cast("int").alias("col")))
    edge = F.array_distinct(flat)
    low, high = (lambda f: f(F.transform(edge, lambda t: t["row"]))), (lambda f: f(F.transform(edge, lambda t: t["col"])))
    box = F.flatten(F.transform(F.sequence(low(F.array_min), low(F.array_max)), lambda r: F.transform(F.sequence(high(F.array_min), high(F.array_max)), lambda c: F.struct(r.alias("row"), c.alias("col")))))
    inside = F.filter(box, lambda t: distance_m(lat, lon, (t["row"] + 0.5) * TILE_DEG, (t["col"] + 0.5) * TILE_DEG) <= radius_m)
    cols = int(360 / TILE_DEG)
    return F.array_distinct(F.transform(F.concat(edge, inside), lambda t: F.struct(t["row"].alias("row"), (F.pmod(t["col"] + cols // 2, F.lit(cols)) - cols // 2).cast("int").alias("col"))))


def explorer_cell(lat, lon, size_m: float = EXPLORER_CELL_M) -> Column:
    """struct<i, j>; longitude is scaled at the point's own latitude."""
    lat, lon = _c(lat), _c(lon)
    return F.struct(F.floor(lat * M_PER_DEG / size_m).alias("i"), F.floor(lon * M_PER_DEG * F.cos(F.radians(lat)) / size_m).alias("j"))


def to_enu(lat, lon, lat0, lon0) -> Column:
    """struct<e, n>: metres east and north of an origin."""
    lat, lon, lat0, lon0 = map(_c, (lat, lon, lat0, lon0))
    return F.struct((unwrap_lon(lon, lon0) - lon0).__mul__(M_PER_DEG).__mul__(F.cos(F.radians(lat0))).alias("e"), ((lat - lat0) * M_PER_DEG).alias("n"))


def to_geo(e, n, lat0, lon0) -> Column:
    e, n, lat0, lon0 = map(_c, (e, n, lat0, lon0))
    return F.struct((lat0 + n / M_PER_DEG).alias("lat"), normal_lon(lon0 + e / (M_PER_DEG * F.cos(F.radians(lat0)))).alias("lon"))


def vertex_key(lat, lon, scale: int = 10_000_000) -> Column:
    """struct<y, x> of integers: equal for points that are one vertex."""
    return F.struct(F.round(_c(lat) * scale).cast("bigint").alias("y"), F.round(_c(lon) * scale).cast("bigint").alias("x"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


# Effort: minutes of movement, in tiers of a given width. Metres a minute, detour factor, steps a minute.
M_PER_MIN = {"walk": 75.0, "run": 150.0}
DETOUR = 1.3
STEPS_PER_MIN = {"walk": 100.0, "run": 150.0}


def by_mode(mode, values: dict[str, float]) -> Column:
    return F.when(_c(mode) == "run", values["run"]).otherwise(values["walk"])


def travel_min(dist_m, mode) -> Column:
    return _c(dist_m) * DETOUR / by_mode(mode, M_PER_MIN)


def tier_for(minutes, per_tier) -> Column:
    return F.least(F.greatest(F.ceil(_c(minutes) / _c(per_tier)), F.lit(1)), F.lit(10)).cast("int")


def dist_for(minutes, mode) -> Column:
    return _c(minutes) * by_mode(mode, M_PER_MIN) / DETOUR


def beside(on_lat, on_lon, est_lat, est_lon, walks: Column, road: Column, side_max_m: float = 12.0) -> Column:
    """struct<lat, lon>: on a road a walker is shown at the estimate, at most side_max_m from the point on the road; else on it."""
    on_lat, on_lon, est_lat, est_lon = map(_c, (on_lat, on_lon, est_lat, est_lon))
    on, est = F.struct(on_lat.alias("lat"), on_lon.alias("lon")), F.struct(est_lat.alias("lat"), est_lon.alias("lon"))
    edge = destination(on_lat, on_lon, bearing_deg(on_lat, on_lon, est_lat, est_lon), side_max_m)
    return F.when(~(walks & road), on).when(distance_m(on_lat, on_lon, est_lat, est_lon) <= side_max_m, est).otherwise(edge)


def _let(value: Column, then) -> Column:
    """then(value), with value computed once and not wherever it is read."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def point_inside(ring: Column) -> Column:
    """struct<lat, lon> inside the ring: its centroid, else the first midpoint of two or three vertices that is inside, else the
    first vertex."""

    def other(ring: Column) -> Column:
        n = F.size(ring)
        vertex = lambda i: F.get(ring, F.pmod(i, n))
        of_pairs = lambda step: F.transform(F.sequence(F.lit(0), n - 1), lambda i: centroid(F.array(vertex(i), vertex(i + F.greatest(step, F.lit(1))))))
        of_threes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: centroid(F.array(vertex(i), vertex(i + 1), vertex(i + 2))))
        tried = F.concat(*(of_pairs(F.floor(n / k).cast("int")) for k in (2, 3, 4)), of_pairs(F.lit(1)), of_threes)
        inside = F.filter(tried, lambda p: point_in_polygon(p["lat"], p["lon"], ring))
        return F.coalesce(F.get(inside, F.lit(0)), F.get(ring, F.lit(0)))

    first = lambda r, c: F.when((F.size(r) < 3) | point_in_polygon(c["lat"], c["lon"], r), c).otherwise(other(r))
    return _let(ring, lambda r: _let(centroid(r), lambda c: first(r, c)))


def clip_at_lon(ring: Column, lon: float, east: bool) -> Column:
    """The part of a ring (array of lat, lon; not closed) on one side of a meridian, planar: kept corners, and where edges cross it."""
    kept = lambda p: p["lon"] >= lon if east else p["lon"] <= lon

    def edge(a: Column, i: Column) -> Column:
        b = F.get(ring, (i + 1) % F.size(ring))
        share = (F.lit(lon) - a["lon"]) / (b["lon"] - a["lon"])
        crossing = F.struct((a["lat"] + share * (b["lat"] - a["lat"])).alias("lat"), F.lit(lon).cast("double").alias("lon"))
        return F.array(F.when(kept(a), F.struct(a["lat"].alias("lat"), a["lon"].alias("lon"))), F.when(kept(a) != kept(b), crossing))

    return F.filter(F.flatten(F.transform(ring, edge)), lambda p: p.isNotNull())


def bounding_boxes(ring: Column, around: float) -> Column:
    """array<struct<south, west, north, east>> of a ring around a longitude: one box, or two where it goes over longitude 180."""
    turned = F.transform(ring, lambda p: F.struct(p["lat"].alias("lat"), unwrap_lon(p["lon"], F.lit(around)).alias("lon")))
    box = lambda r, shift: F.struct(F.array_min(r["lat"]).alias("south"), (F.array_min(r["lon"]) + shift).alias("west"), F.array_max(r["lat"]).alias("north"), (F.array_max(r["lon"]) + shift).alias("east"))
    low, high = F.array_min(turned["lon"]), F.array_max(turned["lon"])
    over = lambda at: F.array(box(clip_at_lon(turned, at, False), 0.0 if at > 0 else 360.0), box(clip_at_lon(turned, at, True), -360.0 if at > 0 else 0.0))
    return F.when((low < 180.0) & (high > 180.0), over(180.0)).when((low < -180.0) & (high > -180.0), over(-180.0)).otherwise(F.array(box(turned, 0.0)))


def hex_lattice(south, west, north, east, d_lat: float, d_lon: float) -> Column:
    """array<struct<i, j, lat, lon>> over a box from its south-west corner on; odd rows start half a cell further."""
    rows = F.sequence(F.lit(0), F.floor((_c(north) - _c(south)) / d_lat).cast("int"))
    columns = F.sequence(F.lit(0), F.floor((_c(east) - _c(west)) / d_lon).cast("int"))
    at = lambda i, j: F.struct(i.alias("i"), j.alias("j"), (_c(south) + i * d_lat).alias("lat"), (_c(west) + (j + F.when(i % 2 == 1, 0.5).otherwise(0.0)) * d_lon).alias("lon"))
    return F.flatten(F.transform(rows, lambda i: F.transform(columns, lambda j: at(i, j))))
