"""Text rules as Column expressions: tags, distances and times in words, identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Surfaces that count as rough, highways that do without a surface, hardness of mountain paths in order.
UNPAVED = ["dirt", "ground", "unpaved", "grass", "sand", "gravel", "mud", "earth", "fine_gravel", "pebblestone", "woodchips", "compacted"]
UNMARKED = ["path", "track", "bridleway"]
SAC_SCALE = ["hiking", "mountain_hiking", "demanding_mountain_hiking", "alpine_hiking", "demanding_alpine_hiking", "difficult_alpine_hiking"]
CAR_WAYS = ["residential", "living_street", "service", "unclassified", "tertiary", "secondary"]
SECTORS = ["north", "north-east", "east", "south-east", "south", "south-west", "west", "north-west"]
IMPERIAL = ["US", "GB", "LR", "MM"]
FOOT, BIKE, CAR, SIDE = 1, 2, 4, 8


def parts(value: Column) -> Column:
    """The trimmed parts of a tag with several values."""
    return F.transform(F.split(value, ";"), lambda x: F.trim(x))


def tag_holds(value: Column, wanted: list[str]) -> Column:
    """The tag is there and one of its parts is wanted; `*` takes any."""
    some = F.lit(True) if wanted == ["*"] else F.arrays_overlap(parts(value), F.array(*map(F.lit, wanted)))
    return value.isNotNull() & F.coalesce(some, F.lit(False))


def matches_kind(tags: Column, any_of: list[list[tuple[str, list[str]]]], none_of: list[tuple[str, list[str]]] = (), name: Column | None = None) -> Column:
    """A kind's predicate in disjunctive form: no excluded tag, a name where one is asked for, and one group whose tags all hold."""
    every = lambda group: reduce(lambda a, b: a & b, (tag_holds(tags[k], v) for k, v in group), F.lit(True))
    one = reduce(lambda a, b: a | b, (every(g) for g in any_of), F.lit(False))
    barred = reduce(lambda a, b: a | b, (tag_holds(tags[k], v) for k, v in none_of), F.lit(False))
    return one & ~barred & (name.isNotNull() if name is not None else F.lit(True))


def is_rough(tags: Column) -> Column:
    highway, surface = tags["highway"], tags["surface"]
    return F.coalesce(tags["rough"] == "yes", F.lit(False)) | F.coalesce(highway == "steps", F.lit(False)) | F.when(surface.isNotNull(), F.exists(parts(surface), lambda v: v.isin(UNPAVED))).otherwise(F.coalesce(highway.isin(UNMARKED), F.lit(False)))


def is_side(tags: Column) -> Column:
    return F.coalesce(tags["footway"].isin("sidewalk", "crossing"), F.lit(False)) | F.coalesce(tags["highway"] == "crossing", F.lit(False))


def way_class(tags: Column) -> Column:
    """Who may use a way, as bits."""
    barred = lambda k: F.coalesce(tags[k].isin("no", "private", "use_sidepath"), F.lit(False))
    hw = F.coalesce(tags["highway"], F.lit(""))
    bike_ok = F.coalesce(tags["bicycle"].isin("yes", "designated", "permissive"), F.lit(False))
    bike = F.when(hw == "steps", 0).when(hw.isin("footway", "pedestrian") & ~bike_ok, 0).when(barred("bicycle"), 0).otherwise(BIKE)
    closed = reduce(lambda a, b: a | b, (F.coalesce(tags[k].isin("no", "private"), F.lit(False)) for k in ("motor_vehicle", "motorcar", "vehicle")))
    car = F.when(hw.isin(CAR_WAYS) & ~closed, CAR).otherwise(0)
    return F.when(barred("foot"), 0).otherwise(FOOT) + bike + car + F.when(is_side(tags), SIDE).otherwise(0)


def clock(seconds: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("bigint"), (seconds % 60).cast("bigint"))


def humanized(x: Column) -> Column:
    y = F.replace(x, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(y, 1, 1)), F.substring(y, F.lit(2), F.length(y)))


def safe_id(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9_-]", "")


def compass_word(bearing: Column) -> Column:
    return F.get(F.array(*map(F.lit, SECTORS)), (F.floor((bearing + 22.5) / 45).cast("int")) % 8)


def first_of(tags: Column, keys: list[str]) -> Column:
    """The first value by the keys' order that is neither missing, empty nor `yes`."""
    values = F.array(*(tags[k] for k in keys))
    return F.get(F.filter(values, lambda v: v.isNotNull() & (v != "") & (v != "yes")), F.lit(0))


def locale_number(x: Column) -> Column:
    """A number with grouped commas or with a decimal comma."""
    grouped = x.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$")
    return F.when(grouped, F.replace(x, F.lit(","), F.lit(""))).otherwise(F.replace(x, F.lit(","), F.lit("."))).try_cast("double")


def fnv1a64(x: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as 16 hexadecimal digits, in decimals: Spark has no unsigned numbers."""
    two64, prime = F.lit("18446744073709551616").cast("decimal(38,0)"), F.lit("1099511628211").cast("decimal(13,0)")
    half = F.lit(4294967296).cast("decimal(20,0)")

    def step(h: Column, byte: Column) -> Column:
        low = F.conv(F.hex((h % 256).cast("bigint").bitwiseXOR(byte)), 16, 10).cast("decimal(20,0)")
        y = (h - h % 256 + low).cast("decimal(20,0)")
        hi, lo = F.floor(y / half).cast("decimal(20,0)"), (y % half).cast("decimal(20,0)")
        top = ((hi * prime).cast("decimal(38,0)") % half * half).cast("decimal(38,0)")
        return ((top + (lo * prime).cast("decimal(38,0)")).cast("decimal(38,0)") % two64).cast("decimal(20,0)")

    hexed = F.hex(F.encode(x, "UTF-8"))
    bytes_ = F.when(F.length(hexed) > 0, F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)), lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    h = F.aggregate(bytes_, F.lit("14695981039346656037").cast("decimal(20,0)"), step)
    return F.lpad(F.lower(F.conv(h.cast("string"), 10, 16)), 16, "0")
