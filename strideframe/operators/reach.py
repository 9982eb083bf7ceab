"""What can be reached by collecting: a fixpoint over several kinds of items, and rewards placed so that it reaches everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideframe.operators.graph import _written


def reached(locations: DataFrame, needs: DataFrame, key: str, location: str = "location_id", reward: str = "reward", rounds: int = 1000) -> DataFrame:
    """(key, location, round): the locations of each key that open, and the round in which they do.

    needs: (key, location, item, n), as many of the item as must have been collected before; a location without needs is open
    from the start. An open location gives its reward (null: nothing). A round joins only the items that have just grown with
    the needs they newly meet, and what is collected and what is still missing last from round to round as written tables.
    Repeated locations and needs count once; of needs for one item the largest counts; needs of unknown locations are ignored.
    """
    at = [key, location]
    locs = _written(locations.select(*at, F.col(reward).alias("item")).dropDuplicates(at), "reach-locations")
    wanted = needs.where("n > 0").groupBy(*at, "item").agg(F.max("n").alias("n"))
    wanted = _written(wanted.join(locs.select(*at), at, "left_semi"), "reach-needs")
    missing = wanted.groupBy(*at).agg(F.count("*").alias("left"))
    opened = _written(locs.join(missing.select(*at), at, "left_anti").select(*at, "item", F.lit(0).alias("round")), "reach-opened")
    missing = _written(missing, "reach-missing")
    parts, have, new = [opened], None, opened
    for k in range(1, rounds + 1):
        gained = new.where("item is not null").groupBy(key, "item").agg(F.count("*").alias("more"))
        grown = gained.withColumn("was", F.lit(0).cast("bigint")) if have is None else gained.join(have.withColumnRenamed("have", "was"), [key, "item"], "left").withColumn("was", F.coalesce("was", F.lit(0)))
        grown = _written(grown.withColumn("have", F.col("was") + F.col("more")), "reach-grown")
        met = wanted.join(grown, [key, "item"]).where("was < n and n <= have").groupBy(*at).agg(F.count("*").alias("met"))
        missing = _written(missing.join(met, at, "left").select(*at, (F.col("left") - F.coalesce("met", F.lit(0))).alias("left"), F.col("met").isNotNull().alias("touched")), "reach-missing")
        new = _written(missing.where("touched and left = 0").join(locs, at).select(*at, "item", F.lit(k).alias("round")), "reach-opened")
        if new.isEmpty():
            break
        parts.append(new)
        missing = missing.where("left > 0").drop("touched")
        own = grown.select(key, "item", "have")
        have = _written(own if have is None else have.join(own.select(key, "item"), [key, "item"], "left_anti").unionByName(own), "reach-have")
    else:
        raise RuntimeError(f"locations were still opening after {rounds} rounds")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*at, "round")


def beatable(locations: DataFrame, needs: DataFrame, key: str, **how) -> DataFrame:
    """(key, opened, total, rounds, beatable) of each key."""
    location = how.get("location", "location_id")
    open_ = reached(locations, needs, key, **how).groupBy(key).agg(F.count("*").alias("opened"), F.max("round").cast("bigint").alias("rounds"))
    every = locations.groupBy(key).agg(F.count_distinct(location).alias("total"))
    out = every.join(open_, key, "left").select(key, F.coalesce("opened", F.lit(0)).alias("opened"), "total", F.coalesce("rounds", F.lit(0)).alias("rounds"))
    return out.withColumn("beatable", F.col("opened") == F.col("total"))


def place_rewards(locations: DataFrame, items: DataFrame, key: str, order: str, location: str = "location_id") -> DataFrame:
    """(key, item_no, item, location): unlock items, each in a location of a zone below the one that needs it (null: no room).

    locations: (key, location, zone, holds), of which only those that hold take items; items: (key, item_no, item, zone), the zone
    that needs the item. Items in order of their zones take the locations in order of theirs (then by `order`), one each: if any
    placing works, this does, since the n-th item finds n locations that come before its zone, and no sorted one is skipped.
    """
    spots = locations.where("holds").select(key, F.col(location).alias("_sf_at"), F.col("zone").alias("_sf_zone"), F.row_number().over(Window.partitionBy(key).orderBy("zone", order, location)).alias("_sf_i"))
    ranked = items.withColumn("_sf_i", F.row_number().over(Window.partitionBy(key).orderBy("zone", "item_no")))
    fits = F.when(F.col("_sf_zone") < F.col("zone"), F.col("_sf_at"))
    return ranked.join(spots, [key, "_sf_i"], "left").select(key, "item_no", "item", fits.alias(location))
