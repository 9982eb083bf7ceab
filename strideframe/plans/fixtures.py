"""Projections of the driver's tables with the shapes that the operators take, in Spark and as SQL for the oracle.

Coordinates are arithmetic on ids, not geography.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def t_ms(ts: str = "ts") -> Column:
    """Milliseconds since 1970, whatever the session's time zone: ts has none."""
    return F.floor(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})") / 1000).cast("bigint")


def xy(k: str) -> list[Column]:
    d = lambda x: x.cast("double")
    c = F.col(k)
    return [(F.lit(40.0) + d((c * 7919) % 2003) / 2003.0 * 0.05).alias("lat"), (F.lit(-111.0) + d((c * 104729) % 1999) / 1999.0 * 0.05).alias("lon")]


def journal_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("game"), F.col("event_id").alias("id"), t_ms().alias("t_ms"), F.col("event_type").alias("kind"), F.col("props").alias("detail"), "value")


def fixes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("game"), F.col("event_id").alias("id"), t_ms().alias("t_ms"), *xy("event_id"), (F.lit(1.0) + (F.col("event_id") % 40).cast("double")).alias("accuracy_m"), (F.col("event_id") % 97 == 0).alias("mock"), F.col("value").cast("double").alias("value")
    )


def way_points(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("way_id"), (F.row_number().over(w) - 1).cast("bigint").alias("i"), *xy("l_partkey"))


def places(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), *xy("s_suppkey"))


def spots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), *xy("c_custkey"))


def tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("fid"), F.concat_ws(";", F.lower("p_type"), F.lower("p_brand")).alias("v"), F.col("p_size").cast("bigint").alias("size"))


def slots(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", 10).when(F.col("o_orderpriority") == "2-HIGH", 8).when(F.col("o_orderpriority") == "3-MEDIUM", 5).when(F.col("o_orderpriority") == "4-NOT SPECIFIED", 3).otherwise(1)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("location_id"), F.col("o_custkey").alias("game"), tier.cast("bigint").alias("tier"), F.col("o_totalprice").cast("double").alias("price"))


# The same in DuckDB's SQL.
T_MS = "cast(floor(epoch_us(ts) / 1000.0) as bigint)"


def XY(k: str) -> str:
    return f"cast(40.0 as double) + cast(({k}*7919)%2003 as double)/cast(2003 as double)*cast(0.05 as double) as lat, cast(-111.0 as double) + cast(({k}*104729)%1999 as double)/cast(1999 as double)*cast(0.05 as double) as lon"


SQL = {
    "journal_events": f"select user_id as game, event_id as id, {T_MS} as t_ms, event_type as kind, props as detail, value from events",
    "fixes": f"select user_id as game, event_id as id, {T_MS} as t_ms, {XY('event_id')}, 1.0e0 + cast(event_id%40 as double) as accuracy_m, event_id%97=0 as mock, cast(value as double) as value from events",
    "way_points": f"select l_orderkey as way_id, cast(row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice)-1 as bigint) as i, {XY('l_partkey')} from lineitem",
    "places": f"select concat('n', s_suppkey) as id, s_suppkey as k, s_name as name, {XY('s_suppkey')} from supplier",
    "spots": f"select concat('n', c_custkey) as id, c_custkey as k, c_name as name, {XY('c_custkey')} from customer",
    "tags": "select p_partkey as fid, concat(lower(p_type), ';', lower(p_brand)) as v, cast(p_size as bigint) as size from part",
    "slots": "select o_orderkey as location_id, o_custkey as game, cast(case o_orderpriority when '1-URGENT' then 10 when '2-HIGH' then 8 when '3-MEDIUM' then 5 when '4-NOT SPECIFIED' then 3 else 1 end as bigint) as tier, cast(o_totalprice as double) as price from orders",
}


def ctes(*names: str) -> str:
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names)


def H(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    return f"(2*6371000.0*asin(sqrt(power(sin(radians(({b_lat})-({a_lat}))/2),2)+cos(radians({a_lat}))*cos(radians({b_lat}))*power(sin(radians(({b_lon})-({a_lon}))/2),2))))"


def SEG(lat: str, lon: str, a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    k = f"111195.0*cos(radians({lat}))"
    ax, ay, bx, by = f"(({a_lon})-({lon}))*{k}", f"(({a_lat})-({lat}))*111195.0", f"(({b_lon})-({lon}))*{k}", f"(({b_lat})-({lat}))*111195.0"
    dx, dy = f"(({bx})-({ax}))", f"(({by})-({ay}))"
    t = f"(case when {dx}*{dx}+{dy}*{dy} = 0 then 0.0 else greatest(0.0, least(1.0, -(({ax})*{dx}+({ay})*{dy})/({dx}*{dx}+{dy}*{dy}))) end)"
    return f"sqrt(power({ax}+{t}*{dx},2)+power({ay}+{t}*{dy},2))"
