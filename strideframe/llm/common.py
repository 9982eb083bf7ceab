"""Helpers that the training-data operators share: text columns, scratch tables and joins that hold against hot keys."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: [\x20\x09-\x0D]
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone. Pure ASCII strings take the fast path, on which lower() does the same."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo modulus, is remainder; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; only where none is named and Spark is one process (tests) a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-strideframe-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/strideframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def semi_join_hot(rows: DataFrame, wanted: DataFrame, keys: list[str], weight: str, heavy_rows: int = 1024) -> DataFrame:
    """rows whose keys are in wanted, which holds each key once and in `weight` how many rows it has.

    The heavy_rows keys of largest weight (never more, whatever the data) are broadcast, so that their rows aren't
    shuffled; any other key has at most 1/heavy_rows of all rows and goes through a shuffled join.
    """
    heavy = F.broadcast(wanted.orderBy(F.col(weight).desc(), *keys).limit(heavy_rows).select(*keys))
    rest = wanted.select(*keys).join(heavy, keys, "left_anti")
    return rows.join(heavy, keys, "left_semi").unionByName(rows.join(heavy, keys, "left_anti").join(rest, keys, "left_semi"))


def lookup_hot(rows: DataFrame, looked: DataFrame, keys: list[str], weight: str, heavy_rows: int = 1024) -> DataFrame:
    """rows with the columns of looked, which holds each of their keys once; hot keys as in semi_join_hot."""
    heavy = looked.orderBy(F.col(weight).desc(), *keys).limit(heavy_rows)
    only = F.broadcast(heavy.select(*keys))
    rest = looked.join(only, keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(rows.join(only, keys, "left_anti").join(rest, keys))
