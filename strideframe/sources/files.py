"""Raw tracks, the journal, and what is written: polylines, GeoJSON, CSV, cached requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions.text import fnv1a64

RAW = "tag string, tf bigint, te bigint, lat double, lon double, acc string, spd double, spd_acc double, brg double, brg_acc double, alt double, valt double, prov string, mock boolean, total bigint, az double, pitch double, roll double, err double, _corrupt_record string"
DAY_S = 86_400


def read_tracks(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """fixes, steps and headings of JSON lines, ordered within themselves by time columns; skipped: lines that are none of them though tagged so.

    Unknown tags are ignored.
    """
    raw = spark.read.schema(RAW).option("mode", "PERMISSIVE").json(path)
    ok = F.col("_corrupt_record").isNull()
    fix = ok & (F.col("tag") == "rawfix") & F.col("tf").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    fixes = raw.where(fix).select(F.col("tf").alias("t_ms"), "lat", "lon", F.coalesce(F.col("acc").try_cast("double"), F.lit(1000.0)).alias("accuracy_m"), "spd", "spd_acc", "brg", "brg_acc", "alt", "valt", F.coalesce("prov", F.lit("other")).alias("provider"), F.coalesce("mock", F.lit(False)).alias("mock"))
    steps = raw.where(ok & (F.col("tag") == "rawsteps")).select(F.col("te").alias("t_ms"), "total")
    level = F.when(F.col("acc").isin("high", "medium", "low"), F.col("acc")).otherwise("unreliable")
    headings = raw.where(ok & (F.col("tag") == "rawhead") & F.col("az").isNotNull()).select(F.col("te").alias("t_ms"), "az", level.alias("accuracy"), F.coalesce("pitch", F.lit(0.0)).alias("pitch"), F.coalesce("roll", F.lit(0.0)).alias("roll"), "err")
    return {"fixes": fixes, "steps": steps, "headings": headings, "skipped": raw.where(~ok | ((F.col("tag") == "rawfix") & ~fix)).select("tag", "_corrupt_record")}


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def delete_key(spark: SparkSession, path: str, to: str, key: str, value) -> None:
    """The table without a key's rows, written anew: Spark's commit makes it visible as a whole."""
    spark.read.parquet(path).where(~F.col(key).eqNullSafe(F.lit(value))).write.mode("overwrite").parquet(to)


def write_once(df: DataFrame, path: str, batch: int) -> None:
    """For foreachBatch: a batch that is run again replaces its own rows alone."""
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def geojson_lines(tracks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(*keys, feature): one LineString feature for each key."""
    line = F.transform(F.array_sort(F.collect_list(F.struct(order, "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    rows = tracks.groupBy(*keys).agg(line.alias("line"))
    return rows.select(*keys, F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*keys).alias("properties"), F.struct(F.lit("LineString").alias("type"), F.col("line").alias("coordinates")).alias("geometry"))).alias("feature"))


def write_csv(rows: DataFrame, path: str) -> None:
    """Degrees with seven decimals."""
    cells = [F.format_string("%.7f", c).alias(c) if c in ("lat", "lon") else F.col(c) for c in rows.columns]
    rows.select(*cells).write.option("header", True).csv(path)


def write_documents(documents: DataFrame, path: str, kind: str) -> None:
    """One JSON line for each row, a folder for each value of `kind`. Kinds that are written replace what was there of them, others
    stay; Spark's commit makes the files visible together."""
    body = F.to_json(F.struct(*(c for c in documents.columns if c != kind)))
    documents.select(kind, body.alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(kind).text(path)


def append_log(rows: DataFrame, path: str, most_rows: int = 1_000_000) -> None:
    """JSON lines added to a log, in files of at most most_rows lines."""
    rows.write.mode("append").option("maxRecordsPerFile", most_rows).json(path)


def request_key(text: Column) -> Column:
    return fnv1a64(text)


def scan_plan(jobs: DataFrame, cache: DataFrame, now_s: int, fresh_days: int = 30) -> DataFrame:
    """(tiles, requests, cached, missing) of jobs (tile, request) against a cache (key, stored_s)."""
    have = cache.where(F.col("stored_s") >= now_s - fresh_days * DAY_S).select("key").distinct().withColumn("hit", F.lit(1))
    return jobs.withColumn("key", request_key(F.col("request"))).join(have, "key", "left").agg(F.count_distinct("tile").alias("tiles"), F.count("*").alias("requests"), F.count("hit").alias("cached"), F.count_if(F.col("hit").isNull()).alias("missing"))


def server_order(servers: DataFrame, start: int, n: int) -> DataFrame:
    """servers (i from 0 to n - 1, health) with place: the healthiest first, equals in turn from start."""
    from pyspark.sql.window import Window

    # A handful of rows.
    return servers.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.greatest(F.lit(-12), F.least(F.lit(6), F.col("health")))), F.pmod(F.col("i") - start, F.lit(n)))))


def run_jobs(jobs: DataFrame, fetch, schema: str, rounds: int = 3) -> DataFrame:
    """Each job's result of fetch(dict), tried up to `rounds` times in its task; error holds the last failure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                error = None
                for _ in range(rounds):
                    try:
                        out.append(row | fetch(row) | {"error": None})
                        break
                    except Exception as e:  # noqa: BLE001  a failed request is a row of the result
                        error = str(e)
                else:
                    out.append(row | {"error": error})
            yield pd.DataFrame(out)

    return jobs.mapInPandas(run, schema)


def encode_polyline(points: list[tuple[float, float]], factor: float = 1e5) -> str:
    """Differences of scaled coordinates, sign in the lowest bit, five bits to a character from 63 on."""
    out, before = [], (0, 0)
    for p in points:
        now = tuple(int(np_round(c * factor)) for c in p)
        for a, b in zip(now, before):
            v = (a - b) * 2 if a >= b else (b - a) * 2 - 1
            while True:
                v, low = v >> 5, v & 31
                out.append(chr(63 + low + 32 * (v > 0)))
                if not v:
                    break
        before = now
    return "".join(out)


def np_round(x: float) -> float:
    """Half away from zero."""
    return float(int(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def decode_polyline(text: str | None, factor: float = 1e5) -> list[tuple[float, float]] | None:
    """None for what no encoder writes, or for places outside the globe."""
    numbers, value, shift = [], 0, 0
    for c in (text or "").encode("utf-8", "surrogatepass"):
        if not 63 <= c <= 126 or shift > 60:
            return None
        value |= (c - 63 & 31) << shift
        shift += 5
        if c - 63 < 32:
            numbers.append(-(value + 1 >> 1) if value & 1 else value >> 1)
            value = shift = 0
    if shift or len(numbers) % 2:
        return None
    out, lat, lon = [], 0, 0
    for a, b in zip(numbers[::2], numbers[1::2]):
        lat, lon = lat + a, lon + b
        if abs(lat) > 90 * factor or abs(lon) > 180 * factor:
            return None
        out.append((lat / factor, lon / factor))
    return out


def polyline_text(points: Column, factor: float = 1e5) -> Column:
    @F.pandas_udf("string")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda ps: encode_polyline([(p["lat"], p["lon"]) for p in ps], factor))

    return of(points)


def polyline_points(text: Column, factor: float = 1e5) -> Column:
    @F.pandas_udf("array<struct<lat:double,lon:double>>")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if (ps := decode_polyline(t, factor)) is None else [{"lat": a, "lon": b} for a, b in ps])

    return of(text)
