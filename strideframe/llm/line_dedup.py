"""Line de-duplication: lines whose key occurs in many documents go from all of them. DataFrame operations only.

Normalised lines are exploded and hashed (128 bits); documents are counted per hash with partial sums before the shuffle;
positions of lines over the threshold are gathered per document, and what is left is reassembled by position.

Defined results: null and empty texts have one empty line, which stays (a key needs min_chars code points); every row
counts as a document of its own, also rows that repeat a doc_id or a text; other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import BLANKS, ascii_lower, materialize, semi_join_hot, text_or_empty


def line_keys(text: Column) -> Column:
    return F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_sf_h1", F.xxhash64("_sf_key")).withColumn("_sf_h2", F.xxhash64(F.lit(1), "_sf_key")).drop("_sf_key")


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text") -> DataFrame:
    """(_sf_h1, _sf_h2, n_docs) of the line keys found in at least min_docs documents."""
    keys = docs.select(F.explode(F.array_distinct(line_keys(text_or_empty(text)))).alias("_sf_key")).where(F.length("_sf_key") >= min_chars)
    return _hashed(keys).groupBy("_sf_h1", "_sf_h2").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with `text` replaced by its kept lines, plus n_lines and n_dropped (long). Needs no unique doc_id.

    Columns of docs that have these names, or begin with _sf_, are replaced or dropped; all others pass through.
    """
    docs = docs.withColumn("_sf_t", text_or_empty(text)).withColumn("_sf_th", F.xxhash64("_sf_t"))
    wanted = materialize(frequent_lines(docs, min_docs, min_chars, text), "frequent-lines")
    lines = _hashed(docs.select(F.col(doc_id).alias("_sf_id"), "_sf_th", F.posexplode(line_keys(F.col("_sf_t"))).alias("_sf_pos", "_sf_key")).where(F.length("_sf_key") >= min_chars))
    # What goes depends on the text alone, so rows that repeat an id and a text share one list.
    drops = semi_join_hot(lines, wanted, ["_sf_h1", "_sf_h2"], "n_docs").groupBy("_sf_id", "_sf_th").agg(F.collect_set("_sf_pos").alias("_sf_drop")).withColumnRenamed("_sf_th", "_sf_dh")
    split = F.split("_sf_t", "\n")
    # array_except and array_join over positions: in the order of the text, linear in its lines.
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_sf_drop")), lambda i: F.get(split, i))
    return (
        docs.join(drops.hint("shuffle_hash"), F.col(doc_id).eqNullSafe(F.col("_sf_id")) & (F.col("_sf_th") == F.col("_sf_dh")), "left")
        .withColumn("n_lines", F.size(split).cast("long"))
        .withColumn("n_dropped", F.when(F.col("_sf_drop").isNull(), F.lit(0)).otherwise(F.size("_sf_drop")).cast("long"))
        .withColumn(text, F.when(F.col("_sf_drop").isNull(), F.col("_sf_t")).otherwise(F.array_join(left, "\n")))
        .drop("_sf_t", "_sf_th", "_sf_id", "_sf_dh", "_sf_drop")
    )
