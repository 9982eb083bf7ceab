"""Hard-negative mining over product-quantised vectors with stored residual norms.

Every vector is stored as codes (one byte for each pair of its components), with the length of what the codes leave out. A table
of an anchor's products with all centroids gives each row's score but for an error of at most anchor length x residual length,
so bounds below and above the score tell which rows can be among those asked for; these alone are scored exactly, in integers.
The codebooks are fitted on a bounded sample (SAMPLE_ROWS), every row is encoded, and the results don't depend on the codebooks.

All rows are dealt to blocks, anchors to parts, and each pair of an anchor part and a block is a task of its own with fixed
memory; anchors are a stated share of the rows.

Defined results: rows with a null id, label or vector, a null or non-finite component, one of 2 ** 17 or more (its scores might
not fit a long), or of another length than most take no part. An anchor's candidates are the rows of other ids; rows that repeat
an id are candidates each. Anchor rows that repeat id, label and vector are asked once; other repeated anchor ids are anchors
each, told apart by anchor_hash. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideframe.llm.common import materialize

#: The codebooks are fitted on so many rows at most, those of the smallest hashes.
SAMPLE_ROWS = 8_192
CENTROIDS = 256
LARGEST = 2.0**17
_INDEX = "vec_id bigint, label bigint, q array<int>, codes binary, residual float, block int"


def integer_rows(vectors: DataFrame, scale: int = 256, vec_id: str = "vec_id", label: str | Column = "label", embedding: str = "embedding") -> DataFrame:
    """(vec_id, label, q): the rows that take part, q their components times scale, rounded down."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"), F.col(embedding).cast("array<double>").alias("e"))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & F.forall("e", good))
    sizes = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    rows = rows.join(F.broadcast(sizes), F.size("e") == F.col("n"))
    return rows.select("vec_id", "label", F.transform("e", lambda x: F.floor(x * scale).cast("int")).alias("q"))


def pairs_of(x: np.ndarray) -> np.ndarray:
    """rows x subspaces x 2; an odd last component is paired with 0."""
    x = np.asarray(x, np.float64)
    return (np.pad(x, ((0, 0), (0, x.shape[1] % 2)))).reshape(len(x), -1, 2)


def fit_codebooks(x: np.ndarray, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """subspaces x centroids x 2 by k-means in each subspace."""
    parts, rng = pairs_of(x).transpose(1, 0, 2), np.random.default_rng(seed)
    books = np.empty((len(parts), CENTROIDS, 2))
    for m, own in enumerate(parts):
        c = own[rng.choice(len(own), CENTROIDS, replace=len(own) < CENTROIDS)]
        for _ in range(rounds):
            at = closest(own, c)
            n = np.bincount(at, minlength=CENTROIDS)
            sums = np.column_stack([np.bincount(at, own[:, d], CENTROIDS) for d in (0, 1)])
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        books[m] = c
    return books


def closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)


def encode(q: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x subspaces) and the residual lengths, rounded up."""
    parts = pairs_of(q)
    codes = np.stack([closest(parts[:, m], books[m]) for m in range(len(books))], axis=1).astype(np.uint8)
    left = parts - books[np.arange(len(books))[None, :], codes]
    return codes, np.nextafter((np.sqrt((left**2).sum((1, 2))) * (1 + 1e-9) + 1e-6).astype(np.float32), np.float32(np.inf))


class Block:
    """One block of encoded rows, in order of ids."""

    def __init__(self, held: pd.DataFrame, books: np.ndarray):
        held = held.sort_values("vec_id", kind="stable")
        self.ids, self.labels, self.q = held["vec_id"].to_numpy(), held["label"].to_numpy(), np.stack(held["q"].to_numpy()).astype(np.int64)
        self.codes = np.stack([np.frombuffer(c, np.uint8) for c in held["codes"]])
        self.residual, self.books = held["residual"].to_numpy(np.float64), books

    def bounds(self, anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of each anchor with each of the rows."""
        table = np.einsum("amd,mcd->mac", pairs_of(anchors), self.books)
        score = np.zeros((len(anchors), len(rows)))
        for m, own in enumerate(table):
            score += own[:, self.codes[rows, m]]
        length = np.sqrt((anchors.astype(np.float64) ** 2).sum(1))
        slack = length[:, None] * self.residual[rows][None, :] * (1 + 1e-9) + 1e-6 + 1e-9 * np.abs(score)
        return score - slack, score + slack

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        return np.lexsort((self.ids[rows], -scores))[:k]


def _kth(values: np.ndarray, k: int) -> float:
    return -np.inf if len(values) < k else float(np.partition(values, len(values) - k)[len(values) - k])


def _positives(asked: pd.DataFrame, block: Block, k: int) -> Iterator[tuple]:
    """(anchor_id, anchor_hash, positive_id, positive_score): the block's k best rows of each anchor's label."""
    for label, own in asked.groupby("label"):
        rows = np.flatnonzero(block.labels == label)
        for i in range(0, len(own) if len(rows) else 0, 64):
            some = own.iloc[i : i + 64]
            anchors = np.stack(some["q"].to_numpy()).astype(np.int64)
            low, high = block.bounds(anchors, rows)
            for a, (a_id, a_hash, q) in enumerate(zip(some["anchor_id"], some["anchor_hash"], anchors)):
                other = block.ids[rows] != a_id
                keep = rows[other & (high[a] >= _kth(low[a][other], k))]
                scores = block.q[keep] @ q
                for j in block.best(keep, scores, k):
                    yield a_id, a_hash, block.ids[keep[j]], scores[j]


def _negatives(asked: pd.DataFrame, block: Block, k: int, least: int, most: int) -> Iterator[tuple]:
    """(anchor_id, anchor_hash, positive_score, negative_id, negative_score): the block's k best rows of other labels within each window."""
    for i in range(0, len(asked), 64):
        some = asked.iloc[i : i + 64]
        anchors = np.stack(some["q"].to_numpy()).astype(np.int64)
        low, high = block.bounds(anchors, np.arange(len(block.ids)))
        for a, (a_id, a_hash, label, positives, q) in enumerate(zip(some["anchor_id"], some["anchor_hash"], some["label"], some["positives"], anchors)):
            other = (block.labels != label) & (block.ids != a_id)
            for p in np.unique(positives).tolist():
                # In hundredths: least * p <= 100 * score <= most * p.
                lo, hi = 100 * low[a], 100 * high[a]
                inside = other & (lo >= least * p) & (hi <= most * p)
                keep = np.flatnonzero(other & (lo <= most * p) & (hi >= max(least * p, _kth(lo[inside], k))))
                scores = block.q[keep] @ q
                fits = (100 * scores >= least * p) & (100 * scores <= most * p)
                keep, scores = keep[fits], scores[fits]
                for j in block.best(keep, scores, k):
                    yield a_id, a_hash, p, block.ids[keep[j]], scores[j]


def _index(rows: DataFrame, block_rows: int) -> tuple[DataFrame, np.ndarray, int]:
    """The encoded rows as a written table, the codebooks, the number of blocks."""
    spark = rows.sparkSession
    n = rows.count()
    blocks = max(1, -(-n // min(block_rows, max(1024, n // 32))))  # small tables are dealt to 32 tasks, large ones in whole blocks
    sample = np.array([r["q"] for r in rows.orderBy(F.xxhash64("vec_id", "q"), "vec_id").limit(SAMPLE_ROWS).select("q").collect()], np.float64)
    books = fit_codebooks(sample) if sample.size else np.zeros((0, CENTROIDS, 2))
    shared = spark.sparkContext.broadcast(books)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, pdf in enumerate(batches):
            if len(pdf):
                codes, residual = encode(np.stack(pdf["q"].to_numpy()), shared.value)
                place = (np.arange(len(pdf)) + 7919 * k + pdf["deal"].to_numpy()) % blocks  # rows that are all alike are dealt too
                yield pdf.drop(columns="deal").assign(codes=[c.tobytes() for c in codes], residual=residual, block=place.astype(np.int32))

    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    return materialize(dealt.mapInPandas(encoded, _INDEX), "negatives-index"), books, blocks


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, least: int = 30, most: int = 90, block_rows: int = 65_536, anchor_rows: int = 8_192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, anchor_hash) of integer_rows().

    For each anchor and each of its n_positives best rows of its label, the n_negatives best rows of other labels whose score is
    from least to most hundredths of the positive's.
    """
    spark = rows.sparkSession
    index, books, blocks = _index(rows, block_rows)
    shared = spark.sparkContext.broadcast(books)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = ["anchor_id", "anchor_hash"]
    anchors = materialize(index.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "q").alias("anchor_hash"), "label", "q").dropDuplicates(key), "negatives-anchors")
    parts = max(1, -(-anchors.count() // anchor_rows))
    part = F.pmod(F.xxhash64(*key, F.lit(1)), F.lit(parts)).cast("int")
    held = index.withColumn("part", every(parts))

    def pairs(asked: DataFrame, found, schema: str) -> DataFrame:
        columns = [c.split()[0] for c in schema.split(", ")]

        def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            out = list(found(asked, Block(held, shared.value))) if len(asked) and len(held) and len(shared.value) else []
            return pd.DataFrame(out, columns=columns).astype("int64")

        asked = asked.withColumn("part", part).withColumn("block", every(blocks))
        return asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInPandas(run, schema)

    near = pairs(anchors, lambda a, b: _positives(a, b, n_positives), "anchor_id bigint, anchor_hash bigint, positive_id bigint, positive_score bigint")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("positive_score"), "positive_id"))
    positives = materialize(near.withColumn("place", place).where(F.col("place") <= n_positives).drop("place"), "negatives-positives")
    asked = anchors.join(positives.groupBy(*key).agg(F.collect_set("positive_score").alias("positives")), key)
    hard = pairs(asked, lambda a, b: _negatives(a, b, n_negatives, least, most), "anchor_id bigint, anchor_hash bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    rank = F.row_number().over(Window.partitionBy(*key, "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    hard = hard.withColumn("rank", rank).where(F.col("rank") <= n_negatives)
    return positives.join(hard, [*key, "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "anchor_hash")
