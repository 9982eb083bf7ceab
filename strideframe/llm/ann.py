"""Approximate nearest neighbours by collision counting (inner product).

Vectors are dealt to blocks of bounded size, and so are the queries; each pair of blocks is a task of its own, which keeps
memory fixed and gives every lost executor little to redo. In a block every projection has one sorted array. A query's windows
in these arrays, centred at its own projections, are widened step by step (virtual rehashing: the same arrays serve every
radius); vectors that fall into the windows of enough projections are verified by their exact inner product.

Inner products become distances by one more component, which gives all vectors of a block the same length.

Defined results: vectors that are null, zero, of another length than most, or with a null or non-finite component take no
part, as queries or as candidates; repeated ids are candidates each, and never of their own id; ties go to the smaller id.
Query rows that repeat id and vector are asked once; different vectors of one id are queries each, with a ranking of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding array<double>) of the vectors that take part."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", good) & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return rows.join(F.broadcast(sizes), F.size("embedding") == F.col("n")).select("vec_id", "embedding")


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths that neither overflow nor vanish."""
    top = np.abs(x).max(axis=1)
    return top * np.linalg.norm(x / top[:, None], axis=1)


class Block:
    """Sorted projections of one block of vectors (fewer than 65,536)."""

    def __init__(self, x: np.ndarray, projections: int, seed: int):
        n = len(x)
        assert n < 1 << 16 and projections < 256
        scaled = x / np.abs(x).max()
        norms = np.einsum("ij,ij->i", scaled, scaled)
        top = norms.max()
        lifted = np.column_stack([scaled, np.sqrt(np.maximum(0, top - norms))]) / np.sqrt(top)
        random = np.random.default_rng(seed)
        self.x, self.lines = x, random.standard_normal((x.shape[1] + 1, projections))
        values = np.ascontiguousarray((lifted @ self.lines).T)
        order = np.argsort(values, axis=1)
        self.sorted = np.take_along_axis(values, order, axis=1)
        #: A vector's place in each sorted array.
        self.place = np.empty(order.shape, np.uint16)
        np.put_along_axis(self.place, order, np.arange(n, dtype=np.uint16)[None, :], axis=1)
        self.some = values[:, random.choice(n, min(n, 256), replace=False)].T.astype(np.float32)

    def search(self, asked: np.ndarray, others: np.ndarray, need: int, share: float, start: float, widen: float) -> list[np.ndarray]:
        """For each query the places of the vectors that are in the windows of at least share of the projections.

        others: query x vector, which vectors may be found at all. All windows of a query have the same half-width,
        start * widen ** i: the first i tried is where, among a few of the vectors, enough would be found; i grows until
        `need` others are, or all of them.
        """
        n, m = len(self.x), self.lines.shape[1]
        most = others.sum(1)
        least = int(np.ceil(share * m))
        asked = asked / np.abs(asked).max(axis=1)[:, None]
        centre = (asked / np.linalg.norm(asked, axis=1)[:, None]) @ self.lines[:-1]
        apart = np.partition(np.abs(self.some[None] - centre[:, None].astype(np.float32)), least - 1, axis=2)[:, :, least - 1]
        first = np.quantile(apart, min(1, need / n), axis=1)
        step = np.maximum(0, np.round(np.log(np.maximum(first, 1e-9) / start) / np.log(widen))).astype(int)
        found = [np.flatnonzero(o) for o in others]
        left = np.flatnonzero(most > need)
        while len(left):
            half = start * widen ** step[left]
            hits = np.zeros((len(left), n), np.uint8)
            for j in range(m):
                lo = np.searchsorted(self.sorted[j], centre[left, j] - half).astype(np.uint16)
                size = (np.searchsorted(self.sorted[j], centre[left, j] + half, "right") - lo).astype(np.uint16)
                hits += (self.place[j][None, :] - lo[:, None]) < size[:, None]  # unsigned: places before the window wrap round
            enough = (hits >= least) & others[left]
            done = enough.sum(1) >= need
            for k in np.flatnonzero(done):
                found[left[k]] = np.flatnonzero(enough[k])
            step[left] += 1
            left = left[~done]
        return found


def search(
    vectors: DataFrame,
    is_query: Column | None = None,
    k: int = 20,
    projections: int = 128,
    share: float = 0.7,
    verify: float = 0.1,
    start: float = 0.25,
    widen: float = 1.2,
    block_rows: int = 8192,
    query_rows: int = 2048,
    seed: int = 11,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score, query_hash): the k nearest found of each query, nearest first; query_hash tells the queries of one id apart.

    share: of the projections whose windows must hold a vector; verify: windows widen until at least this share of a block,
    and k more, is to be verified. A block of k vectors or fewer is verified whole.
    """
    rows = usable(vectors, vec_id, embedding)
    asked = rows.where(F.col("vec_id") % 20 == 0 if is_query is None else is_query).dropDuplicates(["vec_id", "embedding"])
    n, n_asked = rows.count(), asked.count()
    blocks, parts = max(1, -(-n // block_rows)), max(1, -(-n_asked // query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.xxhash64("embedding").alias("query_hash"), F.pmod(F.xxhash64("vec_id", "embedding", F.lit(1)), F.lit(parts)).cast("int").alias("part"), every(blocks).alias("block"))
    right = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding", F.lit(2)), F.lit(blocks)).cast("int")).withColumn("part", every(parts))

    def of_blocks(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "query_hash": [], "vec_id": [], "score": []}
        if len(asked) and len(held):
            held = held.sort_values("vec_id", kind="stable")
            every, x = held["vec_id"].to_numpy(), np.stack(held["embedding"].to_numpy())
            # Vectors of like length share one set of arrays: a few long ones would leave the others at one place.
            octave = np.round(np.log2(lengths(x)))  # powers of two lie within one, not between two
            parts = [np.flatnonzero(octave == o) for o in np.unique(octave)]
            blocks = [(every[p], Block(x[p], projections, seed)) for p in parts]
            for i in range(0, len(asked), 64):
                some, own_ids = np.stack(asked["query"][i : i + 64].to_numpy()), asked["query_id"][i : i + 64].to_numpy()
                all_found = [block.search(some, ids[None, :] != own_ids[:, None], k + int(verify * len(ids)), share, start, widen) for ids, block in blocks]
                for j, (q_id, q_hash, q) in enumerate(zip(own_ids, asked["query_hash"][i : i + 64], some)):
                    near = [(ids[f[j]], block.x[f[j]]) for (ids, block), f in zip(blocks, all_found)]
                    ids, own = np.concatenate([a for a, _ in near]), np.concatenate([b for _, b in near])
                    with np.errstate(over="ignore", invalid="ignore"):
                        scores = own @ q
                    best = np.lexsort((ids, -scores))[:k]
                    out["query_id"].append(np.full(len(best), q_id))
                    out["query_hash"].append(np.full(len(best), q_hash))
                    out["vec_id"].append(ids[best])
                    out["score"].append(scores[best])
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()}).astype({"query_id": "int64", "query_hash": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(of_blocks, "query_id bigint, query_hash bigint, vec_id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_hash")
