"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a few differing bits through pivot distance tables.

Every distinct fingerprint gets its Hamming distances to many reference fingerprints, band by band. Two fingerprints that
differ in 2 bits or fewer leave at least one of 3 bands alone, so they agree in all distances of that band: an equi-join on them
finds every pair. Pairs of which some distance differs by more than 2 are discarded; the survivors are verified bit by bit.
Where very many fingerprints share a band's distances, their pairs aren't listed: they meet at the values one bit away
(also exact, see star_links).

Defined results: null and empty texts have fingerprint 0 and link like any other; rows that repeat an id or a text share a
fingerprint and so a component; a null id never names a component unless all ids of it are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import LOWER, UPPER, free_name, lookup_hot, materialize, text_or_empty

_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Shingles whose bits are summed at once.
_CHUNK = 1 << 15


def shingle_hashes(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < words_per_shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    of, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((of(join(x), seed) for x in zip(*(words[i:] for i in range(words_per_shingle)))), np.uint64, len(words) - words_per_shingle + 1)


def simhash(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half of the hashes; as a signed 64-bit number."""
    h = shingle_hashes(text, words_per_shingle, seed)
    if not len(h):
        return 0
    ones = sum(np.unpackbits(h[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(h), _CHUNK))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: str | Column, words_per_shingle: int = 3, seed: int = 42) -> Column:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([simhash(t, words_per_shingle, seed) for t in x], dtype="int64")

    return of(text)


#: Fingerprints link at this many differing bits or fewer.
BITS = 2


def _signed(x: int) -> int:
    return int(np.uint64(x).astype(np.int64))


def bands() -> list[int]:
    """Masks of BITS + 1 bands that cover 64 bits, as signed numbers."""
    edges = [round(64 * i / (BITS + 1)) for i in range(BITS + 2)]
    return [_signed(((1 << (b - a)) - 1) << a) for a, b in zip(edges, edges[1:])]


def pivots(n: int, seed: int = 7) -> list[int]:
    """Reference fingerprints, as signed numbers."""
    return [int(x) for x in np.random.default_rng(seed).integers(-(1 << 63), (1 << 63) - 1, n, dtype=np.int64)]


def distance_table(prints: DataFrame, n_pivots: int) -> DataFrame:
    """(fp, dist): for each band, an array of the distances to the pivots within that band."""
    return prints.select("fp", F.array(*(F.array(*(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(m))) for p in pivots(n_pivots))) for m in bands())).alias("dist"))


def star_links(prints: DataFrame) -> DataFrame:
    """(a, b) that connect all of prints at 2 or fewer differing bits, without listing pairs.

    Two fingerprints differ in at most 2 bits just if some value is at most 1 bit away from both. Each one goes to itself and
    its 64 neighbours; whoever meets at a value (65 at most) is linked to the smallest there.
    """
    near = prints.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))).alias("at"))
    met = near.groupBy("at").agg(F.collect_set("fp").alias("met")).where(F.size("met") > 1)
    return met.select(F.array_min("met").alias("a"), F.explode("met").alias("b")).where("a < b")


def links(prints: DataFrame, n_pivots: int = 12, crowd: int = 64) -> DataFrame:
    """(a, b), a < b: pairs of the distinct fingerprints `fp` at BITS or fewer differing bits, enough to connect all such.

    Groups of more than `crowd` that share a band's distances are connected by star_links instead of by their pairs.
    """
    keyed = distance_table(prints, n_pivots).select("fp", "dist", F.posexplode("dist").alias("band", "at")).withColumn("key", F.xxhash64("band", "at")).drop("at", "band")
    keyed = materialize(keyed, "pivot-distances")
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "pivot-groups")
    few, many = sizes.where(F.col("n") <= crowd).select("key"), sizes.where(F.col("n") > crowd).select("key")
    some = keyed.join(few, "key", "left_semi")
    left, right = (some.select("key", F.col("fp").alias(x), F.col("dist").alias(f"d{x}")) for x in "ab")
    apart = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n_pivots - 1)), lambda i: F.abs(sum((F.get(F.get("da", F.lit(k)), i) - F.get(F.get("db", F.lit(k)), i) for k in range(BITS + 1)), F.lit(0)))))
    pairs = left.join(right, "key").where("a < b").where(apart <= BITS).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")
    crowded = keyed.join(many, "key", "left_semi").select("fp").distinct()
    return pairs.unionByName(star_links(crowded)).distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(v, root) for every vertex of edges (a, b); root: the smallest vertex reachable.

    Each round takes the smallest label among the neighbours, then that label's own label, so that rounds grow with the
    logarithm of the longest chain. Labels are written in the shared folder after each round.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("b")).select("v", F.least("v", "b").alias("root")), "labels")
    for _ in range(rounds):
        near = both.join(label.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        lower = label.join(near, "v").select("v", F.col("root").alias("was"), F.least("root", "near").alias("at"))
        new = materialize(lower.join(label.select(F.col("v").alias("at"), F.col("root").alias("up")), "at").select("v", "was", F.least("at", "up").alias("root")), "labels")
        label = new.select("v", "root")
        if new.where("was <> root").isEmpty():
            return label
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def near_duplicate_groups(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for each row of docs; component_id: the smallest id it is linked to, itself included.

    With the column `row`, that too, and `root`: the group itself (repeated ids can give two groups one component_id).
    """
    more = [F.col(row).alias("row")] if row else []
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("text_hash"), fingerprint(F.col(text), words_per_shingle, seed).alias("fp"), *more), "fingerprints")
    known = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = components(links(known.select("fp")))
    linked = known.join(roots.withColumnRenamed("v", "fp"), "fp")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    alone = known.join(roots.select(F.col("v").alias("fp")), "fp", "left_anti").select("fp", F.col("least").alias("component_id"), "n", F.col("fp").alias("root"))
    named = materialize(linked.join(names, "root").select("fp", "component_id", "n", "root").unionByName(alone), "groups")
    return lookup_hot(rows, named, ["fp"], "n").select("doc_id", "text_hash", "fp", "component_id", *(["row", "root"] if row else []))


#: Shingles in a group, about, and groups of a text that are looked at.
GROUP_SHINGLES, GROUPS = 6, 24


def group_prints(text: str | None, words_per_shingle: int = 5, seed: int = 42, similarity: float = 0.8) -> list[int]:
    """Fingerprints of groups of the text's distinct shingles, dealt by their hashes, as signed numbers.

    A text of n shingles has about n / GROUP_SHINGLES groups (a power of two), of which the first GROUPS count. Texts that are
    similar differ in few shingles, so that most likely some group is the same in both. Where a similar text may be so much
    longer or shorter that it has another number of groups, the groups of that number count too.
    """
    h = np.unique(shingle_hashes(text, words_per_shingle, seed))
    if not len(h):
        return []
    level = lambda n: max(0, int(np.ceil(np.log2(n / GROUP_SHINGLES))))
    out: list[np.ndarray] = []
    ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    mixed = h * np.uint64(0x9E3779B97F4A7C15)
    for k in range(level(len(h) * similarity), level(len(h) / similarity) + 1):
        at = (mixed >> np.uint64(64 - k)).astype(np.int64) if k else np.zeros(len(h), np.int64)
        order = np.flatnonzero(at < GROUPS)
        order = order[np.argsort(at[order], kind="stable")]
        if not len(order):
            continue
        own, first, n = np.unique(at[order], return_index=True, return_counts=True)
        sums = np.add.reduceat(ones[order], first, axis=0, dtype=np.int64)
        prints = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
        # The same print counts only in the same group of as many groups.
        out.append((prints ^ ((np.uint64(k << 8) + own.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))).view(np.int64))
    return np.unique(np.concatenate(out)).tolist() if out else []


def similarity_of(a: str | None, b: str | None, words_per_shingle: int = 5, seed: int = 42) -> float:
    """Shared part of the distinct shingles of both texts; of two texts without any, 1."""
    x, y = (np.unique(shingle_hashes(t, words_per_shingle, seed)) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def similar_links(texts: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, seed: int = 42, rounds: int = 64) -> DataFrame:
    """(a, b), a < b: verified links between the rows of texts (v, text; texts distinct) of that similarity or more.

    Rows meet in groups of equal fingerprint. No pairs are listed within a group: each round its smallest row is held against
    all others; those that are similar are linked and leave the group, and the others go on without it, until every group is
    used up. Links through the smallest row connect what is similar; the groups are many, so that a pair that one of them
    doesn't hold against each other most likely meets in another.
    """

    @F.pandas_udf("array<bigint>")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([group_prints(t, words_per_shingle, seed, similarity) for t in x])

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity_of(x, y, words_per_shingle, seed) >= similarity for x, y in zip(a, b)])

    left = materialize(texts.select("v", F.explode(prints("text")).alias("key")), "group-prints")
    checked, out = None, None
    for _ in range(rounds):
        groups = materialize(left.groupBy("key").agg(F.min("v").alias("a"), F.count("*").alias("n")).where("n > 1"), "print-groups")
        if groups.isEmpty():
            return out if out is not None else texts.select(F.col("v").alias("a"), F.col("v").alias("b")).limit(0)
        met = materialize(lookup_hot(left, groups, ["key"], "n").where("v <> a").select("key", "a", F.col("v").alias("b")), "met")
        pairs = met.select("a", "b").distinct()
        if checked is not None:
            pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        weighed = pairs.join(texts.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b")
        looked = pairs.groupBy("a").agg(F.count("*").alias("n")).join(texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a")
        judged = lookup_hot(weighed, looked, ["a"], "n", heavy_rows=32).select("a", "b", similar("text_a", "text_b").alias("yes"))
        new = materialize(judged, "judged-pairs")
        checked = new if checked is None else checked.unionByName(new)
        yes = checked.where("yes").select("a", "b")
        out = yes
        # Rows linked to their group's smallest leave it, and so does that one.
        left = materialize(met.join(yes, ["a", "b"], "left_anti").select(F.col("b").alias("v"), "key"), "left-groups")
    raise RuntimeError(f"groups weren't used up in {rounds} rounds")


def keep_one_of_similar(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of docs whose texts are linked: equal, of fingerprints at BITS or fewer differing bits (pivot
    tables), or of the given similarity of their shingles (groups of shingles, verified). It is the row of the smallest id
    (nulls last), then of the smallest text hash; of rows equal in both any one stays. Columns that begin with _sf_ are dropped.
    """
    keyed = materialize(docs.withColumn("_sf_row", F.monotonically_increasing_id()), "keyed-rows")
    t = text_or_empty(text)
    rows = materialize(keyed.select(F.col("_sf_row").alias("row"), F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("text_hash"), F.xxhash64(F.lit(1), t).alias("h2"), fingerprint(F.col(text), words_per_shingle, seed).alias("fp")), "fingerprints")
    # Classes of equal texts: partial minima, whatever their size. v: the class's number, its smallest row.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "row")
    classes = materialize(rows.groupBy("text_hash", "h2").agg(F.min("row").alias("v"), F.min(order).alias("first"), F.min("fp").alias("fp")), "text-classes")
    by_print = materialize(classes.groupBy("fp").agg(F.min("v").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    near = links(by_print.select("fp"))
    least = by_print.select("fp", "least")
    near = near.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = lookup_hot(classes.select("v", "fp"), by_print, ["fp"], "n").where("v <> least").select(F.col("least").alias("a"), F.col("v").alias("b"))
    texts = keyed.select(F.col("_sf_row").alias("v"), F.col(text).alias("text")).join(classes.select("v"), "v", "left_semi")
    texts = materialize(texts, "distinct-texts")
    alike = similar_links(texts, words_per_shingle, similarity, seed)
    roots = components(near.unionByName(same).unionByName(alike))
    grouped = classes.join(roots, "v", "left").groupBy(F.coalesce("root", "v").alias("root")).agg(F.min("first").alias("first"))
    return keyed.join(grouped.select(F.col("first.row").alias("_sf_row")), "_sf_row", "left_semi").drop("_sf_row")


def keep_one_of_each_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """One row of each group of docs: the one of the smallest id (nulls last), then the smallest text hash; of rows that are
    equal in both any one stays.

    Rows are written once with a key of their own, so that a group's rows can be told apart though they repeat id and text;
    all columns of docs stay, whatever their names.
    """
    row = free_name(docs, "row_key")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "keyed-rows")
    grouped = near_duplicate_groups(keyed, text=text, doc_id=doc_id, row=row, **how)
    # Partial minima before the shuffle: a group of any size is one row of each task.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "row")
    kept = grouped.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.row").alias(row))
    return keyed.join(kept, row, "left_semi").drop(row)
