"""Spelling variants by full neighbourhood generation.

Every word of the vocabulary emits all distinct words that one deletion, replacement or insertion over the observed alphabet
makes of it; those that are words of the vocabulary are found by a hash join on the words themselves, so no distance is computed.
Most candidates are no word at all. A task works out their hashes from those of a word's beginnings and ends, looks them up in
a Bloom filter of the vocabulary (of at most MOST_BITS, whatever the vocabulary), and emits what passes: the join drops the few
that pass by chance, and a filter too small for its vocabulary costs time, never a pair.

Defined results: null texts have no words; words of any length take part; rows that repeat are counted each; of near words that
are equally frequent the smaller in code-point order is the form.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import ascii_lower, materialize

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: Bits of the filter for each word, and at most (64 MB).
BITS_A_WORD, MOST_BITS = 32, 1 << 29
PROBES = 4
#: Hashes of candidates worked out at a time.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def runs(docs: DataFrame, text: str = "text", pattern: str = RUN) -> DataFrame:
    """docs plus run, a row for each run of letters in a text, A-Z lower-cased."""
    return docs.withColumn("run", F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).withColumn("run", ascii_lower(F.col("run")))


def without_letter(word: str | Column, at: Column) -> Column:
    """The word without its code point at `at` (from 0)."""
    word = F.col(word) if isinstance(word, str) else word
    return F.concat(F.substring(word, F.lit(1), at.cast("int")), F.substring(word, at.cast("int") + 2, F.length(word)))


def vocabulary(words: DataFrame, word: str | Column, min_chars: int = 6, min_n: int = 5) -> DataFrame:
    """(word, n) of the words long and frequent enough."""
    own = words.select((F.col(word) if isinstance(word, str) else word).alias("word")).where(F.length("word") >= min_chars)
    return own.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_n)


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.uint64)


def _sums(codes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... code points: each is its code point times a power of an odd base, modulo 2 ** 64."""
    terms = codes * powers[: codes.shape[1]]
    return np.concatenate([np.zeros((len(codes), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)


def _probe(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return ((h >> np.uint64(32)) + np.uint64(k) * (h | np.uint64(1))) & np.uint64(bits - 1)


def passes(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Indexes into h (flat) of those that the filter lets through."""
    h = h.ravel()
    left = np.arange(len(h))
    for k in range(PROBES):
        at = _probe(h[left], k, len(table) * 64)
        left = left[(table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    return left


def neighbours(words: list[str], letters: str, table: np.ndarray) -> Iterator[tuple[int, str]]:
    """(index, candidate) of words of one length: each distinct word one edit away that passes the filter."""
    size, alphabet = len(words[0]), np.array([ord(c) for c in letters], np.uint64)
    powers, step = _powers(size + 1), max(1, CHUNK // ((size + 1) * max(1, len(letters))))
    for first in range(0, len(words), step):
        own = words[first : first + step]
        codes = _codes(own)
        begins = _sums(codes, powers)
        whole, found = begins[:, -1:], set()
        places = max(1, CHUNK // max(1, len(own) * len(letters)))
        for lo in range(0, size + 1, places):
            at = np.arange(lo, min(lo + places, size))
            gone = begins[:, at] + (whole - begins[:, at + 1]) * np.uint64(_BACK)
            for x in passes(gone, table).tolist() if len(at) else ():
                w, i = divmod(x, len(at))
                found.add((w, own[w][: lo + i] + own[w][lo + i + 1 :]))
            other = (whole - codes[:, at] * powers[at])[:, :, None] + powers[at][None, :, None] * alphabet
            at = np.arange(lo, min(lo + places, size + 1))
            more = (begins[:, at] + (whole - begins[:, at]) * np.uint64(_BASE))[:, :, None] + powers[at][None, :, None] * alphabet
            for hashes, skip in ((other, 1), (more, 0)):
                for x in passes(hashes, table).tolist():
                    rest, a = divmod(x, len(letters))
                    w, i = divmod(rest, hashes.shape[1])
                    found.add((w, own[w][: lo + i] + letters[a] + own[w][lo + i + skip :]))
        yield from ((first + w, c) for w, c in found if c != own[w])


def _by_length(words: pd.Series) -> Iterator[np.ndarray]:
    size = words.str.len().to_numpy()
    for n in np.unique(size):
        yield np.flatnonzero(size == n)


def filter_of(words: DataFrame, n: int) -> np.ndarray:
    """The Bloom filter of the words as 64-bit parts, put together from the parts that tasks emit."""
    bits = min(MOST_BITS, max(1 << 12, 1 << math.ceil(math.log2(BITS_A_WORD * max(1, n)))))

    def set_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = [_probe(_sums(_codes(own), _powers(len(own[0])))[:, -1], k, bits) for rows in _by_length(pdf["word"]) for own in [pdf["word"].iloc[rows].tolist()] for k in range(PROBES)]
            if at:
                at = np.unique(np.concatenate(at))
                part, first = np.unique(at >> np.uint64(6), return_index=True)
                yield pd.DataFrame({"part": part.astype(np.int64), "bits": np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first).view(np.int64)})

    parts = words.select("word").mapInPandas(set_bits, "part bigint, bits bigint").groupBy("part").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[parts["part"].to_numpy()] = parts["bits"].to_numpy().view(np.uint64)
    return table


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of (word, n): all pairs one edit apart, in both directions."""
    spark = words.sparkSession
    n = words.count()
    letters = "".join(sorted(r["c"] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()))  # as many as there are characters
    table = spark.sparkContext.broadcast(filter_of(words, n))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows in _by_length(pdf["word"]):
                own = pdf.iloc[rows]
                out = list(neighbours(own["word"].tolist(), letters, table.value))
                if out:
                    at, near = zip(*out)
                    yield own.iloc[list(at)][["word", "n"]].assign(near=list(near))

    # Words are dealt evenly: a task's work is its words', however they were counted.
    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, -(-n // 1000)), n // 200_000)
    found = words.repartition(tasks, "word").mapInPandas(emit, "word string, n bigint, near string")
    return found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def variant_forms(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n), each word once.

    form: the near word of largest n, if that is times the word's n at least; root: the last one that forms lead to. A form's n
    grows by `times` at each step, which bounds the steps by the largest n; the ways are halved in rounds.
    """
    words = materialize(words, "spelling-words")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    joined = words.join(near, "word", "left")
    leads = F.coalesce(-F.col("best.m") >= times * F.col("n"), F.lit(False))
    out = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.m")).alias("form_n")), "spelling-forms")
    ends = out.agg(F.max("n"), F.min("n")).first()
    steps = 0 if ends[0] is None else int(math.log(max(1, ends[0] / max(1, ends[1])), times)) + 1
    roots = out.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for k in range(math.ceil(math.log2(steps + 1))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_sf_next"))
        roots = materialize(roots.join(further, "root", "left").select("word", F.coalesce("_sf_next", "root").alias("root")), f"spelling-roots-{k}")
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
