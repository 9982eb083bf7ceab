"""Language identification of documents in several languages: a mixture of languages is fitted to each document.

Training counts hashed character trigrams per language over all training rows, summed in each task before the shuffle. A
document's language proportions come from expectation-maximisation over its trigrams' likelihoods; nested language sets,
largest proportions first, are compared by likelihood less a penalty per language, and the set with the best value is kept.

Defined results: null texts and texts without a letter are `und` with score 0, and so is every text where nothing was learned;
rows without a language teach nothing; rows that repeat an id are predicted alike if their texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trigrams are hashed to 2 ** BITS buckets.
BITS = 15
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_MIX = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def buckets(text: str | None) -> np.ndarray:
    """The buckets of the trigrams of lower-cased words with a blank on either side."""
    words = _OTHER.sub(" ", f" {text or ''} ".lower())
    c = np.frombuffer(words.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    if len(c) < 3:
        return np.empty(0, np.int64)
    h = c[:-2] * _MIX[0] + c[1:-1] * _MIX[1] + c[2:] * _MIX[2]
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(2246822507)) >> np.uint32(32 - BITS)).astype(np.int64)


def trigram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all rows with a language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for t, code in zip(pdf["text"], pdf["lang"]):
                h = buckets(t)
                if len(h):
                    own = sums.setdefault(code, np.zeros(1 << BITS, np.int64))
                    own += np.bincount(h, minlength=1 << BITS)
        for code, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": code, "bucket": at.astype(np.int32), "n": own[at]})

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    return rows.mapInPandas(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Mixtures:
    """Language names and their bucket probabilities; small and of a fixed size, whatever the corpus."""

    def __init__(self, names: list[str], counts: np.ndarray, smoothing: float = 0.5, penalty: float = 3.0, rounds: int = 12):
        self.names, self.penalty, self.rounds = names, penalty, rounds
        self.p = ((counts + smoothing) / (counts.sum(0) + smoothing * len(counts))).astype(np.float64)

    def shares(self, p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions and log-likelihood of the languages in the columns of p."""
        w, n = np.full(p.shape[1], 1 / p.shape[1]), c.sum()
        if p.shape[1] > 1:
            for _ in range(self.rounds):
                w = w * ((c / (p @ w)) @ p) / n
        return w, float(c @ np.log(p @ w))

    def predict(self, text: str | None) -> tuple[str, float, list[str]]:
        """Main language, its proportion, and the set of languages, largest first."""
        if not self.names or not text or not _LETTER.search(text):
            return "und", 0.0, []
        all_c = np.bincount(buckets(text), minlength=1 << BITS)
        at = np.flatnonzero(all_c)
        c, p = all_c[at].astype(np.float64), self.p[at]
        w, _ = self.shares(p, c)
        order, best = np.argsort(-w, kind="stable"), (-np.inf, None, None)
        for k in range(1, len(order) + 1):
            own = order[:k]
            share, fit = self.shares(p[:, own], c)
            value = fit - self.penalty * (k - 1) * np.log(max(c.sum(), 2))
            if value <= best[0]:
                break
            best = (value, own, share)
        _, own, share = best
        rank = np.argsort(-share, kind="stable")
        return self.names[own[rank[0]]], float(min(1.0, share[rank[0]])), [self.names[i] for i in own[rank]]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", **how) -> Mixtures:
    rows = trigram_counts(docs, text, lang).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("of")).collect()  # at most 2 ** BITS numbers a language
    rows = sorted(rows, key=lambda r: r["lang"])
    counts = np.zeros((1 << BITS, len(rows)), np.int64)
    for k, r in enumerate(rows):
        for b, n in r["of"]:
            counts[b, k] = n
    return Mixtures([r["lang"] for r in rows], counts, **how)


def predicted(model: Mixtures, spark, text: str | Column) -> Column:
    """struct<lang_pred, score, languages>."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, languages array<string>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in x], columns=["lang_pred", "score", "languages"])

    return of(text)
