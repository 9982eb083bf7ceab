"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. A lexicon (words, and beginnings of words) is mined from a bounded sample of labelled training rows by its log-odds.
2. Voters look at every whole text: groups of the lexicon, how much of it there is, shouting, repetition, no hit at all.
3. A generative label model estimates the voters' accuracies by expectation-maximisation over the counts of vote patterns of
   the whole corpus (2 ** voters patterns at most), with the sampled labels held fixed; correlations of the voters, given the
   label, lower the weight of those that repeat each other.
4. A linear classifier is fitted to the model's posterior labels of the sampled rows and scores all rows as one expression.

Defined results: null and empty texts get the score of a text without any vote; without usable labels every score is 0;
several labels of one id count as toxic if one of them is; unlabelled and repeated rows are scored like any other.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import free_name, materialize
from strideframe.llm.linear import fit_linear

#: Labelled rows that the lexicon and the classifier are learned from, at most.
SAMPLE_ROWS = 16_000
#: How often a label is held to be right: what it weighs beside the other voters in a posterior.
LABEL_ACCURACY = 0.99
#: Entries of the lexicon, at most.
LEXICON = 3_000
GROUPS = 4
VOTERS = [*(f"lexicon_{i}" for i in range(GROUPS)), "two_entries", "dense", "very_dense", "no_entry", "shouting", "repetition"]
VALUES = ["distinct", "hits", "weight", "density"]
_WORD = re.compile(r"[^\W\d_]+")
_STEMS = (4, 5, 6)


def tokens(word: str) -> list[str]:
    """A lower-cased word and its beginnings, marked by *."""
    return [word, *(word[:n] + "*" for n in _STEMS if len(word) > n)]


def sample_of(labels: DataFrame, doc_id: str = "doc_id", toxic: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, y) of at most `rows` labelled ids, chosen by a hash of the id."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg((F.max(toxic) > 0).cast("int").alias("y"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def training_rows(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, y): one row for each sampled id that has a document; of several texts the one of the smallest hash.

    Partial minima before the shuffle, so that an id on very many rows is one row of each task.
    """
    first = F.min(F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")).alias("first")
    return rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(first).select("doc_id", "first.text", "y")


def mine(rows: DataFrame, least: int = 4, odds: float = 2.0, chance: float = 0.05, entries: int = LEXICON) -> dict[str, float]:
    """token -> smoothed log-odds of the tokens of rows (text, y) that speak for y = 1: those in at least `least` distinct toxic
    texts, and more of them than chance gives any of all tokens looked at (Bonferroni's bound, of the likelihood ratio). That
    asks for a few distinct texts whatever the size of the sample: no share of them, so that rare tokens count too."""
    rows = rows.groupBy("y", F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("n")).select("text", "y")

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = (Counter(), Counter())
        docs = [0, 0]
        for pdf in batches:
            for t, y in zip(pdf["text"], pdf["y"]):
                docs[y] += 1
                of[y].update({x for w in set(_WORD.findall((t or "").lower())) for x in tokens(w)})
        for y in (0, 1):
            yield pd.DataFrame({"token": [*of[y], ""], "y": y, "n": [*of[y].values(), docs[y]]})

    counts = rows.select("text", "y").mapInPandas(seen, "token string, y int, n bigint").groupBy("token").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    counts = materialize(counts.where((F.col("a") >= least) | (F.col("token") == "")), "toxic-tokens")
    total = counts.where("token = ''").first()
    if not total or not total["a"] or not total["b"]:
        return {}
    weight = F.log((F.col("a") + 0.5) / (total["a"] + 1)) - F.log((F.col("b") + 0.5) / (total["b"] + 1))
    tests, p = max(1, counts.count() - 1), total["a"] / (total["a"] + total["b"])
    n = F.col("a") + F.col("b")
    unlike = F.col("a") * F.log(F.col("a") / (n * p)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (n * (1 - p)))).otherwise(0.0)
    found = counts.where((F.col("token") != "") & (unlike >= math.log(tests / chance))).withColumn("w", weight).where(F.col("w") >= odds).orderBy(F.desc(F.col("w") * F.sqrt("a")), "token").limit(entries).collect()
    return {r["token"]: float(r["w"]) for r in found}


def look(text: str | None, lexicon: dict[str, float], group: dict[str, int]) -> list[float]:
    """Votes in the order of VOTERS, then VALUES."""
    text = text or ""
    words = Counter(_WORD.findall(text.lower()))
    n = sum(words.values())
    hits = distinct = 0
    weight, groups = 0.0, [0] * GROUPS
    for w, c in words.items():
        best = max((x for x in tokens(w) if x in lexicon), key=lexicon.__getitem__, default=None)
        if best:
            hits, distinct, weight = hits + c, distinct + 1, weight + lexicon[best]
            groups[group[best]] = 1
    density = hits / max(n, 1)
    upper = sum(map(str.isupper, text))
    letters = sum(map(str.isalpha, text)) if upper > 20 else 0
    votes = [*groups, distinct >= 2, density >= 0.005, density >= 0.03, not hits, upper > 0.6 * letters > 0, n >= 20 and max(words.values()) > 0.3 * n]
    return [*map(float, votes), float(np.log1p(distinct)), float(np.log1p(hits)), float(np.log1p(weight)), density]


def votes_of(text: str | Column, spark, lexicon: dict[str, float]) -> Column:
    """array<double>: VOTERS, then VALUES."""
    ordered = sorted(lexicon, key=lambda t: (-lexicon[t], t))
    shared = spark.sparkContext.broadcast((lexicon, {t: i % GROUPS for i, t in enumerate(ordered)}))

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([look(t, *shared.value) for t in x])

    return of(text)


@dataclass
class LabelModel:
    prior: float
    #: P(vote | label) as [label][voter].
    rates: np.ndarray
    #: Correlations of the voters' residuals given the label.
    correlation: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        """A voter that k others repeat counts as 1 / (1 + k)."""
        c = np.maximum(0, self.correlation)
        return 1 / np.maximum(1, c.sum(0))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(label 1) of rows of 0 and 1."""
        one, zero = (votes * np.log(r) + (1 - votes) * np.log(1 - r) for r in self.rates[::-1])
        z = np.log(self.prior / (1 - self.prior)) + (one - zero) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_label_model(votes: np.ndarray, n: np.ndarray, known: np.ndarray, rounds: int = 25) -> LabelModel:
    """Patterns, how often each occurs, and P(label 1) where it is known (else nan)."""
    held = ~np.isnan(known)
    prior = float(np.clip((n[held] @ known[held] + 1) / (n[held].sum() + 2), 1e-4, 0.5))
    p = np.where(held, known, prior)
    model = None
    for step in range(rounds):
        own = n * held if step == 0 and held.any() else n
        sums = np.array([own @ (1 - p), own @ p])
        rates = np.stack([(own * q) @ votes for q in (1 - p, p)])
        rates = np.clip((rates + 0.5) / (sums[:, None] + 1), 1e-3, 1 - 1e-3)
        residual = np.concatenate([votes - rates[0], votes - rates[1]])
        w = np.concatenate([own * (1 - p), own * p])
        cov = (residual * w[:, None]).T @ residual / max(w.sum(), 1)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        model = LabelModel(float(np.clip((sums[1] + 1) / (sums.sum() + 2), 1e-4, 1 - 1e-4)), rates, np.abs(cov / np.outer(sd, sd)))
        p = np.where(held, known, model.posterior(votes))
    return model


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic") -> DataFrame:
    """(doc_id, text_hash, score, predicted) of each row of docs, learned from labels, which holds training rows alone."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample = materialize(sample_of(labels, doc_id, toxic), "toxic-sample")
    train = materialize(training_rows(rows, sample), "toxic-training")
    lexicon = mine(train)
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    seen = materialize(rows.select("doc_id", key, votes_of(F.col("text"), spark, lexicon).alias("x")), "toxic-votes")
    v = len(VOTERS)
    pattern = F.slice("x", 1, v)
    counts = seen.groupBy(pattern.alias("votes")).agg(F.count("*").alias("n")).collect()  # 2 ** v rows at most
    fit = train.select(votes_of(F.col("text"), spark, lexicon).alias("x"), "y").collect()  # SAMPLE_ROWS at most
    weights = np.zeros(1 + v + len(VALUES))
    if fit and len({r["y"] for r in fit}) == 2 and lexicon:
        x, y = np.array([r["x"] for r in fit]), np.array([r["y"] for r in fit], float)
        labelled = Counter(tuple(a[:v]) for a in x)
        ones = Counter(tuple(a[:v]) for a, b in zip(x, y) if b)
        patterns = [(tuple(r["votes"]), r["n"], np.nan) for r in counts]
        patterns += [(k, c - ones[k], 0.0) for k, c in labelled.items() if c > ones[k]] + [(k, c, 1.0) for k, c in ones.items()]
        model = fit_label_model(np.array([p[0] for p in patterns]), np.array([p[1] for p in patterns], float), np.array([p[2] for p in patterns]))
        # The posterior of a sampled row, its label being one more voter.
        p = np.clip(model.posterior(x[:, :v]), 1e-6, 1 - 1e-6)
        target = 1 / (1 + np.exp(-np.log(p / (1 - p)) - (2 * y - 1) * np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))))
        weights = fit_linear(np.column_stack([np.ones(len(x)), x]), target)
        z = F.lit(float(weights[0])) + sum((F.get("x", F.lit(i)) * float(w) for i, w in enumerate(weights[1:])), F.lit(0.0))
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    else:
        score = F.lit(0.0)
    return seen.select("doc_id", "text_hash", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic") -> DataFrame:
    """docs without those predicted toxic; all columns of docs stay, whatever their names."""
    id_name, hash_name = free_name(docs, "rejected_id"), free_name(docs, "rejected_hash")
    bad = score_documents(docs, labels, text, doc_id, toxic).where("predicted = 1").select(F.col("doc_id").alias(id_name), F.col("text_hash").alias(hash_name)).distinct()
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col(id_name)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(hash_name)), "left_anti")
