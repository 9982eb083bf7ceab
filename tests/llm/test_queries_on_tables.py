"""Queries without SQL on whole tables: held-out labels, and brute force where there is one."""

import os
import re
import zlib
from collections import Counter

import pytest

from strideframe.llm import queries

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op10_on_held_out_documents(spark):
    docs, right, n = documents(spark), 0, 0
    rows = queries.op10_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.held_out and docs[r.doc_id].lang:
            n, right = n + 1, right + (r.lang_pred == docs[r.doc_id].lang)
    assert n > 250 and right >= 0.98 * n


def test_op6_on_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = Counter()
    rows = queries.op6_toxicity(spark, SF).collect()
    assert len(rows) == len(documents(spark))
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
        if r.held_out and labels.get(r.doc_id) is not None:
            seen[labels[r.doc_id], r.predicted] += 1
    assert seen[0, 1] <= 0.02 * (seen[0, 0] + seen[0, 1]) and seen[1, 1] >= 0.5 * (seen[1, 0] + seen[1, 1])


def test_op3_base_places_equal_brute_force(spark):
    docs = documents(spark)
    for r in queries.op3_license_scan(spark, SF).collect():
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), docs[r.doc_id].text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        found = [(i, label) for phrase, label in PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
        labels = {label for _, label in found}
        places = [i for i, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
