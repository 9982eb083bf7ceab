"""License scans by diagonal voting. DataFrame operations only.

All rolling word k-grams of the texts are hashed and joined to the positions of the same hashes in the license templates (a
fixed, small table: it is broadcast). Matches vote for their diagonal, document position less template position, with partial
sums before the shuffle; diagonals of a document and template that are close are merged, whatever other diagonals lie between,
so that inserted or missing words don't break a span; a span is verified by the words of the template that it covers, and by how many of its own words match.

Hashes have 64 bits and the templates hold under 2,000 k-grams, so that about one k-gram in 10 ** 16 matches by chance.

Defined results: null and empty texts have no words, no labels and score 0; rows that repeat an id and a text get equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideframe.llm.common import ascii_lower, text_or_empty

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public license texts and notices, by label.
TEMPLATES = {
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0.""",
    "bsd-3-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "cc-by-nc-4.0-notice": """Licensed under CC BY-NC 4.0.""",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "gpl-3.0-notice": """This work is licensed under the GNU General Public License, version 3.""",
    "mit-notice": """Released under the MIT License.""",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
}


def spaced_words(text: Column) -> Column:
    """The words, A-Z lower-cased, with one blank between them."""
    return F.btrim(F.regexp_replace(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def words_of(spaced: Column) -> Column:
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def kgrams(words: Column, k: int) -> Column:
    """array<bigint>: the hash of every k words that follow each other."""
    return F.when(F.size(words) < k, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k))))


def phrase_places(spaced: Column, words: Column, phrase: str) -> Column:
    """array<int>: where the phrase's words stand, from 0."""
    parts = phrase.split(" ")
    at = lambda i: sum((((F.get(words, i + j) == p).cast("int")) for j, p in enumerate(parts)), F.lit(0)) == len(parts)
    return F.when(F.contains(F.concat(F.lit(" "), spaced, F.lit(" ")), F.lit(f" {phrase} ")), F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), at)).otherwise(F.array().cast("array<int>"))


def template_grams(spark: SparkSession, k: int, templates: dict[str, str]) -> DataFrame:
    """(gram, label, at, n_words, said) of every position of every template, said: its k words; as large as the templates are."""
    rows = spark.createDataFrame(sorted(templates.items()), "label string, text string").withColumn("words", words_of(spaced_words(F.col("text"))))
    return rows.select("label", F.size("words").alias("n_words"), F.posexplode(kgrams(F.col("words"), k)).alias("at", "gram"), "words").withColumn("said", F.slice("words", F.col("at") + 1, k)).drop("words")


def merged_diagonals(votes: DataFrame, keys: list[str], slack: int, reach: int, rounds: int = 2) -> DataFrame:
    """votes with `span`, the same for diagonals that hang together: at most slack apart, and at most reach words between them.

    Rows are cut where the diagonal jumps by more than slack, whatever stands in between in the document, and each part where
    no earlier row reaches. Neither cut parts two rows that belong together; the second round parts those that only met
    through a row that the first one took away.
    """
    rows = votes.withColumn("span", F.lit(0).cast("long"))
    for _ in range(rounds):
        own = Window.partitionBy(*keys, "span")
        before = own.orderBy("lo", "diagonal").rowsBetween(Window.unboundedPreceding, -1)
        for order, near in (
            (["diagonal"], F.col("diagonal") - F.lag("diagonal").over(own.orderBy("diagonal")) <= slack),
            (["lo", "diagonal"], F.col("lo") - F.max("hi").over(before) <= reach),
        ):
            whole = Window.partitionBy(*keys).orderBy("span", *order).rowsBetween(Window.unboundedPreceding, 0)
            rows = rows.withColumn("cut", F.when(near, F.lit(0)).otherwise(F.lit(1))).withColumn("span", F.sum("cut").over(whole)).drop("cut")
    return rows


def license_spans(rows: DataFrame, keys: list[str], words: str, k: int = 4, slack: int = 8, cover: float = 0.6, purity: float = 0.6, templates: dict[str, str] | None = None) -> DataFrame:
    """(*keys, label, first_word, last_word, coverage) of verified spans in rows' array of words.

    slack: words that may be missing or too many between two parts of a span; cover: share of the template's words that a span
    must hold; purity: share of the span's words that must match.
    """
    known = F.broadcast(template_grams(rows.sparkSession, k, templates or TEMPLATES))
    grams = rows.select(*keys, F.col(words).alias("all_words"), F.posexplode(kgrams(F.col(words), k)).alias("place", "gram"))
    # A vote counts only if the document's words themselves are the template's.
    agreed = grams.join(known, "gram").where(F.slice("all_words", F.col("place") + 1, k) == F.col("said"))
    votes = agreed.withColumn("diagonal", F.col("place") - F.col("at")).groupBy(*keys, "label", "n_words", "diagonal").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.collect_set("at").alias("ats"))
    islands = merged_diagonals(votes, [*keys, "label"], slack, slack + k)
    covered = lambda c: F.size(F.array_distinct(F.flatten(F.transform(c, lambda t: F.sequence(t, t + (k - 1))))))
    spans = islands.groupBy(*keys, "label", "n_words", "span").agg(F.min("lo").cast("long").alias("first_word"), (F.max("hi") + (k - 1)).cast("long").alias("last_word"), covered(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("matched"))
    spans = spans.withColumn("coverage", F.col("matched") / F.col("n_words"))
    return spans.where((F.col("coverage") >= cover) & (F.col("matched") >= purity * (F.col("last_word") - F.col("first_word") + 1))).select(*keys, "label", "first_word", "last_word", "coverage")


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """One row for each of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("th"), spaced_words(text_or_empty(text)).alias("spaced")).withColumn("words", words_of(F.col("spaced")))
    found = license_spans(rows, ["doc_id", "th"], "words", **how).groupBy(F.col("doc_id").alias("id2"), F.col("th").alias("th2")).agg(F.collect_set("label").alias("own"), F.max("coverage").alias("best"), F.count("*").alias("n_spans"))

    def labelled(phrase: str, label: str) -> Column:
        return F.transform(phrase_places(F.col("spaced"), F.col("words"), phrase), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    places = F.concat(*(labelled(*x) for x in PHRASES.items()))
    base = rows.select("doc_id", "th", F.size("words").cast("long").alias("n_words"), places.alias("places"))
    joined = base.join(found, base["doc_id"].eqNullSafe(found["id2"]) & (base["th"] == found["th2"]), "left")
    labels = F.array_distinct(F.col("places.label"))
    return joined.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.at").alias("first_word"),
        F.array_max("places.at").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("own", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
    )
