"""Quality rules by distribution divergence. DataFrame operations only.

Base rules count words, symbols, repeated lines and repeated five-word windows. The divergence compares a document's histogram
of character classes, and that of its language's commonest words, with the language's reference by Jensen-Shannon distance
(base 2, so from 0 to 1). References are means over all documents of the language that are long enough, in which each document
has one vote whatever its length. A distance counts only from a least length on, and its limit allows for what a sample of the
document's length strays by chance.

Defined results: a null text is one without words, an empty text too; rows are judged each for itself, also where they repeat;
documents without a language, or of one with fewer than min_docs long documents, are judged by the base rules alone. Ties among
the commonest words go to the smaller word. Other columns pass through; those named like the results are replaced, and those
that begin with _sf_ dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideframe.llm.common import BLANKS, materialize, text_or_empty

SYMBOLS = "[#*$%&|<>]+"
#: Character classes: a-z, blanks, A-Z, digits, marks, other ASCII, beyond ASCII.
N_CLASSES = 7
#: A document's vote is dealt to its characters and words in whole parts, so that sums don't depend on their order.
VOTE = 10_000_000
WINDOW = 5
#: Places in a text of fewer words fit beside a hash in one number; a longer text has all its windows compared.
PLACE_BITS = 24
#: Slots of a language's common words, a power of two.
SLOTS = 256


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus _sf_w (the words), _sf_n (code points), _sf_chars (code points of each class) and _sf_symbols.

    Regular expressions take long runs out of the whole text once; the rarer classes are counted in the little that is left.
    """
    t = text_or_empty(text)
    left = F.length
    out = docs.withColumn("_sf_w", F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), "")).withColumn("_sf_n", F.length(t))
    out = out.withColumn("_sf_solid", F.length(F.array_join("_sf_w", ""))).withColumn("_sf_r0", F.regexp_replace(t, "[a-z\\x20\\x09-\\x0D]+", ""))
    for k, chars in enumerate(("[A-Z]+", "[0-9]+", "[.,;:!?'\"()-]+", "[\\x00-\\x7F]+"), 1):
        out = out.withColumn(f"_sf_r{k}", F.regexp_replace(f"_sf_r{k - 1}", chars, ""))
    counts = [F.col("_sf_solid") - left("_sf_r0"), F.col("_sf_n") - F.col("_sf_solid"), *(left(f"_sf_r{k - 1}") - left(f"_sf_r{k}") for k in range(1, 5)), left("_sf_r4")]
    out = out.withColumn("_sf_symbols", left("_sf_r2") - left(F.regexp_replace("_sf_r2", SYMBOLS, "")))
    return out.withColumn("_sf_chars", F.array(*(c.cast("long") for c in counts))).drop(*(f"_sf_r{k}" for k in range(5)))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """features() plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    lines = F.filter(F.split(text_or_empty(text), "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    out = features(docs, text).withColumn("_sf_lines", lines).withColumn("_sf_h1", F.transform("_sf_w", lambda w: F.xxhash64(w)))
    # Hashes of the first, third and fifth word from each place (null at the last four): where no two are alike no window repeats.
    joint = lambda a, b: F.zip_with(a, b, lambda x, y: F.shiftleft(x, 1).bitwiseXOR(y))
    size = F.size("_sf_w")
    from_ = lambda k: F.slice("_sf_h1", k + 1, F.greatest(size - k, F.lit(0)))
    out = out.withColumn("_sf_h", joint(joint(F.col("_sf_h1"), from_(2)), from_(WINDOW - 1)))
    # Where some may be, the places of alike hashes are found (sorted as hash and place in one number), and their windows compared.
    place = F.lit((1 << PLACE_BITS) - 1)
    whole = F.slice("_sf_h", 1, F.greatest(size - WINDOW + 1, F.lit(0)))
    packed = F.when(size < 1 << PLACE_BITS, F.sort_array(F.transform(whole, lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long")))))
    distinct = F.size(F.array_distinct("_sf_h")) - 1
    out = out.withColumn("_sf_k", F.when(distinct < size - WINDOW + 1, F.coalesce(packed, F.array().cast("array<bigint>"))))
    alike = lambda x, j: F.coalesce(F.shiftright(x, PLACE_BITS) == F.shiftright(F.get("_sf_k", j), PLACE_BITS), F.lit(False))
    some = F.transform(F.filter("_sf_k", lambda x, j: alike(x, j - 1) | alike(x, j + 1)), lambda x: x.bitwiseAND(place).cast("int"))
    each = F.when(size < 1 << PLACE_BITS, some).otherwise(F.sequence(F.lit(0), size - WINDOW))
    windows = F.sort_array(F.transform(each, lambda i: F.struct(F.array_join(F.slice("_sf_w", i + 1, WINDOW), " ").alias("w"), i.alias("i"))))
    out = out.withColumn("_sf_s", F.when(F.col("_sf_k").isNotNull(), windows))
    like = lambda x, j: F.coalesce(x["w"] == F.get("_sf_s", j)["w"], F.lit(False))
    out = out.withColumn("_sf_p", F.sort_array(F.transform(F.filter("_sf_s", lambda x, j: like(x, j - 1) | like(x, j + 1)), lambda x: x["i"])))
    covered = F.transform("_sf_p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_sf_p", j + 1) - p, F.lit(WINDOW))))
    return out.withColumns(
        {
            "n_words": size.cast("long"),
            "word_chars": F.col("_sf_solid").cast("long"),
            "n_symbols": F.col("_sf_symbols").cast("long"),
            "n_dup_lines": (F.size("_sf_lines") - F.size(F.array_distinct("_sf_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"),
        }
    ).drop("_sf_lines", "_sf_h1", "_sf_h", "_sf_k", "_sf_s", "_sf_p")


def references(docs: DataFrame, n_common: int = 32, longest: int = 6, min_chars: int = 200, min_words: int = 40, min_docs: int = 20, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, chars, common, shares): each language's mean shares of character classes, its commonest words of at most `longest`
    code points, and their mean shares of all words.

    A document of over VOTE words is too long for a whole part of its vote a word, and teaches only character classes.
    """
    rows = features(docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull()))
    # No filter on what is computed: it would be computed twice.
    taught = (F.col("_sf_n") >= min_chars) & (F.size("_sf_w") >= min_words)
    # One pass gives all sums, and no join is there to wait for another pass. Keys that begin with a blank, as no word does, stand
    # for the classes and, the last, for the document itself.
    parts = F.array(*(F.floor(F.get("_sf_chars", F.lit(k)) * VOTE / F.nullif(F.col("_sf_n"), F.lit(0))) for k in range(N_CLASSES)), F.lit(1).cast("long"))
    keys = F.array(*(F.lit(f" {k}") for k in range(N_CLASSES + 1)))
    said = rows.select("lang", F.floor(F.lit(VOTE) / F.nullif(F.size("_sf_w"), F.lit(0))).alias("v"), parts.alias("parts"), F.explode(F.when(taught, F.concat("_sf_w", keys))).alias("w"))
    beside = F.startswith("w", F.lit(" "))
    part = F.get("parts", F.substring("w", 2, 9).cast("int"))
    votes = said.where(beside | (F.length("w") <= longest)).groupBy("lang", "w").agg(F.sum(F.when(beside, part).otherwise(F.col("v"))).alias("votes"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(beside), F.desc("votes"), "w"))
    best = votes.withColumn("place", place).where(F.col("place") <= n_common + N_CLASSES + 1).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "w", "votes"))).alias("c"))
    sums = F.array_sort(F.transform(F.slice("c", 1, N_CLASSES + 1), lambda x: F.struct(x["w"], x["votes"])))
    best = best.select("lang", sums["votes"].alias("s"), F.slice("c", N_CLASSES + 2, n_common).alias("c"))
    best = best.select("lang", F.get("s", F.lit(N_CLASSES)).alias("n_docs"), F.transform(F.slice("s", 1, N_CLASSES), lambda x: x.cast("double")).alias("s"), "c")
    best = best.where((F.col("n_docs") >= min_docs) & (F.size("c") > 0))
    total = F.aggregate("s", F.lit(0.0), lambda a, b: a + b)
    share = F.transform("c.votes", lambda v: v / (F.lit(float(VOTE)) * F.col("n_docs")))
    return best.select("lang", F.transform("s", lambda x: x / total).alias("chars"), F.col("c.w").alias("common"), share.alias("shares"))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two arrays of shares."""
    half = lambda x, y: F.when(x > 0, x * F.log2(x / ((x + y) / 2))).otherwise(0.0)
    return F.aggregate(F.zip_with(p, q, lambda x, y: half(x, y) + half(y, x)), F.lit(0.0), lambda a, b: a + b) / 2


def _rest(shares: Column) -> Column:
    return F.concat(shares, F.array(F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, b: a + b))))


def judge(
    docs: DataFrame, n_common: int = 32, longest: int = 6, min_chars: int = 200, min_words: int = 40, min_docs: int = 20, most_chars: float = 0.3, most_words: float = 0.3, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """docs plus the base counts, base_failed, char_distance, word_distance (null: not compared) and kept.

    most_chars, most_words: the largest distances of a document that stays, beside the allowance of its length.
    """
    if n_common > 78:
        raise ValueError("n_common is at most 78, the printable characters that stand for common words")
    docs = docs.drop(*(c for c in docs.columns if c.lower().startswith("_sf_")))
    known = materialize(references(docs, n_common, longest, min_chars, min_words, min_docs, text, lang), "quality-references")
    # The common words dealt by hash to slots, so that a word is looked for among one or two.
    slot = lambda w: F.xxhash64(w).bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.filter("common", lambda w: slot(w) == k))
    slots = F.transform(slots, lambda x: F.when(F.size(x) > 0, x))
    known = known.select(F.col("lang").alias("_sf_lang"), F.col("chars").alias("_sf_ref"), F.col("common").alias("_sf_common"), F.col("shares").alias("_sf_shares"), slots.alias("_sf_slots"))
    rows = base_counts(docs, text).join(known, F.col(lang) == F.col("_sf_lang"), "left")
    k = F.col("n_words")
    # A character for each common word in the text, so that each one's count is a difference of lengths.
    mark = lambda place: F.char(place + F.lit(47))
    found = F.transform(F.filter("_sf_w", lambda w: F.array_contains(F.get("_sf_slots", slot(w)), w)), lambda w: mark(F.array_position("_sf_common", w)))
    rows = rows.withColumn("_sf_at", F.array_join(found, ""))
    seen = F.transform("_sf_common", lambda c, i: (F.length("_sf_at") - F.length(F.replace(F.col("_sf_at"), mark(i + 1), F.lit("")))) / k)
    # Computed for every row, and a division by zero is an error: a text without words has no shares.
    rows = rows.withColumn("_sf_seen", F.when(k > 0, seen))
    compared = (F.col("_sf_n") >= min_chars) & (k >= min_words)
    rows = rows.withColumn("_sf_cd", F.when(compared, divergence(F.transform("_sf_chars", lambda c: c / F.nullif(F.col("_sf_n"), F.lit(0))), F.col("_sf_ref"))))
    rows = rows.withColumn("_sf_wd", F.when(compared, divergence(_rest(F.col("_sf_seen")), _rest(F.col("_sf_shares")))))
    strays = lambda classes, n: (classes - 1) / (8 * math.log(2) * n)  # noqa: E731  the mean divergence of n draws from the reference
    odd = (F.col("_sf_cd") > most_chars**2 + strays(N_CLASSES, F.col("_sf_n"))) | (F.col("_sf_wd") > most_words**2 + strays(F.size("_sf_common") + 1, k))
    failed = (k < 10) | (100 * F.col("n_repeat_words") > 20 * k)
    distance = lambda c: F.when(F.col(c).isNotNull(), F.round(F.sqrt(F.greatest(F.col(c), F.lit(0.0))), 4))
    rows = rows.withColumns({"base_failed": failed, "char_distance": distance("_sf_cd"), "word_distance": distance("_sf_wd"), "kept": ~(failed | F.coalesce(odd, F.lit(False)))})
    return rows.drop(*(c for c in rows.columns if c.startswith("_sf_")))
