"""SentencePiece encoding and decoding as a lattice of the distinct words.

Words (runs of blanks with what follows them; a piece never goes past a word) are made distinct over the whole corpus. All
substrings of a word that are no longer than the longest piece are matched to the piece table: it is the vocabulary, whatever
the corpus. A fold takes the edges place by place (Viterbi: the best edge into each place with its back pointer) and walks
back. Work grows with a word's length and not with its square. Characters that no piece has become their bytes.

There are two forms with the same result. `relational`: substrings are exploded block by block and joined to the broadcast
piece table, edges are grouped by block and by word (which keeps the partitioning by word, so the lattice isn't shuffled), and
higher-order aggregates fold them. By default each task walks the lattice of one word after the other in Arrow batches, with
the same piece table: the higher-order functions are interpreted and take many times the CPU (README has the figures).

One fold serves both types of model. Unigram: an edge adds its score. BPE: the best sum of its scores is not what such a model
means (they are ranks of merges). There an edge adds nothing, but may follow another only if the model leaves the two apart:
no merge across their border may come before the merges that use up its two sides. A path of which all neighbours are so is
the one that merging gives, and every place has one edge that ends such a path to it. The sides are the pieces that end the
left edge and begin the right one on their way of being merged; the piece table holds them.

Texts then get their words' ids by a join: the most frequent words (a fixed number of short ones) are broadcast, so that only
rare ones are shuffled.

Defined results: null and empty texts have no pieces; a text that holds U+2581 itself decodes to a blank there, as in the
library, and so has no round trip; rows that repeat an id or an id and a text have results of their own each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm.common import lookup_hot, materialize, text_or_empty

BLANK = "▁"
#: The score of an unknown character lies so far below the lowest piece's.
UNKNOWN = 10.0
#: Words that are broadcast, at most, and their characters, at most.
FREQUENT, SHORT = 1 << 18, 32
#: Characters of a block.
BLOCK = 64
#: Partitions of words for each shuffle partition of the session.
PARTS = 4
#: A side is (length, rank of the piece that it is merged into), in one number.
_BITS = 20
_NEVER = (1 << _BITS) - 1


def _is_letter(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM"


class Vocabulary:
    """What a model file holds."""

    def __init__(self, path: str, merges: bool = True):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(m.get_piece_size())
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in every if m.is_byte(i)}
        self.setup([(m.id_to_piece(i), i, float(m.get_score(i))) for i in every if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))], m.unk_id(), merges)

    def setup(self, pieces: list[tuple[str, int, float]], unknown_id: int, merges: bool) -> None:
        #: Whether it is a BPE model.
        self.merges = merges
        self.pieces = sorted(pieces, key=lambda p: (-p[2], p[1]))
        self.longest = max(len(p) for p, _, _ in pieces)
        self.unknown_id, self.unknown_score = unknown_id, min(s for _, _, s in pieces) - UNKNOWN
        used = {c for p, _, _ in pieces for c in p if len(p) > 1}
        #: White space that is in no longer piece: words end there as well.
        self.breaks = "".join(c for c in "\n\r\t" if c not in used)
        #: Whether no piece has both letters and other characters: words end between them as well.
        self.classes = all(len({_is_letter(c) for c in p.lstrip(BLANK)}) < 2 for p, _, _ in pieces)
        if any(BLANK in p.lstrip(BLANK) for p, _, _ in pieces) or len(pieces) >= _NEVER or self.longest >= 1 << (31 - _BITS):
            raise ValueError("a piece goes past a word's end, or the vocabulary is too large")

    def sides(self) -> dict[str, tuple[list[int], list[int]]]:
        """piece -> what begins it and what ends it on its way of being merged, itself included; only pieces that merging reaches."""
        rank = {p: r for r, (p, _, _) in enumerate(self.pieces)}

        def last_cut(p: str) -> int:
            cuts = list(range(len(p) + 1))
            while len(cuts) > 3:
                best, at = min((rank.get(p[a:b], _NEVER), i) for i, (a, b) in enumerate(zip(cuts, cuts[2:])))
                if best == _NEVER:
                    return 0
                del cuts[at + 1]
            return cuts[1]

        cut = {p: last_cut(p) for p in rank if len(p) > 1}
        out = {}
        for p in rank:
            if cut.get(p, 1):
                both = []
                for part in (lambda x: x[: cut[x]], lambda x: x[cut[x] :]):
                    own, x = [len(p) << _BITS | _NEVER], p
                    while len(x) > 1:
                        into, x = rank[x], part(x)
                        own.append(len(x) << _BITS | into)
                    both.append(own)
                out[p] = (both[0], both[1])
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, rank, score, begins, ends)"""
        sides = self.sides() if self.merges else {p: ([], []) for p, _, _ in self.pieces}
        rows = [(p, i, r, 0.0 if self.merges else s, *sides[p]) for r, (p, i, s) in enumerate(self.pieces) if p in sides]
        return spark.createDataFrame(rows, "piece string, id int, rank int, score double, begins array<int>, ends array<int>")

    def walker(self) -> Walker:
        sides = self.sides() if self.merges else {p: ([], []) for p, _, _ in self.pieces}
        both = [sides.get(p, ([], [])) for p, _, _ in self.pieces]
        pairs = lambda own: [(x >> _BITS, x & _NEVER) for x in own]
        data = {i: p.replace(BLANK, " ").encode() for p, i, _ in self.pieces} | {i: bytes([b]) for b, i in self.bytes.items()}
        rank = {p: r for r, (p, _, _) in enumerate(self.pieces) if p in sides}
        scores = None if self.merges else [x for _, _, x in self.pieces]
        return Walker(rank, [i for _, i, _ in self.pieces], [dict(pairs(b)) for b, _ in both], [pairs(e) for _, e in both], scores, self.unknown_score, self.longest, self.bytes if len(self.bytes) == 256 else {}, self.unknown_id, data)

    def decoded(self, spark: SparkSession) -> DataFrame:
        """(id, data): the bytes that each id stands for."""
        rows = [(i, p.replace(BLANK, " ").encode()) for p, i, _ in self.pieces] + [(i, bytes([b])) for b, i in self.bytes.items()]
        return spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id int, data binary")


def words_of(text: Column, vocabulary: Vocabulary) -> Column:
    """array<string>: the words of a text, blanks marked, one put before the text."""
    marked = F.concat(F.lit(BLANK), F.replace(text, F.lit(" "), F.lit(BLANK)))
    b = vocabulary.breaks.replace("\n", r"\n").replace("\r", r"\r").replace("\t", r"\t")
    one = f"[{b}]|" if b else ""
    if vocabulary.classes:
        pattern = rf"{one}{BLANK}*+[\p{{L}}\p{{M}}]++|{BLANK}*+[^\p{{L}}\p{{M}}{BLANK}{b}]++|{BLANK}++"
    else:
        pattern = f"{one}{BLANK}++[^{BLANK}{b}]*+|[^{BLANK}{b}]++"
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(marked, F.lit(pattern), F.lit(0)))


def _byte_ids(char: Column, vocabulary: Vocabulary) -> Column:
    if len(vocabulary.bytes) < 256:
        return F.array(F.lit(vocabulary.unknown_id))
    ids = F.array(*(F.lit(vocabulary.bytes[b]) for b in range(256)))
    hexed = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)), lambda i: F.get(ids, F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("int")))


#: Two hashes stand for a word: its edges don't carry the word itself.
KEY = ["k1", "k2"]


def keyed(words: DataFrame) -> DataFrame:
    """words with KEY, dealt by it. The number of partitions is given: words are few bytes, but many edges and much work each."""
    partitions = PARTS * int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words.withColumn("k1", F.xxhash64("word")).withColumn("k2", F.xxhash64(F.lit(1), "word")).repartition(partitions, *KEY)


def edges_of(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(k1, k2, block, word, n, edge): the edges of each word; word and n stand at its first edge alone."""
    blocks = words.select(*KEY, "word", "n", F.posexplode(F.transform(F.sequence(F.lit(0), ((F.length("word") - 1) / BLOCK).cast("int")), lambda b: F.substring("word", b * BLOCK + 1, F.lit(BLOCK + vocabulary.longest - 1)))).alias("block", "part"))
    size = F.length("part")
    starts = blocks.select("*", F.explode(F.sequence(F.lit(0), F.least(size, F.lit(BLOCK)) - 1)).alias("start"))
    spans = starts.select("*", F.explode(F.sequence(F.lit(1), F.least(size - F.col("start"), F.lit(vocabulary.longest)))).alias("len"))
    # A character without a piece of its own is an edge too.
    found = spans.withColumn("piece", F.substring("part", F.col("start") + 1, F.col("len"))).join(F.broadcast(vocabulary.table(words.sparkSession)), "piece", "left")
    found = found.where(F.col("id").isNotNull() | (F.col("len") == 1))
    first = (F.col("block") == 0) & (F.col("start") == 0) & (F.col("len") == 1)
    none = F.array().cast("array<int>")
    alone = F.array(F.lit(1 << _BITS | _NEVER)) if vocabulary.merges else none
    edge = F.struct("start", "len", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("rank", F.lit(_NEVER)).alias("rank"), F.coalesce("score", F.lit(0.0 if vocabulary.merges else vocabulary.unknown_score)).alias("score"), F.coalesce("begins", alone).alias("begins"), F.coalesce("ends", none).alias("ends"))
    return found.select(*KEY, "block", F.when(first, F.col("word")).alias("word"), F.when(first, F.col("n")).alias("n"), edge.alias("edge"))


def lattice(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """words (word, distinct, and n) with KEY and the ids array<int> of the path; dealt by KEY."""
    blocks = edges_of(keyed(words), vocabulary).groupBy(*KEY, "block").agg(F.max("word").alias("word"), F.max("n").alias("n"), F.collect_list("edge").alias("edges"))
    by_start = F.transform(F.sequence(F.lit(0), F.array_max("edges.start")), lambda i: F.filter("edges", lambda e: e["start"] == i))
    rows = blocks.select(*KEY, "block", "word", "n", by_start.alias("places")).groupBy(*KEY).agg(F.max("word").alias("word"), F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("block", "places"))).alias("blocks"))
    rows = rows.select(*KEY, "word", "n", F.flatten(F.col("blocks.places")).alias("places"))
    found = rows.withColumn("best", forward(F.col("places"))).withColumn("path", walked_back(F.col("best")))
    ids = F.flatten(F.transform("path", lambda p: F.when(p["id"] >= 0, F.array(p["id"])).otherwise(_byte_ids(F.substring("word", p["start"] + 1, F.lit(1)), vocabulary))))
    return found.select(*KEY, "word", "n", ids.alias("ids"))


def let(value: Column, body) -> Column:
    """body of a value that is computed once, inside a higher-order function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_OPEN = "array<struct<end:int,score:double,back:int,id:int,ends:array<int>>>"
_NODE = "array<struct<start:int,id:int>>"


def forward(places: Column) -> Column:
    """Viterbi: for each place, from 0 to the word's end, the edge (start, id) of the best path to it. places: edges by their start.

    Of paths of equal score the one whose last piece starts first wins, as in the library.
    """

    def apart(edge: Column, crossed: Column) -> Column:
        return ~F.exists(crossed, lambda c: F.exists(edge["begins"], lambda b: (b >= c) & (b <= c.bitwiseOR(_NEVER))))  # of equal length, and merged no sooner

    def crossing(node: Column, at: Column) -> Column:
        """What a merge across the place would take of the right side, and its rank: of merges that come before the left side is used up."""

        def of(side: Column) -> Column:
            size, into = F.shiftright(side, _BITS), side.bitwiseAND(_NEVER)
            return F.transform(F.filter(F.get(places, at - size), lambda e: (e["len"] > size) & (e["rank"] < into)), lambda e: F.shiftleft(e["len"] - size, _BITS).bitwiseOR(e["rank"]))

        return F.flatten(F.transform(node["ends"], of))

    def step(state: Column, at: Column) -> Column:
        def at_node(node: Column) -> Column:
            new = let(crossing(node, at), lambda crossed: F.transform(F.filter(F.coalesce(F.get(places, at), F.slice(F.get(places, F.lit(0)), 1, 0)), lambda e: apart(e, crossed)), lambda e: F.struct((at + e["len"]).alias("end"), (node["score"] + e["score"]).alias("score"), (-at).alias("back"), e["id"].alias("id"), e["ends"].alias("ends"))))
            return F.struct(F.concat(F.filter(state["open"], lambda o: o["end"] > at), new).cast(_OPEN).alias("open"), F.concat(state["nodes"], F.array(F.struct((-node["back"]).alias("start"), node["id"].alias("id"))).cast(_NODE)).alias("nodes"))

        return let(F.array_max(F.filter(state["open"], lambda o: o["end"] == at)), at_node)

    def of_block(state: Column, block: Column) -> Column:
        zero = F.struct(state["open"].alias("open"), F.array().cast(_NODE).alias("nodes"))
        folded = F.aggregate(F.sequence(block * BLOCK, F.least(F.size(places), block * BLOCK + (BLOCK - 1))), zero, step)
        return let(folded, lambda f: F.struct(f["open"].alias("open"), F.concat(state["nodes"], F.array(f["nodes"])).alias("nodes")))

    start = F.array(F.struct(F.lit(0).alias("end"), F.lit(0.0).alias("score"), F.lit(0).alias("back"), F.lit(-1).alias("id"), F.array().cast("array<int>").alias("ends"))).cast(_OPEN)
    return F.aggregate(F.sequence(F.lit(0), (F.size(places) / BLOCK).cast("int")), F.struct(start.alias("open"), F.array().cast(f"array<{_NODE}>").alias("nodes")), of_block, lambda s: F.flatten(s["nodes"]))


def walked_back(best: Column) -> Column:
    """array<struct<start, id>>: the edges of the best path to the last place."""
    last = F.size(best) - 1

    def step(state: Column, at: Column) -> Column:
        return F.when((state["at"] != at) | (at == 0), state).otherwise(let(F.get(best, at), lambda node: F.struct(node["start"].alias("at"), F.concat(state["path"], F.array(node).cast(_NODE)).alias("path"))))

    def of_block(state: Column, block: Column) -> Column:
        folded = F.aggregate(F.sequence(F.least(last, block * BLOCK + (BLOCK - 1)), block * BLOCK, F.lit(-1)), F.struct(state["at"].alias("at"), F.array().cast(_NODE).alias("path")), step)
        return let(folded, lambda f: F.struct(f["at"].alias("at"), F.concat(state["path"], F.array(f["path"])).alias("path")))

    zero = F.struct(last.alias("at"), F.array().cast(f"array<{_NODE}>").alias("path"))
    return F.aggregate(F.sequence((last / BLOCK).cast("int"), F.lit(0), F.lit(-1)), zero, of_block, lambda s: F.reverse(F.flatten(s["path"])))


def decode(rows: DataFrame, keys: list[str], ids: str, vocabulary: Vocabulary) -> DataFrame:
    """(*keys, text): the bytes of the ids in order, blanks unmarked, the blank that was put before the text dropped."""
    flat = rows.select(*keys, F.posexplode(ids).alias("at", "id")).join(F.broadcast(vocabulary.decoded(rows.sparkSession)), "id")
    parts = F.array_sort(F.collect_list(F.struct("at", F.hex("data").alias("h"))))
    said = F.decode(F.unhex(F.array_join(F.col("parts.h"), "")), "UTF-8")
    return flat.groupBy(*keys).agg(parts.alias("parts")).select(*keys, F.substring(said, F.lit(2), F.length(said)).alias("text"))


@dataclass
class Walker:
    """What walks the lattice of one word: the piece table with its sides or scores, and the bytes of all ids."""

    rank: dict[str, int]
    ids: list[int]
    begins: list[dict[int, int]]
    ends: list[list[tuple[int, int]]]
    scores: list[float] | None
    unknown: float
    longest: int
    byte_ids: dict[int, int]
    unknown_id: int
    data: dict[int, bytes]

    def path(self, word: str) -> list[int]:
        """The ids of a word, as forward and walked_back give them."""
        n, get, longest = len(word), self.rank.get, self.longest
        edges = []
        for s in range(n):
            own = [(s + 1, get(word[s], -1))]
            for e in range(s + 2, min(n, s + longest) + 1):
                r = get(word[s:e])
                if r is not None:
                    own.append((e, r))
            edges.append(own)
        back: list[tuple | None] = [None] * (n + 1)
        back[0] = (0.0, 0, -1)
        for s, own in enumerate(edges):
            score, _, left = back[s]
            if self.scores is not None:
                for e, r in own:
                    new = (score + (self.scores[r] if r >= 0 else self.unknown), -s, r)
                    if back[e] is None or new > back[e]:
                        back[e] = new
                continue
            crossed = [(e - s, r) for size, into in (self.ends[left] if left >= 0 else ()) for e, r in edges[s - size] if e > s and 0 <= r < into]
            for e, r in own:
                if back[e] is None and not (crossed and r >= 0 and any(c <= self.begins[r].get(size, -1) for size, c in crossed)):
                    back[e] = (0.0, -s, r)
        out, at = [], n
        while at:
            _, start, r = back[at]
            out.append(self.ids[r] if r >= 0 else None)
            if r < 0:
                out[-1:] = [self.byte_ids[b] for b in reversed(word[-start:at].encode())] if self.byte_ids else [self.unknown_id]
            at = -start
        return out[::-1]


def walked(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """words (word, n) with ids and ok: whether the ids decode to the word."""
    shared = words.sparkSession.sparkContext.broadcast(vocabulary.walker())
    blank = BLANK

    @F.pandas_udf("ids array<int>, ok boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for x in batches:
            ids = [w.path(word) for word in x]
            yield pd.DataFrame({"ids": ids, "ok": [b"".join(w.data.get(i, b"") for i in own) == word.replace(blank, " ").encode() for own, word in zip(ids, x)]})

    return words.withColumn("path", of("word")).select("word", "n", "path.ids", "path.ok")


def word_table(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", relational: bool = False) -> DataFrame:
    """(word, n, ids, ok) of all distinct words: how often they occur, their ids, and whether these decode to the word."""
    words = docs.select(F.explode(words_of(text_or_empty(text), vocabulary)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    if not relational:
        return materialize(walked(words.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word"), vocabulary), "words")
    # Still dealt by KEY: decoding isn't shuffled either.
    flat = lattice(words, vocabulary).select(*KEY, F.posexplode("ids").alias("at", "id"), F.when(F.col("at") == 0, F.struct("word", "n", "ids")).alias("of")).join(F.broadcast(vocabulary.decoded(docs.sparkSession)), "id", "left")
    parts = F.array_sort(F.collect_list(F.struct("at", F.hex("data").alias("h"))))
    again = flat.groupBy(*KEY).agg(F.first("of", ignorenulls=True).alias("of"), parts.alias("parts")).select("of.*", F.unhex(F.array_join(F.col("parts.h"), "")).alias("said"))
    return materialize(again.select("word", "n", "ids", F.coalesce(F.col("said") == F.encode(F.replace("word", F.lit(BLANK), F.lit(" ")), "UTF-8"), F.lit(False)).alias("ok")), "words")


def frequent_from(words: DataFrame, most: int) -> int:
    """The least n of which at most `most` words are as frequent."""
    counts = words.groupBy("n").agg(F.count("*").alias("words")).where("n > 1").orderBy(F.desc("n")).select("n", "words")
    total, least = 0, 1 << 62
    for r in counts.collect():  # as many rows as there are different counts: under the square root of twice the words
        total += r["words"]
        if total > most:
            break
        least = r["n"]
    return least


def encoded_words(docs: DataFrame, vocabulary: Vocabulary, keys: list[str], text: str = "text", relational: bool = False) -> DataFrame:
    """(*keys, at, ids, ok): each word of each text with its place, and its ids."""
    rows = docs.select(*keys, F.posexplode(words_of(text_or_empty(text), vocabulary)).alias("at", "word"))
    words = word_table(docs, vocabulary, text, relational)
    short = F.length("word") <= SHORT
    often = short & (F.col("n") >= frequent_from(words.where(short), FREQUENT))
    known, seldom = words.where(often).drop("n"), words.where(~often).drop("n")
    return rows.join(F.broadcast(known), "word").unionByName(rows.join(F.broadcast(known.select("word")), "word", "left_anti").join(seldom, "word")).drop("word")


#: Rows of one id and one text are one key; a null id is a key as well.
ROW = ["row_id", "text_hash"]


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), key.alias("row_id"), F.xxhash64(text_or_empty(text)).alias("text_hash"))


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", merges: bool = True, relational: bool = False) -> DataFrame:
    """(doc_id, text, ids array<int>, decoded): one row for each distinct (id, text) of docs; decoded: the text that ids give."""
    vocabulary = Vocabulary(path, merges)
    rows = _rows(docs, text, doc_id).dropDuplicates(ROW)
    own = encoded_words(rows, vocabulary, ROW, relational=relational).groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("w")).select(*ROW, F.flatten(F.col("w.ids")).alias("ids"))
    own = materialize(own, "encoded")
    out = rows.join(own, ROW, "left").join(decode(own, ROW, "ids", vocabulary).withColumnRenamed("text", "decoded"), ROW, "left")
    return out.select("doc_id", "text", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"), F.coalesce("decoded", F.lit("")).alias("decoded"))


def summary(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", merges: bool = True, relational: bool = False) -> DataFrame:
    """(doc_id, n_words, n_pieces, ids_digest, round_trip) of each row of docs.

    ids_digest: two sums of 31 bits of xxhash64(place, ids) over a text's words: it depends on all ids and their order, and its
    parts are summed up before the shuffle. round_trip: whether the ids decode to the whole text: those of every word to the
    word (words are the whole text), and no character of it is U+2581.
    """
    vocabulary = Vocabulary(path, merges)
    rows = _rows(docs, text, doc_id)
    own = encoded_words(rows, vocabulary, ROW, relational=relational).withColumn("h", F.xxhash64("at", "ids"))
    low, high = (F.sum(F.shiftright("h", by).bitwiseAND(0x7FFFFFFF)) for by in (0, 31))
    # Rows that repeat id and text double all sums: they are divided by how many such rows there are.
    copies = F.count_if(F.col("at") == 0)
    sums = own.groupBy(*ROW).agg(copies.alias("copies"), F.count("*").alias("words"), F.sum(F.size("ids")).alias("n"), low.alias("low"), high.alias("high"), F.bool_and("ok").alias("ok"))
    sums = materialize(sums, "piece-sums")
    some = text_or_empty("text") != ""
    known = lookup_hot(rows.where(some).select("doc_id", *ROW, F.contains("text", F.lit(BLANK)).alias("odd")), sums, ROW, "copies")
    each = lambda c: F.expr(f"{c} div copies")
    digest = F.lower(F.concat(*(F.lpad(F.hex(each(c)), 16, "0") for c in ("high", "low"))))
    zero = F.lit(0).cast("bigint")
    none = rows.where(~some).select("doc_id", zero.alias("n_words"), zero.alias("n_pieces"), F.lit("0" * 32).alias("ids_digest"), F.lit(True).alias("round_trip"))
    return known.select("doc_id", each("words").alias("n_words"), each("n").alias("n_pieces"), digest.alias("ids_digest"), (F.col("ok") & ~F.col("odd")).alias("round_trip")).unionByName(none)
