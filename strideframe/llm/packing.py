"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Documents become ids and are cut into pieces of at most `capacity` ids. Pieces are ordered by length and ranked within their
length by Spark (in salted buckets, so that a length that a third of all pieces share is ranked by many tasks). Bulk-synchronous
steps then go through the lengths from the longest: all pieces of one length are matched at once to the successor, the smallest
gap that holds them, and on to the next larger gap when that class of gaps is used up; conflicts over a gap are settled by rank;
gaps are updated before the next step; where no gap is left, sequences are opened. The sweep works on classes (at most
`capacity` lengths and gaps, with how many there are of each, whatever the corpus), and pieces then find their sequence
by a join on length and rank. No piece passes through the driver.

Defined results: null and empty texts are one id, the end mark; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strideframe.llm.common import materialize, text_or_empty

#: Texts of about so many characters are encoded at a time; a worker keeps the ids of so many words of so many characters at most.
_CHARS, _KEPT, _SHORT = 1 << 20, 900_000, 13
#: Ranks within a length are dealt to so many buckets.
_BUCKETS = 16
_ODD = re.compile(r" (?:\s|\Z)")
_BEFORE = re.compile(r"(?= \S)")


class Encoder:
    """Encodes texts word by word, once for each word known: a byte-level tokenizer never joins across a space before a word."""

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that hold one of these are encoded whole: they are one id each, whatever stands beside them.
        self.added = re.compile("|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.tokenizer.post_processor = None  # it would add no ids, and only trim offsets
        self.known: dict[str | tuple[str], bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker and path."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit numbers in the machine's order of bytes (little-endian wherever Spark runs)."""
        # Every part but the first stands for itself with a blank before it; the first goes by a key of another type.
        parts = []
        for t in texts:
            if self.added.search(t):
                parts.append([(t,)])
            elif _ODD.search(t):
                first, *rest = _BEFORE.split(t)
                parts.append([(first,), *(x[1:] for x in rest)])
            else:
                words = t.split(" ")
                words[0] = (words[0],)
                parts.append(words)
        new = list(set().union(*parts).difference(self.known))
        for word, x in zip(new, self.tokenizer.encode_batch_fast([w[0] if type(w) is tuple else " " + w for w in new], add_special_tokens=False)):
            self.known[word] = array("I", x.ids).tobytes()
        found = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        for word in new:  # long words hardly ever come again
            if type(word) is tuple or len(word) > _SHORT:
                del self.known[word]
        if len(self.known) > _KEPT:
            self.known = {w: x for w, x in self.known.items() if len(w) <= _SHORT // 2}
        return found


def encode_all(texts: Iterable[str | None], path: str) -> Iterator[bytes]:
    encoder, held, chars = Encoder.of(path), [], 0
    for t in texts:
        held.append(t or "")
        chars += len(held[-1])
        if chars >= _CHARS:
            yield from encoder.encode(held)
            held, chars = [], 0
    yield from encoder.encode(held)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((i, capacity) for i in range(first, n, capacity))]


def pieces_of(text: str | Column, path: str, capacity: int = 2048, end: int = 0, keep_ids: bool = False) -> Column:
    """array<struct<piece, start, length, ids_crc32[, ids]>>; ids: the piece's as little-endian unsigned 32-bit numbers."""
    kind = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint" + ",ids:binary" * keep_ids + ">>"
    mark = np.array([end], "<u4").tobytes()

    @F.pandas_udf(kind)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            out = []
            for ids in encode_all(x, path):
                ids += mark
                rows = []
                for k, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * at : 4 * (at + n)]
                    rows.append({"piece": k, "start": at, "length": n, "ids_crc32": zlib.crc32(own)} | ({"ids": own} if keep_ids else {}))
                out.append(rows)
            yield pd.Series(out)

    return of(text)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over classes: (length, rank from, rank to, first sequence, pieces in each, offset).

    Gaps are kept as runs of consecutive sequences with the same gap.
    """
    out, sizes, runs, opened = [], [], {}, 0  # sizes: gaps there are, sorted; runs: gap -> [(first sequence, how many)]

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                bisect.insort(sizes, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        at, last = 0, counts[length]
        while at < last:
            k = bisect.bisect_left(sizes, length)
            if k == len(sizes):
                gap, first = capacity, opened
                n = -(-(last - at) // (capacity // length))
                opened += n
            else:
                gap = sizes[k]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], sizes[k]
            each = gap // length
            used = min(n, -(-(last - at) // each))
            upto = min(last, at + used * each)
            out.append((length, at, upto, first, each, capacity - gap))
            full = (upto - at) // each
            put(gap, first + used, n - used)
            put(gap - each * length, first, full)
            put(gap - (upto - at - full * each) * length, first + full, used - full)
            at = upto
    return out


def ranked(items: DataFrame, key: list[str]) -> DataFrame:
    """items with their rank (from 0) among those of the same length."""
    items = items.withColumn("_sf_b", F.pmod(F.xxhash64(*key), F.lit(_BUCKETS)))
    cell = items.groupBy("length", "_sf_b").agg(F.count("*").alias("_sf_n"))
    before = cell.select("length", "_sf_b", (F.sum("_sf_n").over(Window.partitionBy("length").orderBy("_sf_b")) - F.col("_sf_n")).alias("_sf_before"))
    place = F.row_number().over(Window.partitionBy("length", "_sf_b").orderBy(*key)) - 1
    return items.withColumn("_sf_r", place).join(F.broadcast(before), ["length", "_sf_b"]).withColumn("rank", F.col("_sf_before") + F.col("_sf_r")).drop("_sf_b", "_sf_before", "_sf_r")


def place(items: DataFrame, key: list[str], capacity: int = 2048) -> DataFrame:
    """items (with `length` from 1 to capacity) with sequence_id and offset. items is read three times: pass a written table."""
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}  # at most `capacity` rows
    flows = items.sparkSession.createDataFrame(plan(counts, capacity), T.StructType([T.StructField(x, T.LongType()) for x in ("length", "lo", "hi", "first", "each", "base")]))
    return (
        ranked(items, key)
        .join(F.broadcast(flows), "length")
        .where("rank >= lo and rank < hi")
        .withColumn("sequence_id", F.expr("first + (rank - lo) div each"))
        .withColumn("offset", F.expr("base + (rank - lo) % each * length"))
        .drop("lo", "hi", "first", "each", "base", "rank")
    )


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, text: str = "text", doc_id: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(pieces_of(text_or_empty(text), path, capacity, end, keep_ids)).alias("_sf_p")).select("doc_id", "_sf_p.*")
    return place(materialize(rows, "pieces"), ["doc_id", "piece", "start", "ids_crc32"], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the whole sequences, from pack(keep_ids=True); each has `capacity` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
