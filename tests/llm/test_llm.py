import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strideframe.llm import ann, langid, licenses, line_dedup, ogg, packing, pieces, pii, simhash, toxicity
from strideframe.llm.queries import tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long, n_docs int, label string, key string"
ODD = ["", None, " ", "\n\n", "a", "x " * 5000, " é☃ \U0001f600", "The same line here\nand another", "The same line here\nand another"]


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or ""), 1, "l", "k") for i, t in enumerate(texts)], DOC)


# Ogg


def slow_crc(data):
    r = 0
    for b in data:
        r ^= b << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
    return r


def test_ogg_crc_is_the_bitwise_one():
    for n in (0, 1, 5, 300):
        data = random.Random(n).randbytes(n)
        assert ogg.page_crc(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 64, 254, 255, 256, 1020, 1024, 1025, 5000, 40_000])
def test_ogg_round_trip(n):
    data = random.Random(n).randbytes(n)
    samples, streams, faults = ogg.restore_bytes(ogg.store_bytes(data))
    assert samples == data and faults == 0
    if n:
        assert max(t for s in streams for t in ogg.timestamps(s, 8000) if t is not None) * 8000 == max(sum(map(len, s.packets[1:])) for s in streams)


def test_ogg_faults_stay_in_their_packet():
    data = random.Random(1).randbytes(30_000)
    media = bytearray(ogg.store_bytes(data))
    pages, _ = ogg.read_pages(bytes(media))
    assert all(p.good for p in pages) and len(pages) > 6
    media[len(media) // 2] ^= 1
    samples, streams, faults = ogg.restore_bytes(b"junk" + bytes(media))
    whole = {data[i : i + 1024] for i in range(0, len(data), 1024)}
    kept = [p for s in streams for p in s.packets[1:]]
    assert faults > 4 and all(p in whole for p in kept) and len(whole) - 8 <= len(kept) < len(whole)
    assert ogg.read_pages(b"OggS") == ([], 4) and ogg.demultiplex([]) == []


def test_ogg_query_columns(spark):
    out = docs(spark, ODD).select("doc_id", "text", ogg.summary(ogg.store(F.coalesce("text", F.lit("")))).alias("s")).collect()
    for r in out:
        t = (r.text or "").encode()
        p = t + b"\0" * (-len(t) % 64) if t else b"\0" * 64
        assert (r.s.payload_bytes, r.s.payload_sha256, r.s.tail_crc32, r.s.faults) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), 0)
    assert sum(len(r.p) for r in docs(spark, ["x" * 3000]).select(ogg.packets(ogg.store("text")).alias("p")).collect()) == 3 + 2


def test_foreign_ogg_streams_do_not_stop_a_job():
    def stream(serial, ident):
        return ogg.write_page(ogg.FIRST, 0, serial, 0, ogg.lacing_of(len(ident)), ident) + ogg.write_page(ogg.LAST, 3, serial, 1, ogg.lacing_of(3), b"abc")

    same_place = ogg._IDENT.pack(ogg._MAGIC, 1, 0, 4, 0, 2)
    for media in (stream(1, same_place) + stream(2, same_place), stream(1, ogg._MAGIC), stream(1, b""), None, b""):
        assert ogg.summary_of(media) and ogg.packets_of(media) is not None
    assert ogg.restore_bytes(stream(2, same_place) + stream(1, same_place))[0] == b"abcabc"


# Line de-duplication


def test_lines_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["  Common LINE ", "common line", "rare %d" % rng.randrange(400), "", "\t", "É"]) for _ in range(rng.randrange(8))) for _ in range(60)] + ODD
    got = {r.doc_id: r for r in line_dedup.drop_frequent_lines(docs(spark, texts), min_docs=10).collect()}
    low = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    n = Counter(k for t in texts for k in {low(x) for x in (t or "").split("\n")})
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (low(x) and n[low(x)] >= 10)]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text, got[i].label) == (len(lines), len(lines) - len(kept), "\n".join(kept), "l")


def test_lines_of_no_documents_and_of_repeated_ids(spark):
    assert line_dedup.drop_frequent_lines(docs(spark, [])).count() == 0
    same = docs(spark, ["a\nb"]).unionAll(docs(spark, ["a\nb"])).unionAll(docs(spark, ["a\nc"]))
    assert sorted(r.text for r in line_dedup.drop_frequent_lines(same, min_docs=3).collect()) == ["b", "b", "c"]


# Licenses


def test_license_scan(spark):
    mit = licenses.TEMPLATES["mit-text"]
    edited = mit.replace("free of charge,", "free of any charge at all,").replace("sublicense, ", "")
    texts = ["x y " + mit + " z", "w " * 300 + edited, "Released under the MIT License.", "GENERAL public-License", "no words of that", *ODD]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert got[0].labels == "mit-text" and got[0].score == 1.0 and got[1].labels == "mit-text" and got[1].score < 1
    assert (got[2].base_labels, got[2].labels, got[2].first_word, got[2].last_word, got[2].n_base) == ("mit", "mit,mit-notice", 3, 3, 1)
    assert (got[3].base_labels, got[3].n_words, got[4].labels, got[4].first_word, got[4].score) == ("gpl", 3, "", None, 0.0)
    assert got[5].n_words == 0 and licenses.scan(docs(spark, [])).count() == 0


def test_one_inserted_word_breaks_no_license(spark):
    texts, want = [], []
    for label, text in licenses.TEMPLATES.items():
        words = re.findall(r"[A-Za-z0-9]+", text)
        for p in range(len(words) + 1):
            matched = sum(n for n in (p, len(words) - p) if n >= 4)
            texts.append(" ".join(["foo bar", *words[:p], "inserted", *words[p:], "baz"]))
            want.append((label, matched / len(words)))
    for r in licenses.scan(docs(spark, texts)).collect():
        label, share = want[r.doc_id]
        assert (label in r.labels.split(",")) == (share >= 0.6), (label, share, texts[r.doc_id])
        assert share < 0.6 or r.score >= share


# Packing


def brute_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [min(100, 1 + int(rng.expovariate(1 / 25))) for _ in range(400)]
    flows = packing.plan(dict(Counter(lengths)), 100)
    where = {}
    for n, lo, hi, first, each, base in flows:
        for r in range(lo, hi):
            where.setdefault(first + (r - lo) // each, []).append((base + (r - lo) % each * n, n))
    assert len(where) == brute_best_fit(lengths, 100)
    for rows in where.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= 100


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["the", "Of", "a\nb", "x  y", "don't", "été", "<|endoftext|>"]) for _ in range(rng.randrange(300))) for _ in range(60)] + ODD
    t = Tokenizer.from_file(path)
    want = {}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        for k, (at, n) in enumerate(packing.cut(len(ids), 128)):
            want[(i, k)] = (at, n, zlib.crc32(array("I", ids[at : at + n]).tobytes()))
    packed = packing.pack(docs(spark, texts), path, capacity=128, keep_ids=True).cache()
    rows = packed.collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 128 and [o for o, _ in sorted(v)] == list(np.cumsum([0] + [n for _, n in sorted(v)])[:-1]) for v in by.values())
    assert sum(len(r.ids) for r in packing.sequences(packed).collect()) == 4 * sum(n for _, n, _ in want.values())
    assert packing.pack(docs(spark, []), path).count() == 0


# Personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    def luhn(s):
        d = [int(c) for c in s if c.isdigit()][::-1]
        return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0

    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, text):
            s, n = m.group(), sum(c.isdigit() for c in m.group())
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 16 <= n <= 19 and luhn(s), "phone": 8 <= n <= 15}[k]:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    bits = ["a@b.c", "a@b.c_d@e.f", "x@@y.z", "1.2.3.4", "1.2.3.4.5", "999.1.1.1", "1..2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (956) 555-0122", "+1 2", "é\U0001f600", " ", "12", "@", ".", "+", "-", "\n", "password=e3b3ed3cc8548923d6"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(150)] + ["1" * 30_000, "a" * 30_000, "4 " * 20_000] + ODD
    for r in pii.find(docs(spark, texts)).collect():
        got = [(s.kind, s.start, s.end) for s in r.spans if s.base]
        assert got == brute_pii(texts[r.doc_id] or ""), texts[r.doc_id]


def test_added_spans_and_redaction(spark):
    texts = ["mail bob@mail.example.com now", 'token = "64be24439e3e49cf46b2d7c90f3602a3d0b907ff"', "call 425 555-0735 today", "plain text", None, "4465758382889437 4465758382889437"] * 5
    out = {r.doc_id: r.text for r in pii.redact(docs(spark, texts)).collect()}
    assert out[0] == "mail <EMAIL> now" and out[1] == 'token = "<SECRET>"' and out[3] == "plain text" and out[4] == "" and out[5] == "<CARD> <CARD>"
    assert pii.redact(docs(spark, [])).count() == 0


def test_em_finds_the_better_labeler():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.5
    votes = np.stack([np.where(rng.random(4000) < a, 2 * y - 1, 1 - 2 * y) for a in (0.95, 0.9, 0.6)], 1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    _, right = pii.estimate(patterns, n.astype(float))
    assert right[0] > 0.85 and right[0] > right[2] and abs(right[2] - 0.6) < 0.1


# Toxicity


def test_toxicity_learns_from_labels(spark):
    rng = random.Random(5)
    clean, bad = [f"word{i}" for i in range(50)], ["grobe", "grobian", "schlimm"]
    texts, y = [], []
    for i in range(300):
        y.append(int(i % 4 == 0))
        texts.append(" ".join([rng.choice(clean) for _ in range(30)] + ([rng.choice(bad) for _ in range(3)] if y[-1] else [])))
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y[:200])], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs(spark, texts + ODD), labels).collect()}
    assert sum(got[i].predicted == y[i] for i in range(200, 300)) >= 97 and all(0 <= r.score <= 1 for r in got.values()) and len(got) == 300 + len(ODD)
    assert {r.score for r in toxicity.score_documents(docs(spark, ODD), labels.limit(0)).collect()} == {0.0}
    clashing = docs(spark, texts).withColumns({c: F.lit(7) for c in ("_sf_id", "_sf_th", "Rejected_ID", "rejected_hash", "text_hash", "score")})
    kept = toxicity.reject_toxic(clashing, labels)
    assert kept.columns == clashing.columns and kept.count() >= 220


def test_rare_toxic_words_count_and_copies_do_not(spark):
    rng = random.Random(11)
    plain = [" ".join(rng.choice([f"w{chr(97 + i)}" for i in range(26)]) for _ in range(12)) for _ in range(2400)]
    rows = [(f"{t} grob{chr(97 + i % 50 // 25)}{chr(97 + i % 25)}", 1) for i, t in enumerate(plain[:400])] + [(t, 0) for t in plain[400:]] + [("copied text of onceonly words", 1)] * 50
    found = toxicity.mine(spark.createDataFrame(rows, "text string, y int"))
    assert {f"grob{a}{chr(97 + i)}" for a in "ab" for i in range(25)} <= set(found) and "onceonly" not in found


def test_a_labelled_id_on_most_rows_leaves_both_classes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 5)
    texts = [f"plain text {i % 7} of words " + ("grobian schlimm" if i % 3 == 0 else "calm") + f" x{chr(97 + i % 26)}" for i in range(60)]
    copies = docs(spark, [f"plain text of words calm {i}" for i in range(3000)]).withColumn("doc_id", F.lit(1).cast("long")).coalesce(1)
    every = copies.unionByName(docs(spark, texts).coalesce(1))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(every, labels).where("doc_id <> 1").collect()}
    assert all(p == int(i % 3 == 0) for i, p in got.items())


def test_repeated_voters_count_for_less():
    rng = np.random.default_rng(2)
    y = rng.random(5000) < 0.5
    a = np.where(rng.random(5000) < 0.8, y, ~y)
    b = np.where(rng.random(5000) < 0.8, y, ~y)
    v = np.stack([a, a, a, b], 1).astype(float)
    w = toxicity.fit_label_model(v, np.ones(5000), np.where(np.arange(5000) < 500, y, np.nan)).weights
    assert w[3] > 2 * w[0]


# SentencePiece


def test_pieces_equal_the_library(spark, tmp_path):
    import sentencepiece

    from strideframe.llm.queries import op7_sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "retitioning", "  Öschen", "été,", "x\ny", "日本語", "\U0001f600", "aaaaaaa", "don't", "a1--b"]) for _ in range(rng.randrange(1, 30))) for _ in range(25)] + ODD + ["the" * 7000, "a" * 20_000, "日" * 3000 + "\U0001f600" * 400]
    got = {(r.doc_id, r.text): r for r in pieces.encode(docs(spark, texts), path).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert list(got[i, t].ids) == m.encode(t or "") and got[i, t].decoded == (t or ""), t
    # Repeated rows, one id on several texts, null ids and texts with the blank's own sign.
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (3, "another text"), (None, "no id"), (None, texts[3]), (7, "a \u2581 b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = op7_sentencepiece(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_pieces) for r in out) == Counter((i, len(m.encode(t or ""))) for i, t in rows)
    assert [r.round_trip for r in out].count(False) == 1
    same = {(r.n_pieces, r.ids_digest) for r in out if r.doc_id in (3, None)}
    assert len(same) == 3 and pieces.summary(docs(spark, []), path).count() == 0


def test_both_forms_of_the_lattice_agree(spark):
    v = pieces.Vocabulary(tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(9)
    words = {"▁" * rng.randrange(2) + "".join(rng.choice("abcdeinorst日") for _ in range(rng.randrange(1, 30))) for _ in range(200)} | {"a" * 150, "▁" * 20}
    rows = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n long")
    one, other = ({r.word: list(r.ids) for r in df.collect()} for df in (pieces.walked(rows, v), pieces.lattice(rows, v)))
    assert one == other and set(one) == words


class Tiny(pieces.Vocabulary):
    scores = {"▁": -2.0, "a": -1.0, "b": -1.5, "ab": -1.8, "▁a": -2.2, "ba": -0.9, "bab": -3.0}

    def __init__(self):
        self.bytes = {}
        self.setup([(p, i + 1, s) for i, (p, s) in enumerate(self.scores.items())], 0, False)
        self.unknown_score = -20.0


def test_viterbi_is_the_best_path(spark):
    words = ["▁" + "".join(random.Random(i).choice("abc") for _ in range(1 + i % 6)) for i in range(40)]
    ids = {p: i + 1 for i, p in enumerate(Tiny.scores)}

    def paths(w):
        if not w:
            yield 0.0, []
        for n in range(1, min(3, len(w)) + 1):
            if w[:n] in ids or n == 1:
                for s, rest in paths(w[n:]):
                    yield Tiny.scores.get(w[:n], -20.0) + s, [ids.get(w[:n], 0)] + rest

    rows = spark.createDataFrame([(w, 1) for w in sorted(set(words))], "word string, n long")
    for r in pieces.lattice(rows, Tiny()).collect() + pieces.walked(rows, Tiny()).collect():
        best = max(s for s, _ in paths(r.word))
        assert list(r.ids) in [p for s, p in paths(r.word) if math.isclose(s, best)]


# Nearest neighbours


def test_search_equals_brute_force_mostly(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 16)) * rng.uniform(0.5, 2, (900, 1))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0]), (2020, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit(1)).withColumn("part", F.lit("x"))
    got = {}
    for r in ann.search(df, k=10, block_rows=300, query_rows=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, x = np.append(np.arange(900), 2020), np.vstack([x, x[:1]])
    assert set(got) == {i for i in ids if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        s = x @ x[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:10]
        hits += len({ids[i] for i in order} & {v for _, v, _ in found})
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11)) and all(math.isclose(sc, s[np.flatnonzero(ids == v)[0]], rel_tol=1e-12) for _, v, sc in found)
    assert hits >= 0.9 * 10 * len(got)
    assert ann.search(df.limit(0)).count() == 0


# SimHash


def brute_simhash(text):
    w = (text or "").encode().lower().split() if (text or "").isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    n = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * n[b] > len(s))


def roots(values, ids):
    at = dict(enumerate(range(len(values))))
    find = lambda i: i if at[i] == i else find(at[i])
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                at[find(i)] = find(j)
    least = {}
    for i in range(len(values)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(values))]


def test_groups_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("Ab cd EF gh ij kl".split()) for _ in range(rng.randrange(6))) for _ in range(80)] + ODD
    rows = simhash.near_duplicate_groups(docs(spark, texts)).orderBy("doc_id").collect()
    prints = [r.fp & (1 << 64) - 1 for r in rows]
    assert prints == [brute_simhash(t) for t in texts]
    assert [r.component_id for r in rows] == roots(prints, range(len(texts)))
    kept = {r.doc_id for r in simhash.keep_one_of_each_group(docs(spark, texts)).collect()}
    assert kept == set(roots(prints, range(len(texts))))


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = ("one two three four five six", "another text of some words here", "and a third one that is unlike", "the last text is about rivers")
    rows = [(3, a, "x"), (3, a, "x"), (None, a, "n"), (None, b, "n"), (None, b, "m"), (1, b.upper(), "u"), (1, b, "v"), (None, c, "p"), (None, c, "p"), (3, d, "q"), (3, d, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted((r.text.lower(), r.doc_id or 0) for r in simhash.keep_one_of_each_group(df).collect())
    assert kept == sorted([(a, 3), (b, 1), (c, 0), (d, 3)])
    assert simhash.keep_one_of_each_group(df).columns == df.columns
    clashing = df.withColumns({c: F.lit(7) for c in ("_sf_row", "ROW_KEY", "row", "fp", "root")})
    kept = simhash.keep_one_of_each_group(clashing)
    assert kept.columns == clashing.columns and {(r._sf_row, r.ROW_KEY) for r in kept.collect()} == {(7, 7)}


@pytest.mark.parametrize("crowd", [2, 64])
def test_links_of_crowds(spark, crowd):
    rng = random.Random(9)
    values = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        values |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(25)}
    values = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    edges = [((a.a & (1 << 64) - 1), (a.b & (1 << 64) - 1)) for a in simhash.links(df, crowd=crowd).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    at = {v: v for v in values}
    find = lambda v: v if at[v] == v else find(at[v])
    for a, b in edges:
        at[find(a)] = find(b)
    group = {}
    for v, r in zip(values, roots(values, values)):
        assert group.setdefault(r, find(v)) == find(v)
    assert len(set(group.values())) == len(group)


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {(r.root) for r in simhash.components(edges).collect()} == {0}


# Languages


def test_languages(spark):
    en, de = "the house of the rising sun and that is what there was with them ", "das haus der aufgehenden sonne und was dort gewesen ist mit ihnen "
    texts = [en * 3, de * 3] * 20
    train = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    model = langid.train(train)
    assert model.predict(en)[0] == "en" and model.predict(de)[0] == "de"
    pred, score, both = model.predict(en * 6 + de * 2)
    assert pred == "en" and set(both) == {"en", "de"} and 0.6 < score < 0.9
    out = {r.text: r.s for r in docs(spark, ["123 !", None, "", en]).select("text", langid.predicted(model, spark, F.col("text")).alias("s")).collect()}
    assert out["123 !"].lang_pred == out[None].lang_pred == out[""].lang_pred == "und" and out[en].lang_pred == "en"
    assert langid.train(train.limit(0)).predict(en) == ("und", 0.0, [])


def test_search_of_extreme_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 8))
    x[7] *= 1e200
    x[11] *= 1e6
    x[13] *= 1e-200
    x[20:60] = 1.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, k=5, block_rows=200).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for q, found in got.items():
        order = [i for i in np.lexsort((np.arange(400), -(x @ x[q]))) if i != q][:5]
        hits += len(set(order) & set(found))
    assert len(got) == 20 and all(len(f) == 5 for f in got.values()) and hits >= 90
    same = spark.createDataFrame([(20, [1.0, float(i % 7 + 1)]) for i in range(300)] + [(21, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in ann.search(same, k=3, block_rows=50).collect()} == {21}


# SimHash near-duplicates of five words


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_similar_rows_equal_brute_force(spark):
    rng = random.Random(12)
    base = [[f"w{rng.randrange(900)}" for _ in range(rng.choice([3, 12, 60, 200, 700]))] for _ in range(40)]
    texts = [" ".join(b) for b in base] + [edited(rng, base[i % 40], 1 + i % 9) for i in range(80)] + [" ".join(base[0])] * 3 + ODD
    rows = [(i % 150, t) for i, t in enumerate(texts)] + [(None, texts[5]), (None, edited(rng, base[5], 1)), (0, texts[0])]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    prints = [simhash.simhash(t, 5) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if bin((prints[i] ^ prints[j]) & (2**64 - 1)).count("1") <= 2 or simhash.similarity_of(rows[i][1], rows[j][1]) >= 0.8:
                root[find(i)] = find(j)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in simhash.keep_one_of_similar(df).collect()]
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    assert len(kept) == len(groups)
    for own in groups.values():
        first = min((d is None, d or 0) for d, _ in own)
        assert any(((d is None, d or 0) == first) and (d, t) in own for d, t in kept)
    assert simhash.keep_one_of_similar(df.limit(0)).count() == 0


def test_pipeline_stages_in_turn(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    clean = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]
    rows = []
    for i in range(240):
        words = [rng.choice(clean) for _ in range(60)]
        if i % 6 == 0:
            words[5::12] = [rng.choice(["grobian", "schlimmer", "grobheit"]) for _ in words[5::12]]
        rows.append((i, " ".join(words) + f"\nShared line of all\nmail a{i}@example.com now"))
    rows += [(1000 + i, rows[i][1].replace("word", "Word", 1)) for i in range(1, 20, 6)] + [(None, None), (2000, ""), (2000, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs_, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs_ = stage(spark, docs_, str(tmp_path)).cache()
        kept.append(docs_.collect())
    toxic, lines, near, private, packed = kept
    assert {r.doc_id for r in toxic} == {i for i, _ in rows if i is None or i >= 1000 or i % 6}
    assert len(lines) == len(toxic) and not any("Shared line" in r.text for r in lines)
    assert {r.doc_id for r in near} == {r.doc_id for r in toxic if r.doc_id is not None and r.doc_id < 1000} | {2000} and len(near) == 201
    assert all("@example" not in r.text and r.n_chars == len(r.text) for r in private) and len(private) == len(near)
    assert {r.doc_id for r in packed} == {r.doc_id for r in near} and sum(r.piece == 0 for r in packed) == len(near)
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_search_of_repeated_query_ids(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0]), (20, [2.0, 1.0]), (20, [1.0, 2.0]), (21, [1.0, 1.0]), (22, [3.0, 1.0])], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, k=2).collect():
        got.setdefault(r.query_hash, []).append((r.rank, r.query_id, r.vec_id, r.score))
    assert sorted(sorted(x) for x in got.values()) == [[(1, 20, 22, 5.0), (2, 20, 21, 3.0)], [(1, 20, 22, 7.0), (2, 20, 21, 3.0)]]


def test_op8_recall(spark):
    from strideframe.llm.queries import op8_collision_search

    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in op8_collision_search(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked, hits = [i for i in range(len(ids)) if ids[i] % 20 == 0], 0
    assert set(got) == {int(ids[i]) for i in asked}
    for i in asked:
        scores = x @ x[i]
        best = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:20]
        own = sorted(got[int(ids[i])])
        assert [r for r, _, _ in own] == list(range(1, 21)) and all(a[2] >= b[2] for a, b in zip(own, own[1:]))
        hits += len({int(ids[j]) for j in best} & {v for _, v, _ in own})
    assert hits >= 0.9 * 20 * len(asked)
