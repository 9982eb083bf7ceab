"""Quality rules, hard negatives and spelling variants, each against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strideframe.llm import negatives, quality, spelling

# Quality rules


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def prose(rng, n):
    common = "the of and to in is that it was for on are as with".split()
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghilmnoprst") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def test_base_counts_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "a a a a a a", "x\nx\n \nx y\nx y", "$#@ <b> ☃ é \U0001f600", "\x00 a\x0bb\x0cc\rd"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(60)] + ["\n".join(prose(rng, 7) for _ in range(20)) + "\n" + prose(random.Random(5), 9) * 2]
    texts.append("long " * 200_000 + prose(rng, 3000))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.base_counts(df).collect()}
    assert got == {i: slow_counts(t) for i, t in enumerate(texts)}


def slow_distance(p, q):
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x > 0)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


def test_divergence_of_documents(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([80, 200, 800])) + "." for _ in range(60)]
    odd = {100: " ".join(w + "$$$" for w in prose(rng, 200).split()), 101: prose(rng, 200).upper(), 102: " | ".join("".join(rng.choice("abcdefghilmnoprst") for _ in range(7)) for _ in range(300)), 103: "7 " * 3 + "$ $ $"}
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(i, t, "en") for i, t in odd.items()] + [(200, odd[100], None), (201, odd[100], "xx"), (None, None, None), (0, texts[0], "en")]
    df = spark.createDataFrame([(*r, "k", True, 3.0, "l") for r in rows], "doc_id long, text string, lang string, word string, kept boolean, n_words double, _sf_lang string")
    out = quality.judge(df, n_common=13)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(out.columns) == {"doc_id", "text", "lang", "word", "kept", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance"}
    assert [got[i][0][4:] for i in range(60) if not got[i][0].kept] == []
    assert len(got[0]) == 2 and got[0][0] == got[0][1]
    assert not any(got[i][0].kept for i in odd) and got[103][0].base_failed and not got[100][0].base_failed
    assert got[200][0].kept and got[201][0].kept and got[200][0].char_distance is None  # no reference: base rules alone
    assert not got[None][0].kept and got[None][0].n_words == 0
    ref = {r.lang: r for r in quality.references(df, n_common=13).collect()}["en"]
    classes = lambda t: [sum(c in k for c in t) for k in ("abcdefghijklmnopqrstuvwxyz", " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?'\"()-")]
    for i in (3, 100, 102):
        t = texts[3] if i == 3 else odd[i]
        c = classes(t)
        p = [x / len(t) for x in [*c, len(t) - sum(c), 0]]
        assert abs(got[i][0].char_distance - slow_distance(p, ref.chars)) < 1e-4
        words = t.split(" ")
        a = [words.count(w) / len(words) for w in ref.common]
        assert abs(got[i][0].word_distance - slow_distance([*a, 1 - sum(a)], [*ref.shares, max(0, 1 - sum(ref.shares))])) < 1e-4
    assert quality.judge(df.limit(0)).count() == 0
    assert {"the", "of", "and"} <= set(ref.common)


def test_references_are_one_pass_without_a_join(spark):
    rng = random.Random(3)
    rows = [(prose(rng, 100), lang) for lang in ("en", "de") for _ in range(30)] + [("12345678 " * 60, "no") for _ in range(30)] + [(prose(rng, 100), "few")]
    refs = quality.references(spark.createDataFrame(rows, "text string, lang string"), n_common=5)
    plan = refs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("Generate explode") == 1
    got = {r.lang: r for r in refs.collect()}
    assert set(got) == {"en", "de"}  # "no" has no short words, "few" too few documents
    for lang, r in got.items():
        votes, classes = Counter(), [0] * 7
        for t in (t for t, k in rows if k == lang):
            words = t.split()
            votes.update({w: 10_000_000 // len(words) * n for w, n in Counter(w for w in words if len(w) <= 6).items()})
            for k, n in enumerate((len("".join(words)), t.count(" "))):
                classes[k] += math.floor(n * 10_000_000 / len(t))
        best = sorted(votes.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert r.common == [w for w, _ in best] and r.shares == [v / (1e7 * 30) for _, v in best] and r.chars == [c / sum(classes) for c in classes]


def test_windows_alike_in_three_places_alone_are_not_repeats(spark):
    texts = ["a b c d e x a y c z e", "a b c d e x a b c d e y a q c r e", "a b c d", "a b c d e"]
    out = quality.base_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r.text: r.n_repeat_words for r in out} == {t: slow_counts(t)[4] for t in texts}


def test_texts_without_words_in_a_language_with_references(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, 100), "en") for i in range(30)] + [(100, "", "en"), (101, None, "en"), (102, " \n\t ", "en")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == 33 and got[0].word_distance is not None
    assert all((r.n_words, r.base_failed, r.kept, r.char_distance, r.word_distance) == (0, True, False, None, None) for i, r in got.items() if i >= 100)


# Hard negatives


def slow_mine(rows):
    """Rows of (id, label, ints); ids differ."""
    out = []
    for i, label, q in rows:
        if i % 100:
            continue
        score = lambda r: int(np.dot(np.array(r[2], dtype=object), np.array(q, dtype=object)))
        order = sorted((r for r in rows if r[0] != i), key=lambda r: (-score(r), r[0]))
        for p in [r for r in order if r[1] == label][:5]:
            fit = [r for r in order if r[1] != label and 30 * score(p) <= 100 * score(r) <= 90 * score(p)][:10]
            out += [(i, p[0], k, r[0], score(p), score(r)) for k, r in enumerate(fit, 1)]
    return sorted(out)


def mined(df, **how):
    rows = negatives.integer_rows(df)
    return sorted(tuple(r)[:6] for r in negatives.mine(rows, F.col("vec_id") % 100 == 0, **how).collect())


SCHEMA = "vec_id long, embedding array<double>, label int, q string, block int"


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 7)) * 0.3
    x[100:260] = x[100]  # many equal vectors, labels alike or not
    x[300:320] = 0.0
    x[400] *= 30000
    x[401] *= -1
    labels = rng.integers(0, 4, 700)
    rows = [(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, labels))]
    bad = [(9000, None, 1), (9100, [1.0] * 6, 1), (9200, [float("nan")] * 7, 1), (9300, [None] * 7, 1), (9400, [float("inf")] + [0.0] * 6, 1), (9500, [0.1] * 7, None), (None, [0.1] * 7, 1)]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows + bad], SCHEMA)
    want = slow_mine([(i, k, [math.floor(256 * v) for v in e]) for i, e, k in rows])
    assert len(want) > 100
    assert mined(df) == want
    assert mined(df, block_rows=97, anchor_rows=2) == want  # many blocks and parts: the same rows
    assert mined(df.limit(0)) == []
    assert mined(df.where("vec_id = 100")) == []


def test_repeated_anchors_are_asked_once(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (100, [0.0, 1.0], 1), (1, [2.0, 1.0], 1), (2, [1.0, 0.4], 2), (2, [1.0, 0.4], 2)]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], SCHEMA)
    got = mined(df)
    assert got == [(100, 1, 1, 2, 256 * 256, 102 * 256), (100, 1, 1, 2, 512 * 256, 256 * 256), (100, 1, 2, 2, 256 * 256, 102 * 256), (100, 1, 2, 2, 512 * 256, 256 * 256)]


def test_bounds_hold_every_score():
    rng = np.random.default_rng(1)
    q = rng.integers(-(1 << 25), 1 << 25, (300, 9))
    books = negatives.fit_codebooks(q[:50])
    codes, residual = negatives.encode(q, books)
    import pandas as pd

    block = negatives.Block(pd.DataFrame({"vec_id": np.arange(300), "label": 0, "q": list(q), "codes": [c.tobytes() for c in codes], "residual": residual}), books)
    low, high = block.bounds(q[:40], np.arange(300))
    exact = (q[:40].astype(object) @ q.T.astype(object)).astype(float)
    assert (low <= exact).all() and (exact <= high).all()


# Spelling variants


def apart_by_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def slow_forms(n):
    near = {w: [v for v in n if apart_by_one(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def variants(words):
    order = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    return sorted((tuple(r) for r in spelling.variant_forms(words).collect()), key=order)


def test_variants_equal_brute_force(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcé") for _ in range(rng.choice([6, 7, 8, 11]))) for _ in range(60)]
    n = Counter()
    for w in base:
        n[w] += rng.choice([5, 30, 200, 4000])
        for _ in range(4):
            i, c = rng.randrange(len(w) + 1), rng.choice("abcéß")
            v = rng.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]])
            n[v] += rng.choice([5, 6, 25, 125])
    n = {w: k for w, k in n.items()}
    for k in range(1, 9):  # a chain of forms
        n["chainy" + "z" * k] = 5**k
    n["y" * 30_000], n["y" * 30_001] = 5, 25
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    order = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    assert variants(df) == sorted(slow_forms(n), key=order)
    assert variants(df.limit(0)) == []


def test_vocabulary_of_texts(spark):
    rows = [(1, "Straße straße, STRASSE'Garden garden2garden"), (2, None), (3, ""), (None, "GARDEN garden été×naïve"), (1, "garden")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, run string")
    words = {r.word: r.n for r in spelling.vocabulary(spelling.runs(df), "run", 3, 1).collect()}
    assert words == {"straße": 2, "strasse": 1, "garden": 6, "été×naïve": 1}
    cut = spark.createDataFrame([("garden", 0), ("garden", 5), ("é", 0), ("été", 1)], "w string, i int").select(spelling.without_letter("w", F.col("i")).alias("w"))
    assert [r.w for r in cut.collect()] == ["arden", "garde", "", "éé"]


def test_filter_lets_every_word_through():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(500)]
    sums = spelling._sums(spelling._codes(words), spelling._powers(9))[:, -1]
    table = np.zeros(1 << 10, np.uint64)
    for k in range(spelling.PROBES):
        at = spelling._probe(sums, k, len(table) * 64)
        np.bitwise_or.at(table, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    assert len(spelling.passes(sums, table)) == len(words)
    full = np.full(64, np.uint64(2**64 - 1), np.uint64)
    for w in ("abc", "aab"):
        made = {c for _, c in spelling.neighbours([w], "abc", full)}
        want = {w[:i] + w[i + 1 :] for i in range(3)} | {w[:i] + c + w[i + 1 :] for i in range(3) for c in "abc"} | {w[:i] + c + w[i:] for i in range(4) for c in "abc"}
        assert made == want - {w}


# Ogg streams of others


def test_times_of_foreign_streams():
    from strideframe.llm import ogg

    heads = {
        b"\x01vorbis" + (0).to_bytes(4, "little") + b"\x01" + (44_100).to_bytes(4, "little") + bytes(14): 44_100,
        b"OpusHead\x01\x02" + bytes(9): 48_000,
        b"\x7fFLAC\x01\x00\x00\x01fLaC" + bytes(4) + bytes(10) + (96_000 << 4).to_bytes(3, "big") + bytes(21): 96_000,
        b"Speex   " + bytes(28) + (16_000).to_bytes(4, "little") + bytes(40): 16_000,
        b"something else": 0,
        b"": 0,
        b"\x01vorbis": 0,
    }
    for head, rate in heads.items():
        s = ogg.Stream.__new__(ogg.Stream)
        s.packets, s.granules = [head, b"x"], [0, 44_100]
        assert ogg.granule_rate(s) == rate
        assert ogg.timestamps(s, ogg.granule_rate(s))[1] == (44_100 / rate if rate else None)
    own = ogg.packets_of(ogg.store_bytes(b"a" * 8000))
    assert max(p["seconds"] or 0 for p in own) > 0
