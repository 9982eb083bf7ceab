"""Personal data by weak supervision. DataFrame operations only.

Patterns propose candidate spans; labelers (pattern, checksum, gazetteer, context, shape, counter-evidence) vote on each: 1, -1
or 0. Expectation-maximisation over the counts of vote patterns of the whole corpus (kinds x 3 ** labelers at most, whatever its
size) estimates how reliable each labeler is for each kind, and a linear span classifier is trained on the posterior labels; it
is one expression that Spark applies to every span. Spans that the base rules accept always stay.

Positions are in code points, ends exclusive. Patterns don't back up over what they have read, so that long runs of one class
of characters cost no more than other text.

Defined results: null and empty texts have no spans; repeated rows get equal spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import materialize, text_or_empty
from strideframe.llm.linear import fit_linear

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "name", "secret")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "shape", "counter")

#: Each base pattern, written so that a match starts at the first character of its run or right after the match before.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates beyond the base patterns.
_LOOSE_PHONE = r"(?<![0-9+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
_LOOSE_CARD = r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])"
_SECRET = r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|(?=[0-9a-f]*[a-f])[0-9a-f]{16,64})(?![A-Za-z0-9])"
#: Frequent given names of the languages at hand.
GIVEN_NAMES = "Ana Anna Antonio Carlos Claire Claudia David Elena Emily Emma Hans Heinrich Isabel James Jean Jennifer John Jose Juan Julia Karl Laura Linda Lucas Luis Maria Marie Martin Mary Michael Michel Miguel Monika Olivia Paul Peter Pierre Robert Sarah Sophie Stefan Thomas Ursula William".split()
_NAME = rf"(?<![A-Za-z])(?:{'|'.join(GIVEN_NAMES)}) [A-Z][a-z]{{2,20}}(?![A-Za-z])"

#: Endings of mail domains, prefixes of keys, words before personal data, and words that speak against it.
_DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|info|eu)$"
_KEY_PREFIX = r"^(?:AKIA|gh[pousr]_|sk-)"
_CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|schreib|courriel|correo)\W*$",
    "ip": r"(?i)(?:ip|host|server|address|client|from)\W*$",
    "card": r"(?i)(?:card|visa|mastercard|credit|karte|carte|tarjeta)\W*$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|whatsapp|telefon)\W*$",
    "name": r"(?i)(?:mr|mrs|ms|dr|herr|frau|name|author|by|von|par|por)\W*$",
    "secret": r"(?i)(?:password|passwd|pwd|token|secret|key|bearer)\W*$",
}
_AGAINST = r"(?i)(?:version|ver|v|section|chapter|isbn|issn|doi|commit|sha|md5|page)\W*$"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, value>>: leftmost matches that don't overlap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,value:string>>")

    def placed(of: Column) -> Column:
        lengths = F.zip_with(F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(of)), F.length), of, lambda a, b: F.struct(a.alias("gap"), b.alias("value")))
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(
            lengths,
            start,
            lambda s, x: F.struct((s["at"] + x["gap"] + F.length(x["value"])).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), x["value"].alias("value")))).alias("out")),
            lambda s: s["out"],
        )

    return F.when(F.size(found) > 0, placed(found)).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = F.reverse(_digits(value))
    # Doubled digits over 9 lose 9; the sum of all is a multiple of 10.
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.substring(d, i, F.lit(1)).cast("int") * (2 - i % 2) - F.when((i % 2 == 0) & (F.substring(d, i, F.lit(1)) >= "5"), 9).otherwise(0)) % 10 == 0


def base_rule(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
        "card": n.between(16, 19) & F.when(n.between(16, 19), luhn(value)).otherwise(False),
        "phone": n.between(8, 15),
    }.get(kind, F.lit(False))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, value: Column, ok: Column, before: Column) -> Column:
    """array<int> in the order of LABELERS."""
    n, never = F.length(value), F.lit(False)
    checksum = {"card": _vote(F.length(_digits(value)).between(13, 19) & luhn(value), F.lit(True)), "ip": _vote(ok, F.lit(True))}.get(kind, F.lit(0))
    gazetteer = {"email": _vote(value.rlike(_DOMAINS), F.lit(True)), "secret": _vote(value.rlike(_KEY_PREFIX), never), "name": F.lit(1), "phone": _vote(value.rlike(r"^\+(?:1|33|34|44|49)\b"), never), "card": _vote(_digits(value).rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"), F.lit(True))}.get(kind, F.lit(0))
    distinct = F.size(F.array_distinct(F.split(value, "")))
    shape = {"secret": _vote(distinct >= 8, distinct <= 4), "email": _vote(n <= 64, n > 254), "card": _vote(n.between(16, 23), n > 30), "phone": _vote(n.between(9, 20), n > 24), "ip": _vote(n.between(7, 15), n > 19), "name": _vote(n <= 32, never)}[kind]
    pattern = _vote(ok, never) if kind in BASE else F.lit(1)
    return F.array(pattern, checksum, gazetteer, _vote(before.rlike(_CONTEXT[kind]), never), shape, _vote(never, before.rlike(_AGAINST)))


def candidates(text: Column) -> Column:
    """array<struct<kind, start, end, base, votes>>, by kind as in KINDS, then start."""

    def of(kind: str, pattern: str, gate: Column | None = None, loose: bool = False) -> Column:
        found = matches(text, pattern)

        def span(m: Column) -> Column:
            value, start = m["value"], m["start"]
            ok = F.lit(False) if loose else base_rule(kind, value)
            before = F.substring(text, F.greatest(start - 23, F.lit(1)), F.least(start, F.lit(24)))
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), ok.alias("base"), votes(kind, value, ok, before).alias("votes"))

        spans = F.transform(found, span)
        return spans if gate is None else F.when(gate, spans).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean,votes:array<int>>>"))

    return F.concat(
        of("email", _EMAIL, F.contains(text, F.lit("@"))),
        of("ip", _IP, text.rlike(r"[0-9]\.[0-9]")),
        of("card", _CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")),
        of("card", _LOOSE_CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), loose=True),
        of("phone", _PHONE, F.contains(text, F.lit("+"))),
        of("phone", _LOOSE_PHONE, text.rlike(r"[0-9]{3}[ .-][0-9]{4}"), loose=True),
        of("name", _NAME, loose=True),
        of("secret", _SECRET, text.rlike(r"[0-9A-Za-z]{16}"), loose=True),
    )


@dataclass
class SpanModel:
    """Coefficients per kind and per vote; `reliability` is what expectation-maximisation found, for reading."""

    kinds: dict[str, float]
    yes: list[float]
    no: list[float]
    reliability: dict[str, list[float]]

    def score(self, kind: Column, votes: Column) -> Column:
        z = F.lit(0.0)
        for k, w in self.kinds.items():
            z = z + F.when(kind == k, w).otherwise(0.0)
        for j, (a, b) in enumerate(zip(self.yes, self.no)):
            v = F.get(votes, F.lit(j))
            z = z + F.when(v == 1, a).when(v == -1, b).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def estimate(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern of votes (-1, 0, 1) and P(right | the labeler votes), of one kind."""
    said = np.stack([votes == 1, votes == -1, votes == 0]).astype(float)  # 3 x patterns x labelers
    p = np.clip(0.5 + 0.15 * votes.sum(1), 0.05, 0.95)
    for _ in range(rounds):
        w = np.stack([n * (1 - p), n * p])  # label x patterns
        rate = np.einsum("yp,apl->yal", w, said) + np.array([[0.5, 1.5, 1], [1.5, 0.5, 1]])[:, :, None]
        rate /= rate.sum(1, keepdims=True)
        z = np.einsum("apl,yal->yp", said, np.log(rate)) + np.log((w.sum(1) + 1) / (w.sum() + 2))[:, None]
        p = 1 / (1 + np.exp(np.clip(z[0] - z[1], -40, 40)))
    prior = (n @ p + 1) / (n.sum() + 2)
    right = prior * rate[1, 0] / (prior * rate[1, 0] + (1 - prior) * rate[0, 0])
    return p, right


def train(counts: list[tuple[str, tuple[int, ...], int]]) -> SpanModel:
    """From (kind, votes, how often)."""
    rows, target, weight, reliability = [], [], [], {}
    for kind in KINDS:
        own = [(v, n) for k, v, n in counts if k == kind]
        if not own:
            continue
        v, n = np.array([x[0] for x in own]), np.array([x[1] for x in own], float)
        p, right = estimate(v, n)
        reliability[kind] = [round(float(x), 4) for x in right]
        one = np.zeros((len(own), len(KINDS)))
        one[:, KINDS.index(kind)] = 1
        rows.append(np.hstack([one, v == 1, v == -1]))
        target.append(p)
        weight.append(np.sqrt(n))  # so that a very frequent pattern doesn't outweigh all others
    if not rows:
        return SpanModel({}, [0.0] * len(LABELERS), [0.0] * len(LABELERS), {})
    w = fit_linear(np.vstack(rows).astype(float), np.concatenate(target), np.concatenate(weight), ridge=0.1)
    k, m = len(KINDS), len(LABELERS)
    return SpanModel({kind: float(w[i]) for i, kind in enumerate(KINDS)}, [float(x) for x in w[k : k + m]], [float(x) for x in w[k + m :]], reliability)


def train_on(spans: DataFrame, column: str = "spans") -> SpanModel:
    counts = spans.select(F.explode(column).alias("s")).groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).collect()  # kinds x 3 ** labelers at most
    return train(sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in counts))


def final_spans(spans: Column, model: SpanModel, threshold: float = 0.5) -> Column:
    """array<struct<kind, start, end, base>>: base spans, and others that the classifier accepts where no base span is; by kind, then start."""
    base = F.filter(spans, lambda s: s["base"])
    more = F.filter(spans, lambda s: ~s["base"] & (model.score(s["kind"], s["votes"]) >= threshold) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(F.concat(base, more), lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")))
    return F.transform(F.array_sort(F.array_distinct(keyed)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))


def equals(kind: str):
    return lambda x: x == kind


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans) of each row of docs; spans as from final_spans."""
    found = materialize(docs.select(F.col(doc_id).alias("doc_id"), candidates(text_or_empty(text)).alias("spans")), "pii-candidates")
    return found.select("doc_id", final_spans(F.col("spans"), train_on(found)).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """text with each run of overlapping spans replaced by the kind of its first, in angle brackets."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out")))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in `text` replaced. The spans are found a second time, so that no text is shuffled or written.

    Columns of docs named _sf_found or _sf_spans are dropped; all others pass through.
    """
    t = text_or_empty(text)
    model = train_on(docs.select(candidates(t).alias("spans")))
    # Columns of their own: each is computed once, though it is used several times.
    found = docs.withColumn("_sf_found", candidates(t)).withColumn("_sf_spans", final_spans(F.col("_sf_found"), model))
    return found.withColumn(text, redacted(t, F.col("_sf_spans"))).drop("_sf_found", "_sf_spans")
