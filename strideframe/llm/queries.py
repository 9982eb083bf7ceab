"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import ann, langid, licenses, line_dedup, negatives, ogg, packing, pieces, pii, quality, simhash, spelling, toxicity
from strideframe.llm.common import held_out, table, text_or_empty


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizers are installed; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty("text")
    stored = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), ogg.store(text).alias("media"))
    return stored.select("doc_id", "n_bytes", ogg.summary("media").alias("s")).select("doc_id", "n_bytes", "s.*")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base.getField("kind"), pii.equals(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.joined_spans(base), 256).alias("base_sha256"), pii.joined_spans(F.col("spans")).alias("spans"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    return toxicity.score_documents(table(spark, sf_dir, "documents"), labels).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.summary(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.near_duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out("doc_id", 3, 1)))
    said = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), langid.predicted(model, spark, F.col("text")).alias("s"))
    return said.select("doc_id", "held_out", "s.lang_pred", "s.score", "s.languages")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.integer_rows(table(spark, sf_dir, "embeddings"), label=label)
    return negatives.mine(rows, F.col("vec_id") % 100 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spelling.runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    word = F.when(F.coalesce(h % 199 == 0, F.lit(False)), spelling.without_letter("run", h % F.length("run"))).otherwise(F.col("run"))
    return spelling.variant_forms(spelling.vocabulary(rows, word))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ogg, op2_line_dedup, op3_license_scan, op4_packing, op5_pii, op6_toxicity, op7_sentencepiece, op8_collision_search, op9_simhash, op10_language_id, op11_quality_rules, op12_hard_negatives, op13_spelling_variants, pipeline)}


OP2_SQL = r"""
with lines as (
  select row_number() over () as r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
hot as (select k from (select distinct r, k from keyed where length(k) >= 1) group by k having count(*) >= 10)
select doc_id, count(*) as n_lines, count(hot.k) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where hot.k is null), '')) as kept_sha256
from keyed left join hot using (k) group by r, doc_id
"""


_BLANK = r"[\x20\x09-\x0D]"

OP11_SQL = rf"""
with params as (select 32 as n_common, 200 as min_chars, 40 as min_words, 20 as min_docs, 0.09 as char_limit, 0.09 as word_limit, 10000000 as vote),
docs as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as t from documents),
words as (select r, list_filter(string_split_regex(t, '{_BLANK}+'), lambda w: w <> '') as w from docs),
windows as (select r, i, array_to_string(w[i:i + 4], ' ') as win from (select r, w, unnest(range(1, len(w) - 3)) as i from words where len(w) >= 5)),
again as (select r, i from (select r, i, count(*) over (partition by r, win) as n from windows) where n > 1),
covered as (select r, sum(least(5, coalesce(later - i, 5))) as n from (select r, i, lead(i) over (partition by r order by i) as later from again) group by r),
lines as (select r, list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '{_BLANK}+', '', 'g')) > 0) as l from docs),
base as (
  select d.r, doc_id, lang, t, len(w) as n_words, length(regexp_replace(t, '{_BLANK}+', '', 'g')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words
  from docs d join words using (r) join lines using (r) left join covered c using (r)),
cls as (
  select docs.r, doc_id, lang, length(t) as n,
    [length(t) - length(regexp_replace(t, p, '', 'g')) for p in ['[a-z]+', '{_BLANK}+', '[A-Z]+', '[0-9]+', '[.,;:!?''"()-]+', '[\x00-\x08\x0E-\x1F#$%&*+/<=>@\[\\\]^_`{{|}}~\x7F]+', '[^\x00-\x7F]+']] as c, w as tok
  from docs join words using (r)),
long as (select cls.* from cls, params where lang is not null and n >= min_chars and len(tok) >= min_words),
sums as (select lang, k, sum(s) as s from (select lang, unnest(range(1, 8)) as k, unnest([cast(floor(x * 10000000.0 / n) as bigint) for x in c]) as s from long) group by lang, k),
ref as (select lang, list(s / total order by k) as chars from (select lang, k, cast(s as double) as s, sum(cast(s as double)) over (partition by lang) as total from sums) group by lang),
counts as (select lang, count(*) as n_docs from long group by lang),
votes as (select lang, w, sum(v) as v from (select lang, cast(floor(10000000.0 / len(tok)) as bigint) as v, unnest(tok) as w from long) where length(w) <= 6 group by lang, w),
top as (select lang, w, v, row_number() over (partition by lang order by v desc, w) as k from votes qualify k <= (select n_common from params)),
known as (
  select lang, any_value(chars) as chars, list(w order by k) as common, list(v / (10000000.0 * n_docs) order by k) as shares
  from top join ref using (lang) join counts using (lang), params where n_docs >= min_docs group by lang),
seen as (
  select cls.r, known.chars as q, [x / n for x in c] as p, n, len(tok) as k, len(common) as m,
    list_transform(common, lambda x: len(list_filter(tok, lambda w: w = x)) / len(tok)) as a, shares as b
  from cls join known using (lang), params where n >= min_chars and len(tok) >= min_words),
full_ as (select *, list_append(a, greatest(0.0, 1.0 - list_sum(a))) as pw, list_append(b, greatest(0.0, 1.0 - list_sum(b))) as qw from seen),
js as (
  select r, n, k, m,
    list_sum([case when x[1] > 0 then x[1] * log2(x[1] / ((x[1] + x[2]) / 2)) else 0 end + case when x[2] > 0 then x[2] * log2(x[2] / ((x[1] + x[2]) / 2)) else 0 end for x in list_transform(range(1, len(p) + 1), lambda i: [p[i], q[i]])]) / 2 as cd,
    list_sum([case when x[1] > 0 then x[1] * log2(x[1] / ((x[1] + x[2]) / 2)) else 0 end + case when x[2] > 0 then x[2] * log2(x[2] / ((x[1] + x[2]) / 2)) else 0 end for x in list_transform(range(1, len(pw) + 1), lambda i: [pw[i], qw[i]])]) / 2 as wd
  from full_),
said as (select r, cd > char_limit + 6 / (8 * ln(2) * n) or wd > word_limit + m / (8 * ln(2) * k) as odd from js, params)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or coalesce(odd, false)) as kept
from base left join said using (r)
"""

OP12_SQL = """
with usable as (
  select row_number() over () as r, vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_sum([x[1] * x[2] for x in list_zip(a.q, b.q)]) as bigint) as score
  from usable a join usable b on a.r <> b.r where a.vec_id % 100 = 0),
positive as (select anchor_id, other_id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, other_id) as int) as rank, other_id as negative_id, positive_score, score as negative_score
from positive join scored using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""

OP13_SQL = """
with recursive crc as (
  select list(c order by b) as t from (
    select b, list_reduce(range(9), lambda c, i: case when i = 0 then c when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b) as c from range(256) x(b))),
run as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) as w from documents),
per as (select doc_id, w, count(*) as k from run group by doc_id, w),
bytes as (
  select doc_id, w, k, flatten([case when c < 128 then [c] else [192 | (c >> 6), 128 | (c & 63)] end for c in [cast(unicode(x) as bigint) for x in string_split(concat(cast(doc_id as varchar), ':', w), '')]]) as b
  from per where doc_id is not null),
hashed as (select doc_id, w, k, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), cast(4294967295 as bigint)), 4294967295) as h from bytes, crc),
slipped as (
  select case when h % 199 = 0 then concat(substr(w, 1, h % length(w)), substr(w, h % length(w) + 2)) else w end as word, k from hashed
  union all select w, k from per where doc_id is null),
vocab as (select word, cast(sum(k) as bigint) as n from slipped where length(word) >= 6 group by word having sum(k) >= 5),
cut as (select word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from vocab)),
pair as (
  select a.word, a.n, b.word as near, b.n as near_n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, a.n, b.word, b.n from cut a join vocab b on a.rest = b.word
  union select b.word, b.n, a.word, a.n from cut a join vocab b on a.rest = b.word),
best as (select word, count(*) as n_near, first(near order by near_n desc, near) as near, max(near_n) as near_n from pair group by word),
formed as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when near_n >= 5 * v.n then near end as form, case when near_n >= 5 * v.n then near_n end as form_n from vocab v left join best using (word)),
way as (select word, word as spot, 0 as k from formed union all select w.word, f.form, k + 1 from way w join formed f on w.spot = f.word where f.form is not null)
select f.word, form, root, n, n_near, form_n from formed f join (select word, arg_max(spot, k) as root from way group by word) using (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op11_quality_rules": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_spelling_variants": OP13_SQL}
