"""One query for every operator, over its whole table with production parameters."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    alignment, decontamination, host_rules, jaccard, langid, neardup, negatives, packing, pieces, pii, quality, sharding, toxicity,
)
from .common import table

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


@query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents"))


def fold(folds: int) -> F.Column:
    """The fold of a document: crc32 of its id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % folds


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold(5) != 0).select("doc_id", "text", "lang"))
    return langid.label_documents(docs, model).select(
        "doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score")


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(4) != 2)
    return toxicity.score_documents(docs, model).select(
        "doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted")


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold(3) != 1)
    return quality.score_documents(docs, model).select(
        "doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_by_shingles(table(spark, sf_dir, "documents"))


ORACLES["op6_jaccard_join"] = r"""
with recursive w as (
  select doc_id, [x for x in regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+')
    if x <> ''] as w from documents),
s as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end)) as s from w),
n as (select w.doc_id, count(s.s) as n from w left join s using (doc_id) group by 1),
link as (
  select a.doc_id as a, b.doc_id as b from s a join s b on a.s = b.s and a.doc_id <> b.doc_id
  join n p on p.doc_id = a.doc_id join n q on q.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, p.n, q.n having 100 * count(*) >= 75 * (p.n + q.n - count(*))),
reach as (select a, b from link union select reach.a, link.b from reach join link on reach.b = link.a)
select n.doc_id, n.n as n_shingles, least(n.doc_id, coalesce(min(reach.b), n.doc_id)) as component_id
from n left join reach on reach.a = n.doc_id group by n.doc_id, n.n
"""


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


_WORDS = r"[x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> '']"
ORACLES["op10_quality_rules"] = rf"""
with w as (select doc_id, source, coalesce(text, '') as t, {_WORDS} as w from documents),
runs as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from w where len(w) > 2),
marked as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from runs),
covered as (select doc_id, count(distinct p) as n from (
  select doc_id, unnest([i, i + 1, i + 2]) as p from marked where n > 1) group by doc_id),
stats as (select w.doc_id, source, cast(len(w) as bigint) as n_words,
    cast(coalesce(list_sum([length(x) for x in w]), 0) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len([x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')])
      - len(list_distinct([x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')])) as bigint) as n_dup_lines,
    cast(coalesce(covered.n, 0) as bigint) as n_repeat_words from w left join covered using (doc_id)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from stats),
hosts as (select source, count(*) as docs, count(*) filter (base_failed) as failed from judged where source is not null group by 1),
prior as (select avg(failed / docs) as m, var_pop(failed / docs) as v from hosts),
weighed as (select m, case when v > 0 and v < m * (1 - m) then m * (1 - m) / v - 1 else 1.0 end as k from prior),
verdicts as (select source, (failed + m * k) / (docs + k) > 0.5 and docs >= 20 as bad from hosts, weighed)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(bad, false) as kept
from judged left join verdicts using (source)
"""

ORACLES["op9_embedding_dedup"] = """
with recursive e as (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
    and len([x for x in embedding if x <> 0]) > 0),
link as (select a.vec_id as a, b.vec_id as b from e a join e b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.9),
reach as (select a, b from link union select reach.a, link.b from reach join link on reach.b = link.a),
links as (select a, count(*) as n from link group by a),
found as (select a, min(b) as c from reach group by a)
select t.vec_id, cast(coalesce(links.n, 0) as bigint) as n_links, least(t.vec_id, coalesce(found.c, t.vec_id)) as component_id,
  t.vec_id = least(t.vec_id, coalesce(found.c, t.vec_id)) as kept
from embeddings t left join links on links.a = t.vec_id left join found on found.a = t.vec_id
"""


@query
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LETTERS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLES["op11_decontamination"] = rf"""
with d as (select doc_id, {_LETTERS} as w from documents),
b as (select item_id, {_LETTERS} as w from benchmark),
items as (select item_id, w, least(10, len(w)) as need from b where len(w) > 0),
windows as (select item_id, need, unnest(range(1, len(w) - need + 2)) as i, w from items),
own as (select item_id, need, i, array_to_string(w[i:i + need - 1], ' ') as g from windows),
needs as (select distinct need from items),
places as (select doc_id, need, unnest(range(1, len(w) - need + 2)) as p, w from d, needs where len(w) >= need),
grams as (select doc_id, need, p, array_to_string(w[p:p + need - 1], ' ') as g from places),
met as (select doc_id, item_id, grams.need, p, i from grams join own on grams.need = own.need and grams.g = own.g),
hit as (select doc_id, count(distinct q) as n from (select doc_id, unnest(range(p, p + need)) as q from met) group by 1),
named as (select doc_id, count(distinct item_id) as n, sha256(string_agg(distinct cast(item_id as varchar), ','
  order by cast(item_id as varchar))) as h from met group by 1),
runs as (select doc_id, need, p - row_number() over (partition by doc_id, item_id, p - i order by p) as run,
  item_id, p - i as line from met),
longest as (select doc_id, max(n) as n from (
  select doc_id, count(*) + need - 1 as n from runs group by doc_id, item_id, need, line, run) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(hit.n, 0) as bigint) as n_hit,
  cast(coalesce(named.n, 0) as bigint) as n_items, coalesce(h, sha256('')) as items_sha256,
  coalesce(hit.n, 0) > 0 as contaminated, cast(coalesce(longest.n, 0) as bigint) as longest
from d left join hit using (doc_id) left join named using (doc_id) left join longest using (doc_id)
"""


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(
        table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), tokenizer("piece_bpe_32k.model"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLES["op13_hard_negatives"] = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select a.vec_id as a, a.label = b.label as same, b.vec_id as b,
    cast(coalesce(list_sum([a.v[i] * b.v[i] for i in range(1, len(a.v) + 1)]), 0) as bigint) as score
  from e a join e b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 50 = 0),
p as (select a, b as p, score as ps from s where same
  qualify row_number() over (partition by a order by score desc, b) <= 5),
n as (select p.a, p, ps, s.b as n, score as ns from p join s on s.a = p.a and not same
  where 50 * ps <= 100 * score and 100 * score <= 95 * ps)
select a as anchor_id, p as positive_id, cast(row_number() over (partition by a, p order by ns desc, n) as integer) as rank,
  n as negative_id, ps as positive_score, ns as negative_score from n
qualify row_number() over (partition by a, p order by ns desc, n) <= 3
"""
