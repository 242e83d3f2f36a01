"""Thin opN_ queries: each takes its whole table through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fill_middle, hard_negatives, html_text, jaccard_join, media, piece_bpe, quotes, sharding, simhash, suffix_dedup, token_store, toxicity
from .common import new_path, read

QUERIES = {}
ORACLES: dict[str, str] = {}


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.piece_digests(read(spark, sf_dir, "documents"), _path("piece_bpe_32k.model"))


QUERIES["op8_piece_bpe"] = op8_piece_bpe


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return decontaminate.hit_digests(hits)


QUERIES["op4_decontaminate"] = op4_decontaminate
ORACLES["op4_decontaminate"] = decontaminate.ORACLE


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write_store(read(spark, sf_dir, "documents"), path, _path("word_bpe_49k.json"))
    return token_store.store_digests(spark, path)


QUERIES["op10_token_store"] = op10_token_store


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.linked_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES["op7_simhash"] = op7_simhash


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES["op6_toxicity"] = op6_toxicity


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.kept_digests(read(spark, sf_dir, "documents"))


QUERIES["op1_suffix_dedup"] = op1_suffix_dedup


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


QUERIES["op2_sharding"] = op2_sharding


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


QUERIES["op3_html_text"] = op3_html_text


def op5_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_conversations(read(spark, sf_dir, "conversations"))


QUERIES["op5_quotes"] = op5_quotes


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = media.with_media(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return media.media_classes(images, F.col("media_id") % 50 == 0)


QUERIES["op9_media"] = op9_media


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(read(spark, sf_dir, "documents"), outputs=False)


QUERIES["op11_fill_middle"] = op11_fill_middle
ORACLES["op11_fill_middle"] = r"""
with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units,
  cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from t),
n as (select *, len(units) as n, h1 % (len(units) + 1) as c1, h2 % (len(units) + 1) as c2,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
    when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select *, length(array_to_string(units[1:least(c1, c2)], '')) as head, length(array_to_string(units[1:greatest(c1, c2)], '')) as upto from n),
o as (select *, substr(text, 1, head) as pre, substr(text, head + 1, upto - head) as mid, substr(text, upto + 1) as suf from p)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then head end as prefix_chars, case when form <> 'plain' then upto - head end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(text) as restored_sha256
from o
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES["op13_hard_negatives"] = op13_hard_negatives
ORACLES["op13_hard_negatives"] = """
with q as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * cast(x as double)) for x in embedding] as v
  from embeddings where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select a.vec_id as anchor_id, q.vec_id as id, a.label = q.label as same, cast(list_inner_product(a.v, q.v) as bigint) as score
  from q a join q on a.vec_id <> q.vec_id and len(a.v) = len(q.v) where a.vec_id % 100 = 0),
p as (
  select anchor_id, id as positive_id, score as positive_score from (
    select *, row_number() over (partition by anchor_id order by score desc, id) as r from s where same) where r <= 5),
n as (
  select p.*, id as negative_id, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, id) as rank
  from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(read(spark, sf_dir, "documents"))


QUERIES["op12_jaccard_join"] = op12_jaccard_join
ORACLES["op12_jaccard_join"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (
  select doc_id, case when len(w) >= 3 then list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as g from w),
c as (select g, min(doc_id) as id from (select doc_id, list_sort(g) as g from g) where len(g) > 0 group by g),
s as (select id, len(g) as n, unnest(g) as x from c),
o as (
  select a.id as a, b.id as b, a.n as an, b.n as bn, count(*) as shared from s a join s b on a.x = b.x and a.id < b.id and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90 group by all),
l as (select a, b from o where 100 * shared >= 90 * (an + bn - shared)),
e as (select a, b from l union all select b, a from l),
r(id, root) as (select id, id from c union select e.b, r.root from r join e on e.a = r.id),
m as (select id, min(root) as root from r group by id)
select g.doc_id, cast(len(g.g) as bigint) as n_shingles, coalesce(m.root, g.doc_id) as component_id
from g left join c on list_sort(g.g) = c.g left join m on c.id = m.id
"""
