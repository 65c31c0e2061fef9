"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, langid, line_dedup, lm, quality, simhash, topk, toxicity
from .common import in_fold, table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold("doc_id", 4, 2)
    judge = langid.train(docs.where(~held_out).select("doc_id", "text", "lang"))
    out = langid.identify(docs.select("doc_id", "text"), judge)
    return out.select("doc_id", held_out.alias("held_out"), F.col("langid.lang").alias("lang_pred"), "langid.score", "langid.rejected", "langid.cross_entropy")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "main.text", F.length("main.text").cast("bigint").alias("n_chars"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm.score(docs, F.col("doc_id").isNotNull() & ~in_fold("doc_id", 10, 0), in_fold("doc_id", 10, 1))
    return out.withColumnRenamed("id", "doc_id").select("doc_id", in_fold("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def _scored(spark: SparkSession, sf_dir: str, operator, label: str, least: float) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_fold("doc_id", 5, 0)
    model = operator.train(docs, table(spark, sf_dir, "labels").where(~held_out).select("doc_id", label))
    out = operator.score(docs, model, name="scored")
    score = F.col("scored.score")
    return out.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= least).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality, "quality", 0.3)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity, "toxic", 0.5)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.col("bpe.ids")
    return out.select(
        "doc_id",
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("bpe.decoded"), 256).alias("decoded_sha256"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return out.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["item_ids"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(c["item_ids"], ",").cast("binary"), 256).alias("items_sha256"),
        (c["n_hit"] > 0).alias("contaminated"),
    )


OP10_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents),
b as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from benchmark where text is not null),
bw as (
  select distinct item, least(len(ws), 10) as n, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') as win
  from (select item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from b where len(ws) > 0)),
d as (
  select w.doc_id, p.i, s.n, array_to_string(list_slice(w.ws, p.i, p.i + s.n - 1), ' ') as win
  from w cross join (select distinct n from bw) s cross join lateral (select unnest(range(1, len(w.ws) - s.n + 2)) as i) p),
h as (select d.doc_id, d.i, d.n, bw.item from d join bw on d.win = bw.win and d.n = bw.n),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
it as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by doc_id)
select w.doc_id, cast(len(w.ws) as bigint) as n_words, cast(coalesce(c.n_hit, 0) as bigint) as n_hit,
  cast(coalesce(it.n_items, 0) as bigint) as n_items, sha256(coalesce(it.items, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from w left join c using (doc_id) left join it using (doc_id)
"""


OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

OP8_SQL = r"""
with d as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
l as (select doc_id, len(ls) as n, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from d where text is not null),
h as (select *, cast('0x' || substr(md5(line), 1, 8) as bigint) as h from l),
m as (select doc_id, n, i, (h * 31 + lead(h) over (partition by doc_id order by i)) % 9 as m from h),
p as (
  select *, lag(i) over w as last_i, lag(m) over w as last_m from m where m > 0 window w as (partition by doc_id order by i)),
b as (
  select doc_id, n, case when m % 3 > 0 then i else last_i end as s, i + 2 as e from p
  where m >= 3 and (m % 3 > 0 or coalesce(last_m in (1, 2), false))),
c as (
  select doc_id, n, s + j * (e - s) // many as s, s + (j + 1) * (e - s) // many as e
  from (select *, (e - s + 31) // 32 as many, unnest(range((e - s + 31) // 32)) as j from b)),
o as (select *, coalesce(lag(s) over w, 1) as lo, coalesce(lead(e) over w, n + 1) as hi from c window w as (partition by doc_id order by s)),
t as (
  select o.doc_id, s, e, lo, hi, string_agg(line, chr(10) order by i) as chunk
  from o join l on o.doc_id = l.doc_id and i >= s and i < e group by o.doc_id, s, e, lo, hi),
g as (
  select *, row_number() over w as r, first_value(doc_id) over w as doc_0, first_value(s) over w as s_0, first_value(e) over w as e_0,
    first_value(lo) over w as lo_0, first_value(hi) over w as hi_0
  from t window w as (partition by chunk order by doc_id, s)),
x as (select *, greatest(lo, s - (s_0 - lo_0)) as least, least(hi, e + (hi_0 - e_0)) as most from g where r > 1),
y as (
  select x.doc_id, x.s, x.least, x.most, max(a.i) filter (a.i < x.s and a.line <> k.line) as below, min(a.i) filter (a.i >= x.e and a.line <> k.line) as above
  from x join l a on a.doc_id = x.doc_id and a.i >= x.least and a.i < x.most join l k on k.doc_id = x.doc_0 and k.i = a.i - x.s + x.s_0
  group by x.doc_id, x.s, x.least, x.most),
z as (select distinct l.doc_id, l.i from l join y on l.doc_id = y.doc_id and l.i >= coalesce(below + 1, least) and l.i < coalesce(above, most)),
k as (select l.doc_id, count(*) as n, string_agg(line, chr(10) order by i) as text from l anti join z on l.doc_id = z.doc_id and l.i = z.i group by l.doc_id)
select d.doc_id, cast(coalesce(len(ls), 0) as bigint) as n_lines, cast(coalesce(len(ls), 0) - coalesce(k.n, 0) as bigint) as n_removed,
  cast(length(coalesce(k.text, '')) as bigint) as n_chars, sha256(coalesce(k.text, '')) as text_sha256
from d left join k using (doc_id)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository's top, so it may not be found from elsewhere: only this query needs it

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": op1_langid,
        "op2_html": op2_html,
        "op3_topk": op3_topk,
        "op4_lm": op4_lm,
        "op5_simhash": op5_simhash,
        "op6_quality": op6_quality,
        "op7_bpe": op7_bpe,
        "op8_line_dedup": op8_line_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_decontamination": op10_decontamination,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3_SQL, "op8_line_dedup": OP8_SQL, "op10_decontamination": OP10_SQL}
