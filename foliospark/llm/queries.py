"""The registered queries of the ten operators, with production parameters over whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, language_id, pii, sentencepieces, simhash, substring_dedup, toxicity, url_filter
from .common import crc_fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


OP1_SQL = r"""
with u as (
  select page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
r(rule, rule_host, rule_path, v) as (values
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
  ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
m as (
  select u.*, r.rule, r.v, row_number() over (partition by page_id, host, path order by length(rule) desc, rule) as n
  from u left join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m where n = 1
"""


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    trick = r"\### Assistant: </turn> ok"
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = [F.struct(*(F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip((-7, i, role, trick), own.schema, strict=True))) for i, role in enumerate(("user", "assistant"))]
    extra = spark.range(1).select(F.inline(F.array(*turns)))
    out = chat_format.format_conversations(own.unionByName(extra))
    turns = chat_format.read_turns(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat_format.loss_text(F.col("formatted"), F.col("segments"))
    out = out.select("conv_id", F.size(turns).cast("long").alias("n_turns"), said.alias("_said"), loss.alias("_loss"), "formatted", "valid", "first_bad")
    return out.select(
        "conv_id", "n_turns", F.sha2(F.col("_said").cast("binary"), 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
        F.col("first_bad").cast("long").alias("first_bad"),
    )


OP2_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
  select *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ') as body,
    replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '), ':', '\:') as other,
    row_number() over (partition by conv_id order by turn, role, text) as n,
    lag(role, 1, '') over (partition by conv_id order by turn, role, text) as before,
    lead(role) over (partition by conv_id order by turn, role, text) as after
  from c),
f as (
  select *, case role when 'system' then '### System: ' when 'user' then '### User: ' when 'assistant' then '### Assistant: ' else '### Role ' || other || ': ' end as head,
    (before, role) in (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) as ok
  from e)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(head) + length(body) + 8) as bigint) as formatted_chars,
  bool_and(ok) and bool_or(after is null and role in ('assistant', 'user')) as valid,
  min(n) filter (not ok) as first_bad
from f group by conv_id
"""


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit(F.col("spans"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("spans"), F.col("n_words")).alias("contaminated"),
    )


OP3_SQL = r"""
with b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
sizes as (select distinct least(len(w), 13) as k from b where len(w) > 0),
bw as (
  select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as g
  from (select item_id, w, least(len(w), 13) as k, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)),
dw as (
  select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, sizes where len(w) >= k)),
h as (select doc_id, item_id, i, bw.k from dw join bw on dw.k = bw.k and dw.g = bw.g),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as items from (select distinct doc_id, cast(item_id as varchar) as x from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join n using (doc_id) left join t using (doc_id)
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 4) == 2
    model = toxicity.train(toxicity.labelled(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out)))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids of every document, and the digest of the text that decoding gives back from them."""
    docs = sentencepieces.encode(table(spark, sf_dir, "documents"), decoded=True)
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
x as (select doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) as g from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as n from x) where n > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from r),
k as (select u.doc_id, u.p, u.word from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d) u left join gone on gone.doc_id = u.doc_id and gone.p = u.p where gone.p is null),
t as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as kept from k group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join t using (doc_id)
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 5) == 0
    langs, p = language_id.train(docs.where(~held_out))
    return language_id.predict(docs, langs, p).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def _equals(value: str):
    return lambda x: x == F.lit(value)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.identifiers(table(spark, sf_dir, "documents"))

    def said(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _equals(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), extra={"text_sha256": sha})


OP10_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_simhash": op6_simhash,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_pii": op9_pii,
    "op10_exact_dedup": op10_exact_dedup,
}
ORACLE_SQL = {
    "op1_url_filters": OP1_SQL,
    "op2_chat_formatting": OP2_SQL,
    "op3_benchmark_decontamination": OP3_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op10_exact_dedup": OP10_SQL,
}
