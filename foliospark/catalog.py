"""The engine's registered queries over the driver tables, each with the same question in plain SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import config, corpus
from .functions import patterns as P
from .functions import families, readability, signals
from .functions import text as T
from .operators import blocks as B
from .operators import changes, chapters, integrity, mask, ranking, rewrite, suggest
from .plans import execution

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")


# ---- the same expressions for the SQL side
def n_of(t: str, p: str) -> str:
    return f"len(regexp_extract_all({t}, '{p}'))"


def lit_n(t: str, words) -> str:
    return "(" + " + ".join(f"(length({t}) - length(replace({t}, '{w}', ''))) // {len(w)}" for w in words) + ")"


def any_of(t: str, words) -> str:
    return "(" + " or ".join(f"contains({t}, '{w}')" for w in words) + ")"


def starts(t: str, words) -> str:
    return "(" + " or ".join(f"starts_with({t}, '{w}')" for w in words) + ")"


def sent(t: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({t}, '{P.SENTENCE}'), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> '')"


CORPUS = f"blocks as ({corpus.BLOCKS})"
ENGLISH_SQL = "(trim({t}) <> '' and not regexp_matches({t}, '[\\x{{4e00}}-\\x{{9fff}}]') and (len(regexp_extract_all({t}, '[A-Za-z]+(-[A-Za-z]+)*')) >= 4{alt}) and length(regexp_replace({t}, '[^A-Za-z]', '', 'g')) >= {share} * length(regexp_replace({t}, '\\s', '', 'g')))"


def english_sql(t: str, least: int | None = None, share: float = 0.45) -> str:
    alt = f" or length(regexp_replace({t}, '[^A-Za-z]', '', 'g')) >= {least}" if least else ""
    return ENGLISH_SQL.format(t=t, alt=alt, share=share)


# ---- documents as they are
@query(f"""
select doc_id, length(text) as n_chars, len(string_split(text, chr(10))) as n_lines, len({sent('text')}) as n_sentences,
  {n_of('text', P.NUMBER)} as n_numbers, {n_of('text', '[A-Z][A-Z]+')} as n_capitals, {english_sql('text', 24)} as english,
  case when {english_sql('text', 24)} then 'do_not_touch' else 'rewritable' end as risk
from documents""")
def q_doc_profile(spark, sf_dir):
    t = F.col("text")
    english = T.english(t, 24)
    return documents(spark, sf_dir).select(
        "doc_id", F.length(t).alias("n_chars"), F.size(F.split(t, "\n")).alias("n_lines"), F.size(T.sentences(t)).alias("n_sentences"),
        F.regexp_count(t, F.lit(P.NUMBER)).alias("n_numbers"), F.regexp_count(t, F.lit("[A-Z][A-Z]+")).alias("n_capitals"), english.alias("english"),
        F.when(english, "do_not_touch").otherwise("rewritable").alias("risk"),
    )


KIND_SQL = """case when trim({l}, ' ' || chr(9) || chr(13)) = '' then 'blank' when regexp_matches(trim({l}), '^\\s{{0,3}}#{{1,6}}\\s+') then 'heading'
 when regexp_matches(trim({l}), '^\\[[^\\]]+\\]:\\s+\\S+') then 'link_def' when regexp_matches(trim({l}), '^([-*+]\\s+|\\d+\\.\\s+)') then 'list'
 when starts_with(trim({l}), '>') then 'quote'
 when (starts_with(trim({l}), '|') and len(regexp_extract_all({l}, '\\|')) >= 2) or (contains({l}, '|') and regexp_matches(trim({l}), '^[:\\-\\|\\s]+$')) then 'table'
 else 'paragraph' end"""


@query(f"select doc_id, kind, count(*) as n from (select doc_id, {KIND_SQL.format(l='line')} as kind from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)) group by all")
def q_line_kinds(spark, sf_dir):
    return B.lines(documents(spark, sf_dir)).groupBy("doc_id", B.line_kind(F.col("line")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


CHUNK_SQL = f"""
l as (select doc_id, line, line_no - 1 as line_no from (select doc_id, unnest(s) as line, unnest(range(1, len(s) + 1)) as line_no from (select doc_id, string_split(text, chr(10)) as s from src))),
k as (select *, {KIND_SQL.format(l='line')} as own, regexp_matches(line, '^[ \\t]') as ind from l),
k2 as (select *, last_value(case when ind and own <> 'blank' then null else own end ignore nulls) over (partition by doc_id order by line_no) as lead_kind from k),
k3 as (select *, case when ind and own <> 'blank' and lead_kind = 'list' then 'list' else own end as kind from k2),
k4 as (select *, case when lag(kind) over w is null or lag(kind) over w <> kind or kind in ('placeholder', 'heading', 'link_def') then 1 else 0 end as new from k3 window w as (partition by doc_id order by line_no)),
k5 as (select *, sum(new) over (partition by doc_id order by line_no) as block_id from k4)
select doc_id, cast(block_id as bigint) as block_id, any_value(kind) as kind, count(*) as n_lines, string_agg(line, chr(10) order by line_no) as block_text from k5 group by doc_id, block_id"""


@query(f"with src as (select col0 as doc_id, col1 as text from {corpus.LINES} union all select doc_id + 1000, text from documents), {CHUNK_SQL}")
def q_md_chunks(spark, sf_dir):
    own = corpus.sample_lines(spark).select(F.col("doc_id").cast("long"), "text")
    return B.chunks(B.lines(own.unionByName(documents(spark, sf_dir).select((F.col("doc_id") + 1000).alias("doc_id"), "text"))))


@query(f"select doc_id, unnest(range(1, len(s) + 1)) as sent_idx, unnest(s) as sentence from (select doc_id, {sent('text')} as s from documents)")
def q_sentences_b(spark, sf_dir):
    df = documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))
    return df.select("doc_id", (F.col("i") + 1).cast("long").alias("sent_idx"), "sentence")


@query(f"""select doc_id, len(s) as n, len(list_filter(s, lambda x: regexp_matches(x, '[A-Za-z0-9\\x{{4e00}}-\\x{{9fff}}]'))) as n_visible,
  coalesce(list_max(list_transform(s, lambda x: length(x))), 0) as longest, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::bigint as chars
from (select doc_id, {sent('text')} as s from documents)""")
def q_sentence_stats(spark, sf_dir):
    s = T.sentences(F.col("text"))
    sizes = F.transform("s", lambda x: F.length(x))
    return documents(spark, sf_dir).select("doc_id", s.alias("s")).select(
        "doc_id", F.size("s").alias("n"), F.size(F.filter("s", lambda x: x.rlike(r"[A-Za-z0-9\x{4e00}-\x{9fff}]"))).alias("n_visible"),
        F.coalesce(F.array_max(sizes), F.lit(0)).alias("longest"), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("chars"),
    )


@query(f"""with {CORPUS} select block_key, list_aggregate(regexp_extract_all(text, '[^。！？!?；;]+[。！？!?；;]?|[。！？!?；;]'), 'string_agg', '|') as pieces from blocks""")
def q_sentence_breaks(spark, sf_dir):
    return corpus.blocks(spark, sf_dir).select("block_key", F.array_join(T.breaks(F.col("text")), "|").alias("pieces"))


@query(f"with {CORPUS} select block_key, len({sent('text')}) as n, list_aggregate({sent('text')}, 'string_agg', '|') as joined from blocks")
def q_sentences_depth(spark, sf_dir):
    df = corpus.blocks(spark, sf_dir).select("block_key", T.bracket_sentences(F.col("text")).alias("s"))
    return df.select("block_key", F.size("s").alias("n"), F.array_join("s", "|").alias("joined"))


@query(f"""select doc_id, kind, ordinal, value from (
 select doc_id, 'number' as kind, unnest(range(1, len(v) + 1)) as ordinal, unnest(v) as value from (select doc_id, regexp_extract_all(text, '{P.NUMBER}') as v from documents)
 union all select doc_id, 'citation', unnest(range(1, len(v) + 1)), unnest(v) from (select doc_id, regexp_extract_all(text, '{P.CITATION}') as v from documents)
 union all select doc_id, 'url', unnest(range(1, len(v) + 1)), unnest(v) from (select doc_id, regexp_extract_all(text, '{P.URL}') as v from documents))""")
def q_spans(spark, sf_dir):
    df = documents(spark, sf_dir)
    parts = [df.select("doc_id", F.lit(k).alias("kind"), F.posexplode(T.find_all(F.col("text"), p)).alias("i", "value")) for k, p in (("number", P.NUMBER), ("citation", P.CITATION), ("url", P.URL))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("doc_id", "kind", (F.col("i") + 1).cast("long").alias("ordinal"), "value")


PLAIN_NUMBER = "(case when contains(regexp_replace(x, '%$', ''), '.') then regexp_replace(regexp_replace(regexp_replace(x, '%$', ''), '0+$', ''), '\\.$', '') else regexp_replace(x, '%$', '') end || case when ends_with(x, '%') then '%' else '' end)"


@query(f"with {CORPUS} select block_key, coalesce(list_aggregate(list_transform(regexp_extract_all(text, '{P.NUMBER}'), lambda x: {PLAIN_NUMBER}), 'string_agg', ','), '') as numbers from blocks")
def q_spans_numbers(spark, sf_dir):
    return corpus.blocks(spark, sf_dir).select("block_key", F.array_join(T.numbers(F.col("text")), ",").alias("numbers"))


def _terms_sql(t: str) -> str:
    first = " || ".join(f"regexp_extract_all({t}, '{p}')" for p in P.TERMS[:5])
    last = f"list_transform(regexp_extract_all({t}, '[A-Za-z][A-Za-z0-9_-]{{2,}}([\\x{{4e00}}-\\x{{9fff}}，。；、:：\\s]|$)'), lambda x: regexp_replace(x, '[\\x{{4e00}}-\\x{{9fff}}，。；、:：\\s]$', ''))"
    return f"list_transform({first} || {last}, lambda x: lower(regexp_replace(x, '\\s+', '', 'g')))"


@query(f"with {CORPUS} select block_key, len(list_distinct({_terms_sql('text')})) as n_terms, coalesce(list_aggregate(list_sort(list_distinct({_terms_sql('text')})), 'string_agg', ','), '') as terms from blocks")
def q_spans_terms(spark, sf_dir):
    t = T.terms(F.col("text"))
    return corpus.blocks(spark, sf_dir).select("block_key", F.size(t).alias("n_terms"), F.array_join(F.array_sort(t), ",").alias("terms"))


@query(f"select doc_id, {english_sql('text')} as strict, {english_sql('text', 24)} as guide, {english_sql('text', 24, 0.65)} as skeleton from documents union all select -block_key, {english_sql('text')}, {english_sql('text', 24)}, {english_sql('text', 24, 0.65)} from ({corpus.BLOCKS})")
def q_english_blocks(spark, sf_dir):
    t = F.col("text")
    cols = [T.english(t).alias("strict"), T.english(t, 24).alias("guide"), T.english(t, 24, 0.65).alias("skeleton")]
    return documents(spark, sf_dir).select("doc_id", *cols).unionByName(corpus.blocks(spark, sf_dir).select((-F.col("block_key")).alias("doc_id"), *cols))


# ---- blocks with a policy
POLICY_SQL = f"""
f as (select *, {n_of('text', P.CITATION)} as n_citations, {n_of('text', P.NUMBER)} as n_numbers, len(list_distinct({_terms_sql('text')})) as n_terms,
  regexp_matches(text, '{P.PATH}') as has_path, {lit_n('text', P.META_OPENERS)} as meta_density, {lit_n('text', P.TEMPLATE_CONNECTORS)} as template_density,
  {n_of('text', P.FUNCTION_WORDS)} as function_density, {n_of('text', P.STIFF_VERBS)} as stiff_density,
  regexp_matches(text, '{P.DENSE_NOMINAL}') or {lit_n('text', ['的'])} >= 5 as dense_nominal,
  case when regexp_matches(text, '^\\s{{0,3}}#{{1,6}}\\s+') then 'heading' when regexp_matches(text, '{P.REFERENCE}') then 'reference' when {english_sql('text', 24)} then 'english_block'
    when regexp_matches(text, '^(图|表)\\s*\\d+(-\\d+)?[^\\n]*$') then 'caption' when len(regexp_extract_all(text, '\\|')) >= 2 then 'table'
    when regexp_matches(text, '{P.LIST_START}') then 'list' else 'narrative' end as kind
  from blocks),
p as (select *, case when kind in ('heading', 'reference', 'english_block', 'caption', 'table', 'list') then 'frozen'
    when has_path or (n_citations >= 2 and n_numbers >= 3) or (n_citations >= 2 and n_terms >= 4) then 'high'
    when n_citations >= 2 or n_numbers >= 3 or n_terms >= 4 or contains(text, '：') or regexp_matches(text, '{P.LEADING_NUMBER}') or regexp_matches(text, '{P.LIGHT_EDIT}')
      or ({any_of('text', P.META_OPENERS)} and regexp_matches(text, '{P.META_TOPIC}')) then 'light' else 'open' end as rung from f),
pol as (select *, case rung when 'frozen' then kind when 'high' then 'high_risk_narration' when 'light' then 'light_edit_narration' else 'narrative' end as block_type,
  case rung when 'frozen' then 'do_not_touch' when 'high' then 'high_risk' when 'light' then 'light_edit' else 'rewritable' end as edit_policy,
  case rung when 'frozen' then 'do_not_touch' when 'high' then 'high_risk' when 'light' then 'light_edit' else 'developmental_rewrite' end as rewrite_depth,
  case rung when 'light' then 1 when 'open' then 2 else 0 end as min_sentence_changes, case rung when 'open' then 1 else 0 end as min_cluster_changes,
  len({sent('text')}) as n_sentences from p)"""
POLICY_COLS = ["n_citations", "n_numbers", "n_terms", "has_path", "meta_density", "template_density", "function_density", "stiff_density", "dense_nominal", "block_type", "edit_policy", "rewrite_depth", "min_sentence_changes", "min_cluster_changes"]


def with_policy(spark, sf_dir) -> DataFrame:
    return B.policy(corpus.blocks(spark, sf_dir)).withColumn("n_sentences", F.size(T.bracket_sentences(F.col("text"))))


@query(f"with {CORPUS}, {POLICY_SQL} select block_key, {', '.join(POLICY_COLS)} from pol")
def q_block_policy(spark, sf_dir):
    return B.policy(corpus.blocks(spark, sf_dir)).select("block_key", *POLICY_COLS)


SCALE_SQL = "case when {c} >= 15000 then 'very_long' when {c} >= 8000 then 'long' when {c} >= 3000 then 'medium' else 'short' end"


@query(f"""with {CORPUS}, {POLICY_SQL},
g as (select doc_id, bool_or(edit_policy = 'do_not_touch') as d, bool_or(edit_policy = 'high_risk') as h, bool_or(edit_policy = 'light_edit') as l, bool_or(edit_policy = 'rewritable') as r,
  count(*) filter (edit_policy in ('light_edit', 'rewritable')) as body_blocks,
  coalesce(sum(length(regexp_replace(text, '\\s', '', 'g'))) filter (edit_policy in ('light_edit', 'rewritable')), 0)::bigint as body_chars,
  coalesce(sum(n_sentences) filter (edit_policy in ('light_edit', 'rewritable')), 0)::bigint as body_sentences from pol group by doc_id)
select doc_id, case when (d or h) and (l or r) then 'mixed' when h then 'high_risk' when l then 'light_edit' when r then 'rewritable' else 'do_not_touch' end as risk,
  {SCALE_SQL.format(c='body_chars')} as scale, body_blocks, body_chars, body_sentences from g""")
def q_document_risk(spark, sf_dir):
    return B.document_risk(with_policy(spark, sf_dir))


@query(f"""with {CORPUS}, s as (select block_key, text, {sent('text')} as s from blocks)
select block_key, len(s) as n_sentences,
  coalesce(len(s) >= 3 and list_max(list_transform(s, lambda x: length(regexp_replace(x, '\\s', '', 'g')))) - list_min(list_transform(s, lambda x: length(regexp_replace(x, '\\s', '', 'g')))) <= 10, false) as flat_rhythm,
  regexp_matches(text, '{P.PARALLELISM}') or (len(s) >= 3 and len(list_distinct(list_transform(s[1:3], lambda x: x[1:5]))) = 1) as parallelism from s""")
def q_block_rhythm(spark, sf_dir):
    df = B.rhythm(corpus.blocks(spark, sf_dir).select("block_key", "text"), "text")
    return df.select("block_key", "n_sentences", F.coalesce("flat_rhythm", F.lit(False)).alias("flat_rhythm"), "parallelism")


# ---- chapters
FILL_SQL = f"""
h as (select *, regexp_matches(text, '{P.CHAPTER_HEADING}') as is_heading from blocks),
fill as (select *, cast(sum(cast(is_heading as int)) over (partition by doc_id order by block_id) as int) as chapter_id,
  coalesce(last_value(case when is_heading then trim(regexp_replace(text, '^\\s{{0,3}}#{{1,6}}\\s*', '')) end ignore nulls) over (partition by doc_id order by block_id), 'Inferred section') as chapter_title from h)"""


def _type_sql(title: str, text: str) -> str:
    t, x = f"lower(regexp_replace({title}, '\\s', '', 'g'))", f"lower(regexp_replace({text}, '\\s', '', 'g'))"
    rows = [f"when {any_of(t, w)} then '{k}'" for k, w in P.TITLE_WORDS] + [f"when {any_of(x, w)} then '{k}'" for k, w in P.CONTENT_WORDS]
    return "case " + " ".join(rows) + f" when {t} = '' then 'background' else 'method_design' end"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


TYPE_SQL = f"""
ty as (select *, {_type_sql('chapter_title', 'text')} as chapter_type, len({sent('text')}) as ns, {n_of('text', P.CITATION)} as nc, {n_of('text', P.NUMBER)} as nn, {n_of('text', P.TECH_TOKEN)} as nt,
  regexp_matches(text, '{P.CHAPTER_PATH}') or regexp_matches(text, '{P.CHAPTER_FORMULA}') as hard from fill),
lv as (select *, case when hard or (nc >= 2 and nn >= 2) or nn >= 4 or nt >= 6 or nc >= 3 then 'high' when nn >= 2 or nt >= 3 or nc >= 1 or (ns <= 1 and (nn > 0 or nt > 0)) then 'medium' else 'low' end as level from ty),
pr as (select *, case when chapter_type = 'error_analysis' and level = 'high' then 'medium' when chapter_type = 'deployment_description' and level <> 'low' then 'conservative'
  when chapter_type in {_in(P.CONSERVATIVE_TYPES)} then 'conservative' when chapter_type in {_in(P.HIGH_TYPES)} then 'high' when level = 'high' then 'conservative' else 'medium' end as chapter_priority from lv)"""


def chaptered(spark, sf_dir) -> DataFrame:
    df = chapters.fill(corpus.blocks(spark, sf_dir)).withColumn("chapter_type", chapters.chapter_type(F.col("chapter_title"), F.col("text")))
    df = df.withColumn("n_sentences", F.size(T.sentences(F.col("text"))))
    df = df.withColumn("level", chapters.technical_level(F.col("text"), F.col("n_sentences")))
    return df.withColumn("chapter_priority", chapters.priority(F.col("chapter_type"), F.col("level")))


@query(f"with {CORPUS}, {FILL_SQL} select block_key, is_heading, chapter_id, chapter_title from fill")
def q_chapter_fill(spark, sf_dir):
    return chapters.fill(corpus.blocks(spark, sf_dir)).select("block_key", "is_heading", "chapter_id", "chapter_title")


@query(f"with {CORPUS}, {FILL_SQL}, {TYPE_SQL} select block_key, chapter_type, level, chapter_priority from pr")
def q_chapter_types(spark, sf_dir):
    return chaptered(spark, sf_dir).select("block_key", "chapter_type", "level", "chapter_priority")


@query(f"""with {CORPUS}, {FILL_SQL}, {TYPE_SQL}
select doc_id, chapter_id, chapter_title, chapter_type, chapter_priority, case chapter_priority when 'high' then 'high' when 'conservative' then 'light' else 'medium' end as chapter_intensity
from pr qualify row_number() over (partition by doc_id, chapter_id, chapter_title order by block_id) = 1""")
def q_chapter_summary(spark, sf_dir):
    return chapters.summary(chaptered(spark, sf_dir))


METRICS_SQL = f"""
u as (select *, greatest(ns, 1) as tot, case when greatest(sentence_changes, cluster_changes) <= 0 and coverage > 0 then cast(round_even(coverage * greatest(ns, 1), 0) as int) else greatest(sentence_changes, cluster_changes) end as units,
  case when chapter_priority = 'high' and cluster_changes <= 0 and sentence_changes >= 2 and discourse_score >= 2 then 1 else cluster_changes end as clu,
  regexp_matches(text, '(?i)(图|表|系统|界面|数据库|接口|路径|版本|checkpoint|阈值|字段|E-R)') as tech from pr),
g as (select doc_id, chapter_id, chapter_title, arg_min(chapter_type, block_id) as chapter_type, arg_min(chapter_priority, block_id) as chapter_priority, count(*) as blocks, sum(tot)::bigint as sentences,
  count(*) filter (changed) as changed_blocks, sum(case when changed then least(tot, greatest(1, units)) else 0 end)::bigint as changed_sentences, sum(case when changed then discourse_score else 0 end)::bigint as discourse,
  sum(case when changed then clu else 0 end)::bigint as cluster, bool_or(changed and chapter_priority = 'conservative' and heavy) as over_rewritten, count(*) filter (sensitive) as sb, count(*) filter (tech) as tb
  from u group by all),
q as (select *, changed_sentences / greatest(sentences, 1) as chapter_coverage, changed_blocks / blocks as changed_ratio,
  case when chapter_priority = 'high' and sentences < 2 then 'short' when chapter_priority = 'high' and blocks <= 4 and sentences <= 12 then 'small' when chapter_priority = 'high' and sb / blocks >= 0.5 then 'sensitive'
   when chapter_priority = 'medium' and (blocks <= 2 or tb / blocks >= 0.5) and (blocks <= 1 or sentences <= 2) then 'tiny' when chapter_priority = 'medium' and (blocks <= 2 or tb / blocks >= 0.5) and blocks <= 2 and changed_blocks >= 1 then 'pair'
   when chapter_priority = 'medium' and (blocks <= 2 or tb / blocks >= 0.5) and sentences <= 5 and changed_sentences >= 1 then 'few' when chapter_priority = 'medium' and (blocks <= 2 or tb / blocks >= 0.5) then 'mixed'
   when chapter_priority = 'medium' and chapter_type in {_in(P.TECHNICAL_MEDIUM_TYPES)} then 'technical' else 'usual' end as quota_case from g),
n as (select *, case when quota_case = 'tiny' then 0.0 when quota_case in ('small', 'technical') then 0.3 when quota_case = 'pair' then 0.25 when quota_case = 'few' then 0.2 when quota_case = 'sensitive' then 0.5 else 9 end as cap1,
  case when quota_case = 'tiny' then 0.0 when quota_case in ('small', 'pair') then 0.25 when quota_case = 'few' then 0.2 else 9 end as cap2,
  case when chapter_priority = 'high' then 0.6 when chapter_priority = 'medium' then 0.4 else 0 end as c1, case when chapter_priority = 'high' then 0.5 when chapter_priority = 'medium' then 0.25 else 0 end as c2,
  case when quota_case in ('tiny', 'pair', 'few') then 0 when chapter_priority = 'high' then 2 when chapter_priority = 'medium' then 1 else 0 end as c3,
  case when quota_case in ('tiny', 'pair', 'few', 'short') then 0 when chapter_priority = 'high' then 1 else 0 end as c4 from q),
r as (select *, list_filter([
  case when chapter_priority = 'high' and chapter_coverage < least(c1, cap1) then 'high_priority_chapter_coverage_below_quota' end,
  case when chapter_priority = 'high' and changed_ratio < least(c2, cap2) then 'high_priority_chapter_changed_blocks_below_quota' end,
  case when chapter_priority = 'high' and discourse < c3 then 'high_priority_chapter_discourse_below_quota' end, case when chapter_priority = 'high' and cluster < c4 then 'high_priority_chapter_cluster_below_quota' end,
  case when chapter_priority = 'medium' and chapter_coverage < least(c1, cap1) then 'medium_priority_chapter_coverage_below_quota' end,
  case when chapter_priority = 'medium' and changed_ratio < least(c2, cap2) then 'medium_priority_chapter_changed_blocks_below_quota' end,
  case when chapter_priority = 'medium' and discourse < c3 and cluster <= 0 then 'medium_priority_chapter_sentence_or_cluster_change_missing' end,
  case when chapter_priority = 'conservative' and over_rewritten then 'conservative_chapter_over_rewritten' end], lambda x: x is not null) as rs from n)"""


@query(f"""with {CORPUS}, {FILL_SQL}, {TYPE_SQL}, {METRICS_SQL}
select doc_id, chapter_id, chapter_title, chapter_type, chapter_priority, blocks, sentences, changed_blocks, changed_sentences, discourse, cluster, over_rewritten, quota_case,
  coalesce(list_aggregate(rs, 'string_agg', ','), '') as reasons, len(rs) = 0 as quota_met from r""")
def q_chapter_metrics(spark, sf_dir):
    m = chapters.metrics(chaptered(spark, sf_dir))
    cols = ["doc_id", "chapter_id", "chapter_title", "chapter_type", "chapter_priority", "blocks", "sentences", "changed_blocks", "changed_sentences", "discourse", "cluster", "over_rewritten", "quota_case"]
    return m.select(*cols, F.array_join("reasons", ",").alias("reasons"), "quota_met")


@query(f"""with {CORPUS}, {FILL_SQL}, {TYPE_SQL}, {METRICS_SQL}
select doc_id, coalesce(string_agg('chapter_' || chapter_id || '_' || x, ',' order by chapter_id, i), '') as codes
from (select doc_id, chapter_id, unnest(rs) as x, unnest(range(len(rs))) as i from r) group by doc_id""")
def q_chapter_reasons(spark, sf_dir):
    return chapters.reason_codes(chapters.metrics(chaptered(spark, sf_dir)).where("size(reasons) > 0")).select("doc_id", F.array_join("codes", ",").alias("codes"))


@query(f"""with {CORPUS}, {POLICY_SQL}, b as (select *, greatest(n_sentences, 1) as tot from pol where edit_policy in ('light_edit', 'rewritable')),
g as (select doc_id, count(*) as blocks, sum(tot)::bigint as sentences, sum(length(regexp_replace(text, '\\s', '', 'g')))::bigint as chars, count(*) filter (changed) as changed_blocks,
  sum(case when changed then least(tot, greatest(1, sentence_changes, cluster_changes)) else 0 end)::bigint as changed_sentences, sum(case when changed then discourse_score else 0 end)::bigint as discourse,
  sum(case when changed then cluster_changes else 0 end)::bigint as cluster from b group by doc_id),
s as (select *, {SCALE_SQL.format(c='chars')} as scale from g),
n as (select *, changed_sentences / sentences as cov, changed_blocks / blocks as ratio, case scale when 'short' then 0.4 when 'medium' then 0.5 else 0.6 end as n1,
  case scale when 'short' then 0 when 'medium' then 0.3 when 'long' then 0.45 else 0.5 end as n2, case scale when 'short' then 2 when 'medium' then 3 else 5 end as n3,
  case when sentences < 2 or scale = 'short' then 0 when scale = 'medium' then 1 else 2 end as n4 from s)
select doc_id, blocks, sentences, chars, changed_blocks, changed_sentences, discourse, cluster, scale, cov >= n1 and ratio >= n2 and discourse >= n3 and cluster >= n4 as quota_met from n""")
def q_body_metrics(spark, sf_dir):
    body = with_policy(spark, sf_dir).where(F.col("edit_policy").isin("light_edit", "rewritable")).withColumn("n_chars", F.length(T.squeeze(F.col("text"))))
    cols = ["doc_id", "blocks", "sentences", "chars", "changed_blocks", "changed_sentences", "discourse", "cluster", "scale", "quota_met"]
    return ranking.body_metrics(body).select(*cols)


# ---- integrity of revisions
def _set_kept(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda x: not list_contains({b}, x))) = 0"


NUMS = "list_transform(regexp_extract_all({t}, '" + P.NUMBER + "'), lambda x: " + PLAIN_NUMBER + ")"
CAPTIONS = "list_distinct(list_transform(regexp_extract_all({t}, '(?m)^\\s*(图|表)\\s*\\d+(-\\d+)?[^\\n]*$') || regexp_extract_all({t}, '" + P.CAPTION_FRAGMENT + "'), lambda x: regexp_replace(x, '\\s', '', 'g')))"


@query(f"with {CORPUS} select block_key, {_set_kept(NUMS.format(t='text'), NUMS.format(t='revised'))} as numeric_kept, {n_of('text', P.NUMBER)} as n_before, {n_of('revised', P.NUMBER)} as n_after from blocks")
def q_integrity_numbers(spark, sf_dir):
    t, r = F.col("text"), F.col("revised")
    return corpus.blocks(spark, sf_dir).select(
        "block_key", integrity.checks(t, r)["numeric"].alias("numeric_kept"), F.regexp_count(t, F.lit(P.NUMBER)).alias("n_before"), F.regexp_count(r, F.lit(P.NUMBER)).alias("n_after")
    )


@query(f"with {CORPUS} select block_key, {_set_kept(_terms_sql('text'), _terms_sql('revised'))} as terms_kept from blocks")
def q_integrity_terms(spark, sf_dir):
    return corpus.blocks(spark, sf_dir).select("block_key", integrity.checks(F.col("text"), F.col("revised"))["terminology"].alias("terms_kept"))


@query(f"""with {CORPUS} select block_key, regexp_extract_all(text, '(?m)^\\s{{0,3}}#{{1,6}}\\s+.*$') = regexp_extract_all(revised, '(?m)^\\s{{0,3}}#{{1,6}}\\s+.*$') as title,
 regexp_extract_all(text, '{P.CITATION}') = regexp_extract_all(revised, '{P.CITATION}') as citation, {_set_kept(_terms_sql('text'), _terms_sql('revised'))} as terminology,
 {_set_kept(NUMS.format(t='text'), NUMS.format(t='revised'))} as numeric,
 list_sort({CAPTIONS.format(t='text')}) = list_sort({CAPTIONS.format(t='revised')}) and len(list_filter({CAPTIONS.format(t='revised')}, lambda x: contains(x, '：。'))) = 0 as caption_punctuation,
 true as linebreak_whitespace from blocks""")
def q_integrity_all(spark, sf_dir):
    c = integrity.checks(F.col("text"), F.col("revised"))
    return corpus.blocks(spark, sf_dir).select("block_key", *[c[k].alias(k) for k in ("title", "citation", "terminology", "numeric", "caption_punctuation", "linebreak_whitespace")])


@query("""with m as (select doc_id, text, regexp_replace(text, '[0-9]+', '') || ' ' as changed_text from documents)
select doc_id, len(list_filter(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?%?'), lambda x: not list_contains(regexp_extract_all(changed_text, '[0-9]+(?:\\.[0-9]+)?%?'), x))) = 0 as numeric,
  len(regexp_extract_all(changed_text, '(?m)[ \\t]+$')) <= len(regexp_extract_all(text, '(?m)[ \\t]+$')) as spaces from m""".replace("regexp_replace(text, '[0-9]+', '')", "regexp_replace(text, '[0-9]+', '', 'g')"))
def q_integrity_mutations(spark, sf_dir):
    r = F.concat(F.regexp_replace("text", "[0-9]+", ""), F.lit(" "))
    df = documents(spark, sf_dir).select("doc_id", "text", r.alias("r"))
    return df.select("doc_id", integrity.checks(F.col("text"), F.col("r"))["numeric"].alias("numeric"), (integrity.trailing(F.col("r")) <= integrity.trailing(F.col("text"))).alias("spaces"))


@query(f"""with {CORPUS} select block_key,
 len(list_distinct(list_filter(regexp_extract_all(revised, '[0-9]+(?:\\.[0-9]+)?%'), lambda x: not list_contains(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?%'), x)))) as new_percentages,
 len(list_distinct(list_filter(regexp_extract_all(revised, '20[0-9]{{2}}年'), lambda x: not list_contains(regexp_extract_all(text, '20[0-9]{{2}}年'), x)))) as new_years,
 len(list_distinct(list_filter({_terms_sql('text')}, lambda x: not list_contains({_terms_sql('revised')}, x)))) as lost_terms from blocks""")
def q_drift(spark, sf_dir):
    return corpus.blocks(spark, sf_dir).select("block_key", integrity.drift(F.col("text"), F.col("revised")).alias("d")).select("block_key", "d.*")


@query("select doc_id, coalesce(list_aggregate(list_transform(regexp_extract_all(list_aggregate(list_transform(string_split(text, chr(10)), lambda x: case when trim(x, ' ' || chr(9)) = '' then 'b' else 'x' end), 'string_agg', ''), 'b+'), lambda x: length(x)), 'string_agg', ','), '') as runs from (select doc_id, text || chr(10) || chr(10) || 'end' as text from documents)")
def q_blank_signature(spark, sf_dir):
    t = F.concat("text", F.lit("\n\nend"))
    return documents(spark, sf_dir).select("doc_id", F.array_join(integrity.blank_runs(t).cast("array<string>"), ",").alias("runs"))


@query()
def q_mask_roundtrip(spark, sf_dir):
    df = corpus.blocks(spark, sf_dir).select("block_key", "text", mask.mask(F.col("text")).alias("m"))
    return df.select("block_key", F.size("m.kept").alias("n_kept"), (mask.restore(F.col("m.text"), F.col("m.kept")) == F.col("text")).alias("restored"))


# ---- change scores
BARE = "regexp_replace(regexp_replace({x}, '[。！？?!]+$', ''), '\\s', '', 'g')"
HEAD = "case when starts_with({y}, '本研究') then '本研究' when starts_with({y}, '本文') then '本文' when starts_with({y}, '该研究') then '该研究' when starts_with({y}, '该系统') then '该系统' else '' end"


def _opener_sql(x: str) -> str:
    b = BARE.format(x=x)
    return "case " + " ".join(f"when starts_with({b}, '{m}') then '{m}'" for m in P.STIFF_OPENERS) + f" else substr({b}, 1, 4) end"


@query(f"""with {CORPUS}, s as (select block_key, unnest(ss) as x, unnest(range(len(ss))) as i from (select block_key, {sent('text')} as ss from blocks)),
h as (select *, {HEAD.format(y="regexp_replace(x, '" + P.IMPLICATION_OPENER + "', '')")} as head from s),
r as (select *, i - row_number() over (partition by block_key, head order by i) as grp from h),
k as (select block_key, max(case when head = '' then 0 else c end) as streak from (select block_key, head, grp, count(*) as c from r group by block_key, head, grp) group by block_key),
o as (select block_key, max(c) as repeated from (select block_key, {_opener_sql('x')} as o, count(*) as c from s group by 1, 2) where o <> '' group by block_key),
m as (select block_key, count(*) as implications from s where regexp_matches(x, '{P.IMPLICATION_OPENER}') group by block_key)
select b.block_key, coalesce(streak, 0) as streak, coalesce(repeated, 0) as repeated, coalesce(implications, 0) as implications
from blocks b left join k using (block_key) left join o using (block_key) left join m using (block_key)""")
def q_subject_streak(spark, sf_dir):
    df = corpus.blocks(spark, sf_dir).select("block_key", T.sentences(F.col("text")).alias("s"))
    return df.select(
        "block_key", changes.streak(changes.subject_heads(F.col("s"))).alias("streak"), changes.repeated_openers(F.col("s")).alias("repeated"),
        changes.implication_openers(F.col("s")).alias("implications"),
    )


@query(f"""with {CORPUS}, s as (select block_key, {sent('text')} as a, {sent('revised')} as b from blocks)
select block_key, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: {BARE.format(x='a[i]')} <> {BARE.format(x='b[i]')})) + abs(len(a) - len(b)) as changed, len(a) as n_before, len(b) as n_after from s""")
def q_positional_changes(spark, sf_dir):
    df = corpus.blocks(spark, sf_dir).select("block_key", T.sentences(F.col("text")).alias("a"), T.sentences(F.col("revised")).alias("b"))
    return df.select("block_key", changes.positional_changes(F.col("a"), F.col("b")).alias("changed"), F.size("a").alias("n_before"), F.size("b").alias("n_after"))


@query()
def q_diff(spark, sf_dir):
    df = corpus.blocks(spark, sf_dir).select("block_key", "text", "revised", T.sentences(F.col("text")).alias("a"), T.sentences(F.col("revised")).alias("b"))
    bare = [F.transform(c, changes.bare) for c in ("a", "b")]
    df = df.withColumn("changed", changes.changed_sentences(*bare)).withColumn("d", changes.text_difference("text", "revised"))
    return df.select(
        "block_key", "changed", changes.discourse_score(F.col("a"), F.col("b"), F.col("changed")).alias("discourse"), changes.cluster_score(F.col("a"), F.col("b")).alias("cluster"),
        changes.prefix_only(F.col("a"), F.col("b")).alias("prefix_only"), "d.chars", "d.spans", F.round("d.ratio", 4).alias("ratio"),
    )


# ---- signals
def _dangling_re2() -> str:
    return P.DANGLING.replace("并(?=提出|形成|实现|说明|表明|进一步|完成|用于)", "并(?:提出|形成|实现|说明|表明|进一步|完成|用于)")


def _subject_sql(x: str) -> str:
    t = f"regexp_replace(regexp_replace(trim({x}), '{P.IMPLICATION}', ''), '{P.ORDINAL}', '')"
    head = f"regexp_extract({t}, '^[^，,：:；;]*')"
    return f"(regexp_matches({t}, '{P.SUBJECT}') or regexp_matches({t}, '^基于.{{2,40}}的方法[。！？?!]?$') or (length({head}) between 2 and 18 and regexp_matches({head}, '{P.NOMINAL_HEAD}')))"


def _clause_sql(x: str) -> str:
    t = f"regexp_replace(trim({x}), '{P.ORDINAL}', '')"
    return f"({t} <> '' and {_subject_sql(t)} and regexp_matches({t}, '{P.PREDICATE}'))"


def _frag_sql(x: str) -> str:
    return "(" + " or ".join(f"regexp_matches({x}, '{p}')" for p in (P.COMPARISON, P.PREPOSITION, P.COLON_TAIL, P.RESULT_LEAD, P.VERB_OPEN)) + f" or (regexp_matches({x}, '{P.CAUSATIVE}') and not {_subject_sql(x)}))"


TECH_RE2 = r"[A-Za-z][A-Za-z0-9_.\-/]{2,}|[\w.-]+\.(?:pth|pt|ckpt)|\[\d+\]"
READ_SQL = f"""
s as (select block_key, unnest(ss) as x, unnest(range(len(ss))) as i, len(ss) as n from (select block_key, {sent('text')} as ss from blocks)),
a as (select *, regexp_matches(x, '{P.LIST_LEAD}') or regexp_matches(x, '^基于.{{2,40}}的方法[。！？?!]?$') as lead_, len(regexp_extract_all(x, '{TECH_RE2}')) >= 3 as tech, {_subject_sql('x')} as subj,
  regexp_matches(x, '{P.PREDICATE}') as pred, length(regexp_replace(x, '\\s', '', 'g')) as size, case when i = 0 then 'topic_sentence' when i = n - 1 then 'conclusion_sentence' else 'support_sentence' end as role from s),
b as (select *, case when lead_ then false when regexp_matches(x, '{_dangling_re2()}') then not ({starts('x', P.DANGLING_EXEMPT)} and {_clause_sql("regexp_replace(x, '" + _dangling_re2() + "', '')")}) when tech then false else {_frag_sql('x')} end as dangling from a),
c as (select *, case when regexp_matches(x, '{P.IMPLICATION}') and {_clause_sql("regexp_replace(x, '" + P.IMPLICATION + "', '')")} then 82 when regexp_matches(x, '{P.LIST_LEAD}') then 88 when lead_ then 84 when tech then 84 when dangling then 36
  when regexp_matches(x, '{P.COMPARISON}') then 34 when regexp_matches(x, '{P.PREPOSITION}') then 42 when regexp_matches(x, '{P.COLON_TAIL}') then 46 when regexp_matches(x, '{P.RESULT_LEAD}') then 44 when regexp_matches(x, '{P.VERB_OPEN}') then 50
  when regexp_matches(x, '{P.CAUSATIVE}') and not subj then 42 when regexp_matches(x, '{P.ESPECIALLY}') then 58 when not pred and size < 18 then 48 when not pred then 58
  when not subj and role in ('support_sentence', 'conclusion_sentence') and size < 22 then 62 when {starts('x', ('而', '并', '从而', '进而'))} and not subj then 52 when subj then 90 else 78 end as score from b)"""


@query(f"with {CORPUS}, {READ_SQL} select block_key, i as sent_idx, role, score, dangling from c")
def q_readability(spark, sf_dir):
    df = corpus.blocks(spark, sf_dir).select("block_key", F.posexplode(readability.per_sentence(T.sentences(F.col("text")))).alias("i", "r"))
    return df.select("block_key", F.col("i").cast("long").alias("sent_idx"), "r.role", F.round(F.col("r.score") * 100).cast("int").alias("score"), "r.dangling")


@query()
def q_paragraph_readability(spark, sf_dir):
    df = corpus.blocks(spark, sf_dir).select("block_key", "sensitive", readability.per_sentence(T.sentences(F.col("text"))).alias("rows"))
    return df.select("block_key", readability.paragraph(F.col("rows"), F.col("sensitive")).alias("p")).select("block_key", "p.*")


def _hits_sql(t: str, patterns) -> str:
    return "(" + " + ".join(n_of(t, p) for p in patterns) + ")"


@query(f"""with {CORPUS} select block_key, greatest(0, {_hits_sql('revised', [p.replace(chr(92) + 'b20', '20') for p in P.UNSUPPORTED])} - {_hits_sql('text', [p.replace(chr(92) + 'b20', '20') for p in P.UNSUPPORTED])}) as unsupported,
  greatest(0, {_hits_sql('revised', P.METAPHOR)} - {_hits_sql('text', P.METAPHOR)}) as metaphor, greatest(0, {_hits_sql('revised', P.COMMENTARY)} - {_hits_sql('text', P.COMMENTARY)}) as commentary,
  len(list_filter({sent('revised')}, lambda x: regexp_matches(x, '{P.REGISTER[0]}') or regexp_matches(x, '{P.REGISTER[1]}'))) as academic from blocks""")
def q_evidence_counts(spark, sf_dir):
    df = corpus.blocks(spark, sf_dir).select("block_key", T.sentences(F.col("text")).alias("a"), T.sentences(F.col("revised")).alias("b"))

    def added(p):
        return F.greatest(F.lit(0), signals.hits(F.col("b"), p) - signals.hits(F.col("a"), p))

    return df.select("block_key", added(P.UNSUPPORTED).alias("unsupported"), added(P.METAPHOR).alias("metaphor"), added(P.COMMENTARY).alias("commentary"), signals.holding(F.col("b"), *P.REGISTER).alias("academic"))


def _sentence_pairs(spark, sf_dir) -> DataFrame:
    """Blocks with their sentences, split once: a of the text, b of the revision."""
    return corpus.blocks(spark, sf_dir).withColumns({"a": T.sentences(F.col("text")), "b": T.sentences(F.col("revised"))})


@query()
def q_evidence(spark, sf_dir):
    df = _sentence_pairs(spark, sf_dir).select("block_key", signals.evidence(F.col("a"), F.col("b"), F.col("sensitive")).alias("e"))
    return df.select("block_key", "e.*")


def _holding_sql(p: str) -> str:
    return f"len(list_filter(s, lambda x: regexp_matches(x, '{p}')))"


@query(f"""with {CORPUS}, q as (select block_key, {sent('text')} as s from blocks)
select block_key, {_holding_sql(P.BUREAUCRATIC)} as bureaucratic, {_holding_sql(P.SLOGAN)} as slogan, {_holding_sql(P.OVERSTRUCTURED)} as overstructured, {_holding_sql(P.WRAPPER)} as wrapper,
  coalesce(list_sum(list_transform(s, lambda x: {n_of('x', P.CONNECTOR)})), 0)::int as connectors, coalesce(list_sum(list_transform(s, lambda x: {n_of('x', P.NOMINALIZATION)})), 0)::int as nominals,
  len(list_filter(range(1, len(s)), lambda i: regexp_extract(s[i], '{P.EXPLICIT_SUBJECT}', 1) <> '' and regexp_extract(s[i], '{P.EXPLICIT_SUBJECT}', 1) = regexp_extract(s[i + 1], '{P.EXPLICIT_SUBJECT}', 1))) as repeats from q""")
def q_naturalization_counts(spark, sf_dir):
    s = F.col("s")
    df = corpus.blocks(spark, sf_dir).select("block_key", T.sentences(F.col("text")).alias("s"))
    return df.select(
        "block_key", signals.holding(s, P.BUREAUCRATIC).alias("bureaucratic"), signals.holding(s, P.SLOGAN).alias("slogan"), signals.holding(s, P.OVERSTRUCTURED).alias("overstructured"),
        signals.holding(s, P.WRAPPER).alias("wrapper"), signals.hits(s, (P.CONNECTOR,)).alias("connectors"), signals.hits(s, (P.NOMINALIZATION,)).alias("nominals"), signals.subject_repeats(s).alias("repeats"),
    )


@query()
def q_naturalization(spark, sf_dir):
    return _sentence_pairs(spark, sf_dir).select("block_key", signals.directness(F.col("a")).alias("d")).select("block_key", "d.*")


@query(f"with {CORPUS} select block_key, {n_of('text', P.L2_FUNCTION)} as function_words, {n_of('text', P.L2_TEXTURE)} as texture, {n_of('text', P.L2_NATIVE)} as native, {n_of('text', P.L2_COLLOQUIAL)} as colloquial, {n_of('text', P.L2_UNGRAMMATICAL)} as ungrammatical from blocks")
def q_l2_counts(spark, sf_dir):
    t = F.col("text")
    return corpus.blocks(spark, sf_dir).select(
        "block_key", T.count(t, P.L2_FUNCTION).alias("function_words"), T.count(t, P.L2_TEXTURE).alias("texture"), T.count(t, P.L2_NATIVE).alias("native"),
        T.count(t, P.L2_COLLOQUIAL).alias("colloquial"), T.count(t, P.L2_UNGRAMMATICAL).alias("ungrammatical"),
    )


@query()
def q_l2(spark, sf_dir):
    return _sentence_pairs(spark, sf_dir).select("block_key", signals.texture(F.col("a")).alias("t")).select("block_key", "t.*")


@query(f"""with {CORPUS}, {FILL_SQL}, {TYPE_SQL}, s as (select doc_id, chapter_type, text, {sent('text')} as s from pr)
select doc_id, chapter_type, sum(len(s))::bigint as sentences, sum(length(regexp_replace(text, '\\s', '', 'g')))::bigint as chars, sum({n_of('text', '[，,；;]')})::bigint as clauses, sum({n_of('text', P.L2_FUNCTION)})::bigint as function_words from s group by all""")
def q_style_by_class(spark, sf_dir):
    t = F.col("text")
    return chaptered(spark, sf_dir).groupBy("doc_id", "chapter_type").agg(
        F.sum(F.size(T.sentences(t))).alias("sentences"), F.sum(F.length(T.squeeze(t))).alias("chars"), F.sum(T.count(t, "[，,；;]")).alias("clauses"), F.sum(T.count(t, P.L2_FUNCTION)).alias("function_words")
    )


def _exploded(spark, sf_dir, column: str = "text") -> DataFrame:
    """(block_key, sensitive, i, n, x) of the corpus' sentences."""
    df = corpus.blocks(spark, sf_dir).select("block_key", T.sentences(F.col(column)).alias("s"))
    return df.select("block_key", F.size("s").alias("n"), F.posexplode("s").alias("i", "x"))


SENTS_SQL = "s as (select block_key, unnest(ss) as x, unnest(range(len(ss))) as i, len(ss) as n from (select block_key, {} as ss from blocks))"


def _m(x: str, p: str) -> str:
    return f"regexp_matches({x}, '{p}')"


@query(f"""with {CORPUS}, {SENTS_SQL.format(sent('text'))}
select block_key, i as sent_idx, case when {_m('x', families.ENUM_ITEM)} or {_m('x', families.ENUM_HEAD)} then 'enumeration' when {_m('x', families.CONCLUSION_HEAD)} then 'conclusion' when i = n - 1 and {_m('x', families.CLOSING)} then 'conclusion'
  when i = 0 and {_m('x', families.CORE_OPENING)} then 'core' when {_m('x', families.MECHANISM)} and {_m('x', families.MECHANISM_VERB)} then 'mechanism' else 'support' end as role from s""")
def q_semantic_roles(spark, sf_dir):
    df = _exploded(spark, sf_dir)
    return df.select("block_key", F.col("i").cast("long").alias("sent_idx"), families.semantic_role(F.col("x"), F.col("i"), F.col("n")).alias("role"))


@query()
def q_semantic_integrity(spark, sf_dir):
    df = _sentence_pairs(spark, sf_dir).select("block_key", families.semantics(F.col("a"), F.col("b"), F.col("sensitive")).alias("e"))
    return df.select("block_key", "e.*")


@query(f"""with {CORPUS}, {SENTS_SQL.format(sent('revised'))},
r as (select *, case when i = 0 and {_m('x', families.CORE_OPENING)} then 'core' when i = n - 1 and ({_m('x', families.CONCLUSION_MARK)} or {_m('x', families.STANCE)}) then 'conclusion'
  when {_m('x', families.MECHANISM + '|噪声分支')} and {_m('x', families.AUTHOR_MECHANISM_VERB)} then 'mechanism' else 'support' end as role, {_m('x', families.CONCRETE)} as concrete, {_m('x', families.STRONG_VERB)} as strong, {_m('x', families.STANCE)} as stance from s)
select block_key, i as sent_idx, role, not (role = 'mechanism' and concrete and strong) and ({_m('x', families.APPENDIX_LEAD)} or {_m('x', families.USED_FOR)} or {_m('x', families.BY_MEANS)} or {_m('x', families.WEAK_MAIN)}) as appendix,
  case when len(regexp_extract_all(x, '{TECH_RE2}')) >= 3 then 74 when not (role = 'mechanism' and concrete and strong) and ({_m('x', families.APPENDIX_LEAD)} or {_m('x', families.USED_FOR)} or {_m('x', families.BY_MEANS)} or {_m('x', families.WEAK_MAIN)}) then 28
  else least(100, 62 + (case when concrete then 16 else 0 end) + (case when strong then 14 else 0 end) + (case when stance then 18 else 0 end) + (case when role = 'mechanism' and concrete and strong then 10 else 0 end)
   + (case when role in ('core', 'conclusion') and stance then 8 else 0 end) - (case when {_m('x', families.WEAK_MAIN)} then 18 when {_m('x', families.WEAK_MODAL)} then 8 else 0 end)) end as assertion from r""")
def q_authorial_sentences(spark, sf_dir):
    df = _exploded(spark, sf_dir, "revised")
    x, i, n = F.col("x"), F.col("i"), F.col("n")
    role = families.author_role(x, i, n)
    return df.select(
        "block_key", i.cast("long").alias("sent_idx"), role.alias("role"), families.appendix_like(x, role).alias("appendix"), F.round(families.assertion(x, i, n) * 100).cast("int").alias("assertion")
    )


@query()
def q_authorial(spark, sf_dir):
    df = _sentence_pairs(spark, sf_dir).select("block_key", families.authorship(F.col("a"), F.col("b"), F.col("sensitive")).alias("e"))
    return df.select("block_key", "e.*")


CLICHE_SQL = " + ".join(f"cast({_m('x', p)} as int)" for p in families.CLICHES)


@query(f"""with {CORPUS}, {SENTS_SQL.format(sent('text'))}
select block_key, i as sent_idx, {CLICHE_SQL} as cliches, case when i = 0 then 'topic' when i = n - 1 then 'conclusion' when {_m('x', families.SUPPLEMENT_LEAD)} or length(regexp_replace(x, '\\s', '', 'g')) < 22 then 'supplement'
  when {CLICHE_SQL} > 0 then 'cliche' when {_m('x', families.JUDGMENT)} then 'judgment' when {_m('x', families.EXPLAINING)} or {_m('x', '[，；：]')} then 'explanatory' else 'plain' end as texture from s""")
def q_support_textures(spark, sf_dir):
    x = F.col("x")
    return _exploded(spark, sf_dir).select("block_key", F.col("i").cast("long").alias("sent_idx"), families.cliches(x).alias("cliches"), families.support_texture(x, F.col("i"), F.col("n")).alias("texture"))


@query()
def q_realism(spark, sf_dir):
    return _sentence_pairs(spark, sf_dir).select("block_key", families.realism(F.col("a")).alias("e")).select("block_key", "e.*")


SKELETON_TOPIC = "(" + " or ".join([f"({_m('t', families.TOPIC_OPENING)} and {_m('t', families.TOPIC_FUNCTION)})", *[_m("t", p) for p in families.TOPIC_FORMS]]) + ")"


@query(f"""with {CORPUS}, {SENTS_SQL.format(sent('text'))}, b as (select *, regexp_replace(x, '[。！？?!；;]+$', '') as t from s), d as (select *, not {_m('t', families.NOT_DANGLING)} and {_m('t', families.DANGLING_OPENING)} as dang from b)
select block_key, i as sent_idx, case when t = '' then 'support_sentence' when {_m('t', families.TOPIC_FORMS[4])} or (not dang and {SKELETON_TOPIC}) then 'topic_sentence' when {_m('t', families.SKELETON_CONCLUSION)} then 'conclusion_sentence'
  when {_m('t', families.DANGLING_OPENING)} or {_m('t', families.SKELETON_SUPPLEMENT)} then 'transition_sentence' when {_m('t', families.EVIDENCE)} or {n_of('t', P.NUMBER)} >= 2 then 'evidence_sentence'
  when i = 0 and length(t) >= 18 and {_m('t', families.TOPIC_FUNCTION)} then 'topic_sentence' else 'support_sentence' end as role from d""")
def q_skeleton_roles(spark, sf_dir):
    return _exploded(spark, sf_dir).select("block_key", F.col("i").cast("long").alias("sent_idx"), families.skeleton_role(F.col("x"), F.col("i")).alias("role"))


@query()
def q_skeleton(spark, sf_dir):
    df = _sentence_pairs(spark, sf_dir).select("block_key", families.skeleton(F.col("a")).alias("a"), families.skeleton(F.col("b")).alias("b"))
    kept = ~F.col("a.opening_locked") | F.col("b.opening_locked")
    return df.select("block_key", F.array_join("a.roles", ",").alias("roles"), "a.opening_locked", "a.dangling", kept.alias("topic_kept"))


@query(f"""with {CORPUS}, q as (select block_key, {sent('text')} as s, regexp_replace(text, '\\s', '', 'g') as t from blocks), j as (select *, coalesce(list_aggregate(s, 'string_agg', ''), '') as x from q)
select block_key, len(s) as sentences, length(regexp_replace(x, '\\s', '', 'g')) as chars, {n_of('x', '[，,；;：:]')} as clauses, {n_of('x', families.STYLE_FUNCTION)} as function_words, {n_of('x', families.STYLE_HELPER)} as helpers,
  {_holding_sql(families.STYLE_EXPLAIN)} as explanatory, {n_of('x', families.STYLE_COMPACT)} as compact, {n_of('x', families.STYLE_TEXTURE)} as texture from j""")
def q_style_counts(spark, sf_dir):
    x = F.col("x")
    df = corpus.blocks(spark, sf_dir).select("block_key", T.sentences(F.col("text")).alias("s")).withColumn("x", F.array_join("s", ""))
    return df.select(
        "block_key", F.size("s").alias("sentences"), F.length(T.squeeze(x)).alias("chars"), T.count(x, "[，,；;：:]").alias("clauses"), T.count(x, families.STYLE_FUNCTION).alias("function_words"),
        T.count(x, families.STYLE_HELPER).alias("helpers"), signals.holding(F.col("s"), families.STYLE_EXPLAIN).alias("explanatory"), T.count(x, families.STYLE_COMPACT).alias("compact"), T.count(x, families.STYLE_TEXTURE).alias("texture"),
    )


@query()
def q_style_match(spark, sf_dir):
    """How well revised blocks match their source's distribution of style, by class of paragraph."""
    df = chapters.fill(_sentence_pairs(spark, sf_dir))
    df = df.select("doc_id", families.style_class(F.col("text"), F.col("chapter_title")).alias("class"), families.distribution(F.col("a")).alias("a"), families.distribution(F.col("b")).alias("b"))
    g = df.groupBy("doc_id", "class").agg(F.avg(families.style_match(F.col("a"), F.col("b"))).alias("match"), F.count(F.lit(1)).alias("paragraphs"))
    return ranking.worst_classes(g.withColumn("match", F.round("match", 4)))


# ---- review, gate, candidates
REVIEW_SQL = f"""
c as (select block_key, doc_id, block_id, {_set_kept(NUMS.format(t='text'), NUMS.format(t='revised'))} as num, {_set_kept(_terms_sql('text'), _terms_sql('revised'))} as ter, regexp_extract_all(text, '{P.CITATION}') = regexp_extract_all(revised, '{P.CITATION}') as cit,
  text = revised as same, {n_of('revised', '；')} > {n_of('text', '；')} as more_semicolons from blocks),
v as (select *, case when not num or not ter or not cit then 'reject' when more_semicolons then 'pass_with_minor_risk' else 'pass' end as decision from c)"""


def _reviewed(spark, sf_dir) -> DataFrame:
    t, r = F.col("text"), F.col("revised")
    checks = integrity.checks(t, r)
    problems = ranking.failed({k: checks[k] for k in ("numeric", "terminology", "citation")})
    warnings = F.array_compact(F.array(F.when(~integrity.review_counts(t, r)["no_new_semicolons"], "new_semicolons")))
    df = corpus.blocks(spark, sf_dir).withColumns({"problems": problems, "warnings": warnings})
    return df.withColumn("decision", ranking.decision(F.col("problems"), F.col("warnings")))


@query(f"with {CORPUS}, {REVIEW_SQL} select block_key, decision, (case when num then 0 else 1 end) + (case when ter then 0 else 1 end) + (case when cit then 0 else 1 end) as n_problems from v")
def q_review_decision(spark, sf_dir):
    return _reviewed(spark, sf_dir).select("block_key", "decision", F.size("problems").alias("n_problems"))


@query(f"""with {CORPUS}, {REVIEW_SQL} select block_key, decision <> 'reject' and not same as write_allowed, case when decision = 'reject' or same then 'reject' else decision end as decision,
  concat_ws(',', case when decision = 'reject' then 'review_rejected' end, case when same then 'no_change' end) as codes from v""")
def q_write_gate(spark, sf_dir):
    df = _reviewed(spark, sf_dir)
    codes = F.array_compact(F.array(F.when(F.col("text") == F.col("revised"), "no_change")))
    g = ranking.gate(F.lit(True), F.col("decision"), codes)
    return df.select("block_key", g.alias("g")).select("block_key", "g.write_allowed", "g.decision", F.array_join("g.reason_codes", ",").alias("codes"))


@query(f"""with {CORPUS}, {REVIEW_SQL} select doc_id, block_key as candidate, write_allowed from (
 select doc_id, block_key, block_id, decision <> 'reject' as write_allowed, block_key % 7 as s1, block_key % 5 as s2 from v) qualify row_number() over (partition by doc_id order by write_allowed desc, s1 desc, s2 desc, block_id) = 1""")
def q_candidate_rank(spark, sf_dir):
    df = _reviewed(spark, sf_dir).select(
        "doc_id", F.col("block_key").alias("candidate"), F.col("block_id").alias("ordinal"), (F.col("decision") != "reject").alias("write_allowed"),
        F.struct((F.col("block_key") % 7).alias("a"), (F.col("block_key") % 5).alias("b")).alias("score"),
    )
    return ranking.select(df).select("doc_id", "candidate", "write_allowed")


@query(f"""with {CORPUS}, {FILL_SQL}, {TYPE_SQL}, g as (select doc_id, chapter_type as class, count(*) as paragraphs, sum(case when text = revised then 1 else 0 end) * 100 // count(*) as match from pr group by all)
select doc_id, class, paragraphs, cast(match as bigint) as match, cast(row_number() over (partition by doc_id order by match, paragraphs desc, class) as int) as place from g qualify row_number() over (partition by doc_id order by match, paragraphs desc, class) <= 3""")
def q_worst_classes(spark, sf_dir):
    g = chaptered(spark, sf_dir).groupBy("doc_id", F.col("chapter_type").alias("class")).agg(F.count(F.lit(1)).alias("paragraphs"), F.count_if(F.col("text") == F.col("revised")).alias("_k"))
    return ranking.worst_classes(g.withColumn("match", F.expr("_k * 100 div paragraphs")).drop("_k"))


ACTION_ALIASES = {"rebuild_sentence_rhythm": ("rebuild_sentence_rhythm", "sentence_cluster_split"), "compress_subject_chain": ("compress_subject_chain", "subject_drop")}


@query(f"""with {CORPUS} select block_key, concat_ws(',', case when changed and not (sentence_changes = 1 or cluster_changes = 2) then 'rebuild_sentence_rhythm' end,
  case when changed and discourse_score <> 3 then 'compress_subject_chain' end) as missing from blocks""")
def q_missing_actions(spark, sf_dir):
    required = F.when(F.col("changed"), F.array(F.lit("rebuild_sentence_rhythm"), F.lit("compress_subject_chain"))).otherwise(F.array().cast("array<string>"))
    done = F.array_compact(F.array(
        F.when(F.col("sentence_changes") == 1, "rebuild_sentence_rhythm"), F.when(F.col("cluster_changes") == 2, "sentence_cluster_split"), F.when(F.col("discourse_score") == 3, "subject_drop")
    ))
    return corpus.blocks(spark, sf_dir).select("block_key", F.array_join(ranking.missing_actions(required, done, ACTION_ALIASES), ",").alias("missing"))


def _suggest_sql(t: str) -> str:
    low = f"lower({t})"
    year = f"regexp_matches({t}, '(^|[^0-9A-Za-z_])(19|20)[0-9]{{2}}([^0-9A-Za-z_]|$)')"
    number, vague = f"regexp_matches({t}, '[0-9]')", any_of(low, P.VAGUE)
    cite = f"regexp_matches({t}, '(?i)\\[[0-9,\\-\\s]+\\]|\\((19|20)\\d{{2}}\\)|et al\\.')"
    a = f"{any_of(low, P.RESEARCH_HINTS)} and not {cite}"
    b = f"not {year} and ({any_of(t, ('近年来', '目前', '当前'))} or {vague})"
    c = f"{any_of(low, P.CASE_HINTS)} and not {number}"
    d = f"{any_of(low, P.SAMPLE_HINTS)} and not {number}"
    e = f"{vague} and not ({a}) and not ({b}) and not ({c}) and not ({d})"
    return f"case when length({t}) < 50 then '' else concat_ws('|', " + ", ".join(f"case when {x} then '{s}' end" for x, s in zip((a, b, c, d, e), P.SUGGESTIONS, strict=True)) + ") end"


@query(f"with {CORPUS} select block_key, {_suggest_sql('text')} as suggestions from blocks")
def q_suggestions(spark, sf_dir):
    return corpus.blocks(spark, sf_dir).select("block_key", F.array_join(suggest.suggestions(F.col("text")), "|").alias("suggestions"))


# ---- execution plans
def _ordered(rows) -> str:
    """Joined in order, each name once (its first place)."""
    seen, out = {}, []
    for c, v in rows:
        seen.setdefault(v, []).append(c)
    for v, cs in seen.items():
        out.append(f"case when {' or '.join(f'({c})' for c in cs)} then '{v}' end")
    return "concat_ws(',', " + ", ".join(out) + ")"


PLAN_SQL = f"""
e0 as (select *, {sent('text')} as s from pol),
e as (select *, len(s) as n, edit_policy = 'rewritable' as op, rewrite_depth = 'developmental_rewrite' as dev, rewrite_depth = 'light_edit' as li,
  len(list_filter(range(1, len(s)), lambda i: {HEAD.format(y='s[i]')} <> '' and {HEAD.format(y='s[i]')} = {HEAD.format(y='s[i + 1]')})) > 0 as rep,
  len(list_filter(s, lambda x: regexp_matches(x, '{execution.IMPLICATION_HEAD}'))) > 0 as imp, regexp_matches(text, '{execution.ENUMERATION}') as enu, template_density >= 2 as tpl, meta_density >= 2 as meta, function_density >= 2 as fun,
  coalesce(len(s) >= 3 and list_max(list_transform(s, lambda x: length(regexp_replace(x, '\\s', '', 'g')))) - list_min(list_transform(s, lambda x: length(regexp_replace(x, '\\s', '', 'g')))) <= 10, false) as flat,
  regexp_matches(text, '{P.PARALLELISM}') or (len(s) >= 3 and len(list_distinct(list_transform(s[1:3], lambda x: x[1:5]))) = 1) as par from e0)"""
STRUCTURAL = [("op and n >= 2", "pair_fusion"), ("op and n >= 2", "sentence_cluster_merge"), ("op and n < 2 and len(regexp_extract_all(text, '，')) >= 2", "clause_reorder"), ("rep", "subject_chain_compression"), ("imp", "conclusion_absorb"), ("enu", "enumeration_reframe")]
SHARED = [("rep", "subject_chain_compression"), ("rep", "compress_subject_chain"), ("meta", "meta_compression"), ("imp", "conclusion_absorb"), ("enu", "enumeration_reframe"), ("tpl", "transition_absorption"), ("tpl", "weaken_template_connectors"),
          ("fun", "reduce_function_word_overuse"), ("dense_nominal", "rewrite_dense_nominal_phrases"), ("flat", "rebuild_sentence_rhythm"), ("par", "break_parallelism")]
NO_SHARED = " and ".join(f"not {c}" for c in ("rep", "meta", "imp", "enu", "tpl", "fun", "dense_nominal", "flat", "par"))
DISCOURSE = SHARED + [(f"li and {NO_SHARED}", "sentence_level_recast"), ("li", "uneven_rewrite_distribution"), ("dev and n >= 2", "sentence_cluster_rewrite"), ("dev and n >= 2", "sentence_cluster_merge"), ("dev and n >= 3", "proposition_reorder"),
                      ("dev and n >= 3", "discourse_reordering"), ("dev and n >= 3", "narrative_path_rewrite"), (f"dev and regexp_matches(text, '{execution.CAUSE}')", "rationale_expansion")]


@query(f"""with {CORPUS}, {POLICY_SQL}, {PLAN_SQL}
select block_key, rep as repeated_subject, case when edit_policy in ('light_edit', 'rewritable') then {_ordered(STRUCTURAL)} else '' end as structural, case when li or dev then {_ordered(DISCOURSE)} else '' end as discourse,
  case when not dev then 'light' when n >= 3 and (regexp_matches(text, '{execution.TOPIC_WORDS}') or rep or meta or tpl or fun or par or dense_nominal or flat) then 'high' else 'medium' end as intensity from e""")
def q_required_actions(spark, sf_dir):
    df = execution.requirements(B.policy(corpus.blocks(spark, sf_dir)))
    return df.select("block_key", "repeated_subject", F.array_join("structural", ",").alias("structural"), F.array_join("discourse", ",").alias("discourse"), "intensity")


@query()
def q_execution_plan(spark, sf_dir):
    """Instructions of every block, and the problems of what was done to it."""
    df = execution.requirements(B.policy(corpus.blocks(spark, sf_dir)))
    done = F.when(F.col("sentence_changes") > 1, F.array(F.lit("pair_fusion"), F.lit("conclusion_absorb"))).otherwise(F.array().cast("array<string>"))
    tried = corpus.blocks(spark, sf_dir).select("doc_id", "block_id", "changed", done.alias("done"), "sentence_changes", "cluster_changes")
    found = execution.validate(df, tried).select("doc_id", "block_id", F.array_join("problems", ",").alias("problems"))
    return execution.instructions(df).join(found, ["doc_id", "block_id"], "left")


# ---- rewriting
def _ensure_sql(x: str) -> str:
    return f"case when {x} = '' or ends_with({x}, ']]') or regexp_matches({x}, '[。！？?!.:：;；]$') then {x} when regexp_matches({x}, '[\\x{{4e00}}-\\x{{9fff}}]') then {x} || '。' else {x} || '.' end"


def _rules_sql(x: str, rules) -> str:
    out = x
    for p, new in rules:
        out = f"regexp_replace({out}, '{p}', '{new.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"
    return out


def _transform_query(name: str, rules):
    inner = _rules_sql("x", rules)
    sql = f"""with {CORPUS}, s as (select block_key, unnest(ss) as x, unnest(range(len(ss))) as i from (select block_key, {sent('text')} as ss from blocks)), y as (select *, {inner} as y from s)
select block_key, i as sent_idx, case when y = x then x else {_ensure_sql('y')} end as rewritten from y"""

    def run(spark, sf_dir):
        df = corpus.blocks(spark, sf_dir).select("block_key", F.posexplode(T.sentences(F.col("text"))).alias("i", "x"))
        return df.select("block_key", F.col("i").cast("long").alias("sent_idx"), rewrite.TRANSFORMS[name](F.col("x")).alias("rewritten"))

    run.__name__ = f"q_{name}"
    query(sql)(run)


for _name, _rules in (("unwrap", rewrite.WRAPPING), ("restrain_goals", rewrite.SLOGANS), ("flatten_parallels", rewrite.PARALLEL), ("activate", rewrite.PASSIVES), ("verbalise", rewrite.NOMINALS)):
    _transform_query(_name, _rules)


@query()
def q_rewrite_sentences(spark, sf_dir):
    """All sentence transforms in turn."""
    df = corpus.blocks(spark, sf_dir).select("block_key", F.posexplode(T.sentences(F.col("text"))).alias("i", "source"))
    df = df.withColumn("x", rewrite.naturalise(F.col("source")))
    return df.select("block_key", F.col("i").alias("sent_idx"), (F.col("x") != F.col("source")).alias("changed"), F.col("x").alias("rewritten"), rewrite.l2_variant(F.col("source")).alias("l2"))


@query()
def q_json_report(spark, sf_dir):
    """One JSON record per document: risk, scale and the chapters that miss their quota."""
    risk = B.document_risk(with_policy(spark, sf_dir))
    codes = chapters.reason_codes(chapters.metrics(chaptered(spark, sf_dir)))
    return risk.join(codes, "doc_id", "left").select("doc_id", F.to_json(F.struct("risk", "scale", "body_blocks", "body_chars", "body_sentences", "codes")).alias("report"))


@query("select doc_id, cast(rank() over (partition by source order by length(text) desc, doc_id) as int) as place, source, length(text) as n_chars from documents qualify place <= 3")
def q_longest_per_source(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    df = documents(spark, sf_dir).select("doc_id", "source", F.length("text").alias("n_chars"))
    return df.withColumn("place", F.rank().over(w)).where("place <= 3")


FLAGSHIP = q_doc_profile
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "config"]
