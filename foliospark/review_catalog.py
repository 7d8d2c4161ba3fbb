"""Registered queries of naturalness, the checklist and the full write gate, over every order.

A row's case is its key modulo the number of cases; the SQL sides write the
expected values of each case out, or compute them from the key by themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import sentences
from .operators import naturalness as N
from .rules_catalog import orders

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def case(*values: str) -> Column:
    """The value whose turn it is by the order's key."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col("k") % len(values) + 1).cast("int"))


def expected(names: str, *rows: str) -> str:
    """SQL: one row of expected values for each case; # in a row is the order's key as text."""
    key = "cast(o_orderkey as varchar)"
    cols = [n.strip() for n in names.split(",")]
    return f"select o_orderkey as k, {', '.join(f'replace(e.{c}, chr(35), {key}) as {c}' if c.startswith('t_') else f'e.{c}' for c in cols)} from orders join (values " + ", ".join(f"({i}, {r})" for i, r in enumerate(rows)) + f") as e(i, {names}) on o_orderkey % {len(rows)} = e.i"


def bit(i: int) -> Column:
    return F.shiftright(F.col("k"), i).bitwiseAND(F.lit(1)) == 1


def sql_bit(i: int) -> str:
    return f"((o_orderkey >> {i}) & 1 = 1)"


@query("""with c as (select o_orderkey as k, o_orderkey % 400 as n from orders)
select k, case when n >= 220 then 2 when n >= 120 then 1 else 0 end as balanced, case when n >= 220 then 3 when n >= 120 then 2 else 0 end as strong, n >= 120 as strong_high, 0 as conservative,
  case when n >= 120 then 5 else 2 end as discourse, 2 as discourse_conservative, case when n >= 120 then 1 else 0 end as cluster, 0 as cluster_conservative, case when n >= 220 then 2 else 1 end as structural_strong, 1 as structural from c""")
def q_required_by_length(spark, sf_dir):
    n = F.col("k") % 400
    return orders(spark, sf_dir).select(
        "k", N.required_actions("balanced", n)["actions"].alias("balanced"), N.required_actions("strong", n)["actions"].alias("strong"), N.required_actions("strong", n)["high_value"].alias("strong_high"),
        N.required_actions("conservative", n)["actions"].alias("conservative"), N.required_discourse("strong", n).alias("discourse"), N.required_discourse("conservative", n).alias("discourse_conservative"),
        N.required_cluster("balanced", n).alias("cluster"), N.required_cluster("conservative", n).alias("cluster_conservative"), N.required_structural("strong", n).alias("structural_strong"), N.required_structural("balanced", n).alias("structural"),
    )


@query(f"""select o_orderkey as k, greatest(0, 100 - (case when {sql_bit(0)} then 40 when {sql_bit(1)} then 15 else 0 end) - (case when {sql_bit(2)} then 20 else 0 end) - (case when {sql_bit(3)} then 0 else 20 end) - (case when {sql_bit(4)} then 0 else 15 end)) as score,
 case when not {sql_bit(5)} then 'revert_to_original_and_restore_protected_content' when not {sql_bit(6)} then 'revert_to_original_or_retry_with_do_not_touch_blocks_frozen'
  when {sql_bit(7)} and {sql_bit(0)} then 'retry_with_lighter_edits_and_keep_original_when_rewrite_sounds_stiff' when {sql_bit(7)} then 'retry_only_on_rewritable_blocks_or_downgrade_to_conservative' else 'ready_for_write_gate' end as fallback from orders""")
def q_naturalness_score(spark, sf_dir):
    return orders(spark, sf_dir).select(
        "k", N.score(*(bit(i) for i in range(5))).alias("score"), N.fallback(F.when(bit(7), "reject").otherwise("pass"), bit(0), bit(6), bit(5)).alias("fallback")
    )


@query(f"""with c as (select o_orderkey as k, o_orderkey % 7 as sp, o_orderkey % 31 as ch, o_orderkey % 3 as st, o_orderkey % 6 as di, o_orderkey % 2 as cl, (o_orderkey % 10) / 10.0 as cov,
  {sql_bit(3)} as lev, {sql_bit(4)} as pre, {sql_bit(5)} as deep, {sql_bit(6)} as long_, o_orderkey % 11 = 0 as same from orders)
select k, not same and not pre and not ((long_ and st < 1) or (not deep and di < case when long_ then 5 else 2 end) or (cl < case when long_ then 1 else 0 end and cov < 0.4))
   and (lev or st >= 1 or di >= 5 or cov >= 0.4 or (ch >= 12 and sp >= 2)) as balanced,
  not same and not pre and not ((long_ and st < 1) or (not deep and di < case when long_ then 5 else 2 end) or (cl < case when long_ then 1 else 0 end and cov < 0.4))
   and (lev or st >= 1 or di >= 5 or cov >= 0.4 or (ch >= 20 and sp >= 2)) as strong, not same and (ch >= 2 or sp >= 1) as conservative from c""")
def q_meaningful_change(spark, sf_dir):
    k = F.col("k")
    text = F.when(bit(6), F.lit("字" * 120)).otherwise(F.lit("字" * 119 + " "))
    facts = dict(
        original=text, revised=F.when(k % 11 == 0, text).otherwise(F.concat(text, F.lit("新"))), characters=k % 31, spans=k % 7, level=bit(3), structural=k % 3, discourse=k % 6, cluster=k % 2,
        covered=(k % 10) / F.lit(10.0), prefixes=bit(4), deep=bit(5),
    )
    return orders(spark, sf_dir).select("k", *(N.meaningful(m, **facts).alias(m) for m in ("balanced", "strong", "conservative")))


_PAIRS = (
    ("本研究提出模型。本研究完成部署。", "本研究提出模型，并完成部署。"), ("因此，流程更快。样本较少。", "流程更快。样本较少。"), ("样本较少。结果较好。", "样本很少。结果较好。"), ("样本较少。", "样本很少。"), ("甲。乙。丙。", "甲。乙。丙。"),
    ("同时，流程更快。", "此外，流程更快。"), ("从流程角度看，更快。综上，有效。", "从流程角度看，更快。综上，有效。在此基础上，完成。"), ("", "新增。"),
)


@query(expected(
    "high_value, patterns, prefix_only, sentence_level, coverage, style",
    "'subject_chain_compression,pair_fusion', 'merge,reorder,rewrite_all', false, true, 1.0e0, 7", "'conclusion_absorb', 'reorder,merge,partial_keep', true, false, 0.5e0, 8", "'', 'partial_keep', false, false, 0.5e0, 8",
    "'', 'rewrite_all', false, false, 1.0e0, 7", "'', '', false, false, 0.0e0, 9", "'', 'rewrite_all', true, false, 1.0e0, 7", "'', 'split,reorder,partial_keep', false, true, 1.0e0, 3", "'', 'split,reorder', false, true, 0.0e0, 7",
))
def q_inferred_changes(spark, sf_dir):
    """What two texts show of a revision, without its record."""
    a, b = (sentences(case(*(p[i] for p in _PAIRS))) for i in (0, 1))
    revised = case(*(p[1] for p in _PAIRS))
    return orders(spark, sf_dir).select(
        "k", F.array_join(N.high_value(a, b), ",").alias("high_value"), F.array_join(N.patterns(a, b, case(*(p[0] for p in _PAIRS)) != revised), ",").alias("patterns"), N.prefix_only(a, b).alias("prefix_only"),
        N.sentence_level(a, b).alias("sentence_level"), N.coverage(a, b).alias("coverage"), N.style_variation(revised, b).alias("style"),
    )


_POINTS = ("academic_not_colloquial", "template_connectors_reduced_or_controlled", "repeated_subjects_reduced_or_controlled", "function_word_overuse_reduced_or_controlled", "parallelism_controlled", "sentence_rhythm_has_variation", "meta_discourse_compressed", "narrative_flow_rebuilt", "developmental_rewrite_applied_to_body_blocks")
_CHECKED = (
    ("样本较少。", "其实样本较少。"), ("样本较少。", "首先，甲。其次，乙。最后，丙丙。"), ("样本较少。", "本研究甲。本研究乙。本研究丙丙。"), ("样本较少。", "进行构建，实现提升。"), ("样本较少。", "不仅要快，还要稳。"), ("样本较少。", "甲甲。乙乙。丙丙。"),
    ("样本较少。", "本研究聚焦于甲，本研究围绕乙。"), ("我们做样本。", "我们做样本分析。"),
)


@query(expected(
    "points, meta_done, flow_done",
    "'0,1,1,1,1,1,1,0,0', true, true", "'1,0,1,1,1,1,1,0,0', true, true", "'1,1,0,1,1,1,1,0,0', true, true", "'1,1,1,0,1,1,1,0,0', true, true", "'1,1,1,1,0,1,1,0,0', true, true", "'1,1,1,1,1,0,1,0,0', true, true", "'1,1,1,1,1,1,0,0,0', true, true", "'1,1,1,1,1,1,1,0,0', true, true",
))
def q_review_checklist(spark, sf_dir):
    """Each case misses one point of the checklist (and all of them the two that the scores decide)."""
    a, b = (case(*(p[i] for p in _CHECKED)) for i in (0, 1))
    yes, none = F.lit(True), F.array().cast("array<string>")

    def of(done: Column, cluster: int) -> Column:
        return N.checklist(a, b, yes, yes, F.lit(False), F.lit(cluster), F.lit(1), F.lit(0.3), done)

    first, other = of(none, 0), of(F.array(F.lit("meta_compression"), F.lit("transition_absorption")), 0)
    return orders(spark, sf_dir).select(
        "k", F.array_join(F.array(*[first[p].cast("int").cast("string") for p in _POINTS]), ",").alias("points"), other["meta_discourse_compressed"].alias("meta_done"), other["narrative_flow_rebuilt"].alias("flow_done")
    )


@query(expected("family", "'study_subject_family'", "'implication_family'", "'transition_family'", "'framing_family'", "cast(null as varchar)", "'implication_family'", "'study_subject_family'"))
def q_surface_family(spark, sf_dir):
    return orders(spark, sf_dir).select("k", N.surface_family(case("本研究", "因此有必要", "与之相伴的是", "围绕……这一问题", "省略连接", "并在此基础上", "据此，本文")).alias("family"))


@query("""with c as (select o_orderkey as k, o_orderkey % 8 as f, o_orderkey % 3 as p, 2 + o_orderkey % 41 as n, o_orderkey % 5 as r, o_orderkey % 6 as v, o_orderkey % 4 as s, o_orderkey % 2 = 1 as stiff, o_orderkey % 9 as var from orders),
d as (select *, f >= case when n < 10 then 3 else greatest(6, n // 4) end or p > 1 as fam, r >= 3 or v > 3 as rul from c)
select k, fam or s >= 3 or rul as risk, not (fam or s >= 3 or rul) and (f >= 2 or r >= 2 or stiff or var <= 4) as warning,
  case when fam or s >= 3 then 'templated_family_repetition' when rul then 'templated_rule_like_rewrite' when f >= 2 then 'templated_family_repetition' when r >= 2 or stiff then 'templated_rule_like_rewrite' end as issue from d""")
def q_template_issue(spark, sf_dir):
    k = F.col("k")
    out = N.template_issue(k % 8, k % 3, F.lit(2) + k % 41, k % 5, k % 6, k % 4, k % 2 == 1, k % 9)
    return orders(spark, sf_dir).select("k", out.alias("t")).select("k", "t.*")


#: codes in the gate's order, written out: always, then for long documents, for aligned ones, and last
_ALWAYS = "core_content_integrity_failed,format_integrity_failed,body_rewrite_coverage_below_write_threshold,body_discourse_change_score_below_write_threshold,body_cluster_rewrite_score_below_write_threshold,body_changed_blocks_below_write_threshold,chapter_policy_consistency_failed,paragraph_topic_sentence_not_preserved,paragraph_opening_style_invalid,paragraph_skeleton_inconsistent,dangling_paragraph_opening_sentence,topic_sentence_demoted_to_mid_paragraph,local_transition_rigidity,local_discourse_flatness,sentence_uniformity_not_reduced,revision_realism_missing,sentence_completeness_failed,paragraph_readability_failed,dangling_sentence_risk_too_high,fragment_like_conclusion_sentence,semantic_role_integrity_failed,enumeration_integrity_failed"
_LONG = "evidence_fidelity_failed,unsupported_expansion_failed,thesis_tone_restraint_failed,metaphor_or_storytelling_failed,authorial_claim_risk_failed,bureaucratic_opening_density_failed,explicit_subject_chain_failed,overstructured_syntax_failed,delayed_main_clause_risk_failed,slogan_like_goal_phrase_failed,author_style_alignment_failed,sentence_cluster_changes_missing_for_long_document,human_like_variation_missing_for_long_document,non_uniform_rewrite_distribution_missing_for_long_document"
_ALIGNED = "target_style_alignment_grammar_error_rate_too_high,target_style_alignment_terminology_drift_detected,target_style_alignment_evidence_drift_detected"
_LAST = "structural_action_count_below_threshold,missing_high_value_action"
_CODES = f"string_split('{_ALWAYS},{_LONG},{_ALIGNED},{_LAST}', ',')"
_N = 22 + 14 + 3 + 2


@query(f"""with c as (select o_orderkey as k, cast(o_orderkey % {_N + 1} as int) as i, {sql_bit(5)} as long_, {_CODES} as codes from orders),
d as (select *, case when i = {_N} then null when i between 22 and 35 and not long_ then null else codes[i + 1] end as code from c)
select k, coalesce(code, 'review_passed') as codes, code is null as write_allowed, case when code is null then 'pass' else 'reject' end as decision from d""")
def q_write_gate_codes(spark, sf_dir):
    """One thing fails in each case: its code is the only one, or none where the document is short."""
    k = F.col("k")
    names = [name for name, _ in (*N.GATES, *N.LONG_GATES, *N.ALIGNMENT_GATES, *N.LAST_GATES)]
    none = F.array().cast("array<string>")
    out = N.write_gate(
        {name: k % (_N + 1) != i for i, name in enumerate(names)}, reviewed=F.lit(True), decision=F.lit("pass"), problems=none, long_document=bit(5), quota=none, chapters=none, blocks=none, aligned=True
    )
    return orders(spark, sf_dir).select("k", out.alias("g")).select("k", F.array_join("g.reason_codes", ",").alias("codes"), "g.write_allowed", "g.decision")


@query(expected(
    "codes, write_allowed, decision", "'unreviewed_candidate', false, 'reject'", "'review_reject,missing_high_value_action,chapter_1_x,semantic_role_integrity_failed,evidence_fidelity_failed', false, 'reject'",
    "'title_integrity_check_failed,missing_high_value_action,chapter_1_x,semantic_role_integrity_failed', false, 'reject'", "'quota_x,chapter_1_x,semantic_role_integrity_failed,evidence_fidelity_failed,missing_high_value_action,block_9', false, 'reject'",
    "'quota_x,chapter_1_x,semantic_role_integrity_failed,missing_high_value_action,block_9', false, 'reject'", "'review_passed', true, 'pass_with_minor_risk'",
))
def q_write_gate_paths(spark, sf_dir):
    """Without a review; rejected (long, without and short, with problems); passed with several failures (long, short); blocks that failed while all quotas are met."""
    i, none = F.col("k") % 6, F.array().cast("array<string>")
    fine = i == 5

    def some(x: str) -> Column:
        return F.when(fine, none).otherwise(F.array(F.lit(x)))

    out = N.write_gate(
        {"high_value_action_present": fine, "semantic_role_integrity_preserved": fine, "evidence_fidelity_preserved": fine}, reviewed=i != 0, decision=F.when(i.isin(1, 2), "reject").otherwise("pass_with_minor_risk"),
        problems=F.when(i == 2, F.array(F.lit("title_integrity_check_failed"))).otherwise(none), long_document=i.isin(1, 3, 5), quota=some("quota_x"), chapters=some("chapter_1_x"), blocks=F.array(F.lit("block_9")),
    )
    return orders(spark, sf_dir).select("k", out.alias("g")).select("k", F.array_join("g.reason_codes", ",").alias("codes"), "g.write_allowed", "g.decision")


@query("""with c as (select o_custkey as doc_id, o_orderkey as ordinal, o_orderkey % 2 as allowed, o_orderkey % 3 as decision, (o_orderkey % 7) * 10 as fidelity, o_orderkey % 4 as drift, (o_orderkey % 9) * 10 as clich, o_orderkey % 100 as changed from orders)
select doc_id, ordinal, 'pass ' || ordinal || ':fidelity=' || cast(fidelity / 100 as double) || ',drift=' || drift as said from c
qualify row_number() over (partition by doc_id order by allowed desc, decision desc, fidelity desc, drift, clich, changed desc, ordinal) = 1""")
def q_candidate_score(spark, sf_dir):
    """The best candidate of a document by the long score: a customer's orders are its candidates."""
    from .operators import ranking

    k = F.col("ordinal")
    values = {"write_allowed": k % 2, "decision": k % 3, "evidence_fidelity": (k % 7) / F.lit(10.0), "evidence_drift": k % 4, "cliche": (k % 9) / F.lit(10.0), "changed_characters": k % 100}
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ordinal"))
    df = df.withColumns({"score": ranking.candidate_score(values), "write_allowed": k % 2 == 1, "said": ranking.score_text(F.concat(F.lit("pass "), k.cast("string")), {"fidelity": values["evidence_fidelity"], "drift": values["evidence_drift"]})})
    return ranking.select(df, "doc_id", "score", "ordinal").select("doc_id", "ordinal", "said")


@query(f"""with c as (select o_orderkey as k, case when {sql_bit(0)} then 'light_edit' when {sql_bit(1)} then 'rewritable' else 'high_risk' end as pol, ['high', 'medium', 'conservative'][o_orderkey % 3 + 1] as pri, not {sql_bit(2)} or not {sql_bit(3)} as again from orders),
d as (select *, pol <> 'high_risk' and pri = 'conservative' as careful, pol = 'rewritable' and pri <> 'conservative' as dev, pol = 'light_edit' and pri <> 'conservative' as light from c)
select k, case when careful then 'light' when dev and pri = 'medium' then 'medium' when dev then 'high' when light then 'medium' else 'x' end as intensity, case when careful then '' when dev then 'sentence_cluster_merge,pair_fusion' else 'sentence_cluster_merge' end as structural,
 case when careful or light then 'sentence_level_recast' when dev then 'sentence_cluster_rewrite,proposition_reorder,transition_absorption' else '' end as discourse, case when dev then 2 when careful or light then 1 else 0 end as min_sentence_changes,
 case when dev and pri <> 'medium' then 1 else 0 end as min_cluster_changes, again as retry, false as retry_conservative from d""")
def q_retry_escalation(spark, sf_dir):
    from .operators import ranking

    policy = F.when(bit(0), "light_edit").when(bit(1), "rewritable").otherwise("high_risk")
    depth = F.when(bit(0), "light_edit").when(bit(1), "developmental_rewrite").otherwise("high_risk")
    priority = F.element_at(F.array(*map(F.lit, ("high", "medium", "conservative"))), (F.col("k") % 3 + 1).cast("int"))
    out = ranking.escalated(policy, depth, priority, F.lit("x"), F.array(F.lit("sentence_cluster_merge")), F.array().cast("array<string>"), F.lit(0), F.lit(0))
    holds = {"rewrite_quota_met": bit(2), "revision_realism_present": bit(3), "unknown": F.lit(False)}
    return orders(spark, sf_dir).select("k", out.alias("o"), ranking.needs_retry("balanced", holds).alias("retry"), ranking.needs_retry("conservative", holds).alias("retry_conservative")).select(
        "k", "o.intensity", F.array_join("o.structural", ",").alias("structural"), F.array_join("o.discourse", ",").alias("discourse"), "o.min_sentence_changes", "o.min_cluster_changes", "retry", "retry_conservative"
    )


_EVIDENCE = (("样本较少。", "样本较少。"), ("样本较少。", "普遍认为样本较少。"), ("样本较少。", "如同一场手术，样本较少。"), ("本研究提出方案。模型通过融合输出特征。", "本研究提出方案。模型通过融合输出特征。"), ("", "样本较少。"), ("普遍认为样本较少。", "普遍认为样本较少。"))


@query(expected(
    "fidelity, unsupported, register, metaphor, claim, drift", "0.94e0, 0.0e0, 0.78e0, 0.0e0, 0.0e0, false", "0.32e0, 1.0e0, 0.32e0, 0.0e0, 1.0e0, true", "0.82e0, 0.0e0, 0.63e0, 0.5e0, 0.0e0, false",
    "0.94e0, 0.0e0, 0.94e0, 0.0e0, 0.0e0, false", "0.88e0, 0.0e0, 0.78e0, 0.0e0, 0.0e0, false", "0.94e0, 0.0e0, 0.78e0, 0.0e0, 0.0e0, false",
))
def q_evidence_cases(spark, sf_dir):
    """Nothing added; outside opinion (which is a claim too); a comparison; academic register; no source; an opinion that the source has."""
    from .functions import signals

    a, b = (sentences(case(*(p[i] for p in _EVIDENCE))) for i in (0, 1))
    return orders(spark, sf_dir).select("k", signals.evidence(a, b).alias("e")).select("k", "e.*")


@query(expected(
    "sentences, avg_length, clauses, native, match", "1, 5.0e0, 0.0e0, 0.45e0, 0.9119e0", "1, 12.0e0, 1.0e0, 0.45e0, 1.0e0", "2, 9.5e0, 0.0e0, 0.45e0, 0.9226e0",
))
def q_style_cases(spark, sf_dir):
    """Distributions of three texts, and how they match that of the second."""
    from .functions import families

    own, other = families.distribution(sentences(case("样本较少。", "如同一场手术，样本较少。", "本研究提出方案。模型通过融合输出特征。"))), families.distribution(sentences(F.lit("如同一场手术，样本较少。")))
    return orders(spark, sf_dir).select("k", own.alias("d"), families.style_match(own, other).alias("match")).select("k", "d.sentences", "d.avg_length", "d.clauses", "d.native", "match")


@query("""select o_orderkey as k, case o_orderkey % 3 when 0 then '见 http://a.b/' || o_orderkey || ' 与 [[KEEP:URL:0000]] 和 `码`。' when 1 then '# 题 ' || o_orderkey || chr(10) || chr(10) || '准确率 93.5%[3][4]，见 checkpoints/run.pth。' else 'A plain English paragraph of order ' || o_orderkey || '.' end as restored,
  o_orderkey % 3 = 2 as whole from orders""")
def q_mask_restored(spark, sf_dir):
    """Texts with links, code, headings, numbers, citations, paths, English and what looks like a token, after masking and restoring."""
    from .operators import mask

    k = F.col("k").cast("string")
    text = (
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("见 http://a.b/"), k, F.lit(" 与 [[KEEP:URL:0000]] 和 `码`。")))
        .when(F.col("k") % 3 == 1, F.concat(F.lit("# 题 "), k, F.lit("\n\n准确率 93.5%[3][4]，见 checkpoints/run.pth。"))).otherwise(F.concat(F.lit("A plain English paragraph of order "), k, F.lit(".")))
    )
    df = orders(spark, sf_dir).select("k", mask.mask(text).alias("m"))
    return df.select("k", mask.restore(F.col("m.text"), F.col("m.kept")).alias("restored"), F.col("m.text").rlike(r"^\[\[KEEP:CORE_ENGLISH:0000\]\]$").alias("whole"))
