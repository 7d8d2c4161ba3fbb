"""Registered queries of repairs, alignment, guidance and target style, over every order; expected values are written out in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.text import sentences
from .operators import align, repairs
from .plans import guidance
from .review_catalog import bit, case, expected, sql_bit
from .rules_catalog import joined, orders, said

QUERIES = {}
ORACLE_SQL = {}
K = "cast(o_orderkey as varchar)"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(expected(
    "t_unsupported, t_metaphors, t_first_person, t_overclaims",
    "'样本#较少。', '样本#较少。', '样本#较少。', '样本#较少。'", "'源句#。', '超过八成样本#失效。', '超过八成样本#失效。', '超过八成样本#失效。'", "'这是幻想的破灭#。', '源句#。', '这是幻想的破灭#。', '这是幻想的破灭#。'",
    "'我们设计了系统#。', '我们设计了系统#。', '本研究设计了系统#。', '系统#。'", "'本工作证明了方法#有效。', '本工作证明了方法#有效。', '本工作证明了方法#有效。', '本研究表明方法#有效。'",
).replace("'系统#。'", "'我们设计了系统#。'"))
def q_repair_evidence(spark, sf_dir):
    def text(x: str):
        a, b = x.split("#")
        return F.concat(F.lit(a), F.col("k").cast("string"), F.lit(b))

    rows = ("样本#较少。", "超过八成样本#失效。", "这是幻想的破灭#。", "我们设计了系统#。", "本工作证明了方法#有效。")
    s = F.element_at(F.array(*map(text, rows)), (F.col("k") % 5 + 1).cast("int"))
    src = text("源句#。")
    return orders(spark, sf_dir).select(
        "k", repairs.unsupported(s, src).alias("t_unsupported"), repairs.metaphors(s, src).alias("t_metaphors"), repairs.first_person(s, src).alias("t_first_person"), repairs.overclaims(s, src).alias("t_overclaims")
    )


@query(expected(
    "t_modals, t_assertions, t_softened, t_recast",
    "'该方法提升精度#。', '该方法有助于提升精度#。', '该方法有助于提升精度#。', '该方法有助于提升精度#。'", "'系统负责提取特征#。', '系统用于提取特征#。', '系统用于提取特征#。', '系统用于提取特征#。'", "'这表明样本#较少。', '样本#较少。', '这表明样本#较少。', '这表明样本#较少。'",
    "'因此，样本#较少。', '因此，样本#较少。', '样本#较少。', '因此，样本#较少。'", "'本研究采用阈值#，兼顾精度。', '本研究采用阈值#，兼顾精度。', '本研究采用阈值#，兼顾精度。', '本研究采用阈值#，以兼顾精度。'", "'后续研究仍将围绕样本#展开。', '本研究继续围绕样本#展开。', '本研究继续围绕样本#展开。', '本研究继续围绕样本#展开。'",
))
def q_repair_assertions(spark, sf_dir):
    rows = ("该方法有助于提升精度#。", "系统用于提取特征#。", "这表明样本#较少。", "因此，样本#较少。", "本研究采用阈值#，兼顾精度。", "本研究继续围绕样本#展开。")
    s = F.replace(case(*rows), F.lit("#"), F.col("k").cast("string"))
    return orders(spark, sf_dir).select(
        "k", repairs.plain_modals(s).alias("t_modals"), repairs.assertions(s).alias("t_assertions"), repairs.softened(s).alias("t_softened"), repairs.recast_once(s).alias("t_recast")
    )


@query(f"""select o_orderkey as k, '甲。|总体来看，系统实现了完整闭环' || {K} || '。|乙。' as summaries, '甲。|这一句话的长度明显超过了二十四个字所以它会被比较' || {K} || '。|并且有新的内容。' as prefixes,
 '模型 ResNet50 较快' || {K} || '。|乙。' as covered_some, '模型 ResNet50。|乙' || {K} || '。' as covered_all, '模型较快。|乙' || {K} || '。' as covered_same from orders""")
def q_repair_neighbours(spark, sf_dir):
    once, cut = repairs.on_sentences(repairs.without_summaries), repairs.on_sentences(repairs.without_prefixes)
    k = F.col("k").cast("string")
    long_ = said("这一句话的长度明显超过了二十四个字所以它会被比较", "#", "。")
    return orders(spark, sf_dir).select(
        "k", joined(once(F.array(F.lit("甲。"), said("总体来看，系统实现了完整闭环", "#", "。"), said("综上，系统实现了完整闭环", "#", "。"), F.lit("乙。")))).alias("summaries"),
        joined(cut(F.array(F.lit("甲。"), long_, F.concat(F.regexp_replace(long_, "。$", ""), F.lit("，并且有新的内容。"))))).alias("prefixes"),
        joined(repairs.coverage_repair(F.array(F.concat(F.lit("模型 ResNet50 较快"), k, F.lit("。")), F.lit("乙。")), F.array(F.concat(F.lit("模型较快"), k, F.lit("。")), F.lit("乙。")))).alias("covered_some"),
        joined(repairs.coverage_repair(F.array(F.lit("模型 ResNet50。"), F.concat(F.lit("乙"), k, F.lit("。"))), F.array(F.lit("模型 GPT2。"), F.concat(F.lit("丙"), k, F.lit("。"))))).alias("covered_all"),
        joined(repairs.coverage_repair(F.array(F.lit("模型快。")), F.array(F.lit("模型较快。"), F.concat(F.lit("乙"), k, F.lit("。"))))).alias("covered_same"),
    )


@query(expected(
    "t_reshaped, t_unfinished, t_completed",
    "'系统既采集样本#，也完成标注。', '系统一方面采集样本#，另一方面也完成标注。', '系统一方面采集样本#，另一方面也完成标注。'", "'该方法主要降低误报#。', '该方法能够降低误报#。', '该方法能够降低误报#。'",
    "'该流程统一#，从而为部署提供了重要基础。', '该流程统一#，也使部署更容易展开。', '该流程统一#，从而为部署提供了重要基础。'", "'该流程#具有重要意义。', '该流程#的意义也体现在这里。', '该流程#具有重要意义。'",
    "'并形成流程#。', '并形成流程#。', '系统形成流程#。'", "'而是精度#。', '而是精度#。', '系统更强调精度#。'", "'根据NTIRE#结果。', '根据NTIRE#结果。', '系统还需要结合 NTIRE#结果。'",
))
def q_repair_shapes(spark, sf_dir):
    rows = ("系统一方面采集样本#，另一方面也完成标注。", "该方法能够降低误报#。", "该流程统一#，从而为部署提供了重要基础。", "该流程#具有重要意义。", "并形成流程#。", "而是精度#。", "根据NTIRE#结果。")
    s = F.replace(case(*rows), F.lit("#"), F.col("k").cast("string"))
    run = [F.pandas_udf(lambda rows, f=f: rows.map(f), "string") for f in (repairs.reshaped, repairs.unfinished, lambda x: repairs.completed(x, "", "系统完成标注。"))]
    return orders(spark, sf_dir).select("k", *[f(s).alias(n) for f, n in zip(run, ("t_reshaped", "t_unfinished", "t_completed"), strict=True)])


@query(f"""select o_orderkey as k, '甲。|样本' || {K} || '较少，这一点需要说明。|乙。' as supplement, '系统包括两步' || {K} || '，第一，采集样本。|第二，完成标注。' as steps, '系统采集' || {K} || '。|同时，完成标注。|样本较少。' as compressed,
 '模型一' || {K} || '。|模型二。|该模型三。|该机制四。' as varied, '本研究围绕流程' || {K} || '展开分析。|同时，样本较少。|案例较多。' as opening, '样本' || {K} || '较少。' as bare from orders""")
def q_repair_paragraphs(spark, sf_dir):
    k = F.col("k").cast("string")
    supplement, flow, one, other = (repairs.on_sentences(f) for f in (repairs.supplement_merged, repairs.flowing, repairs.subjects_compressed, repairs.subjects_varied))
    topic = said("本研究围绕流程", "#", "展开分析。")
    return orders(spark, sf_dir).select(
        "k", joined(supplement(F.array(F.lit("甲。"), said("样本", "#", "较少。"), F.lit("这一点需要说明。"), F.lit("乙。")))).alias("supplement"),
        joined(flow(F.array(said("系统包括两步", "#", "，第一，采集样本，进而第二，完成标注。")))).alias("steps"),
        joined(one(F.array(said("系统采集", "#", "。"), F.lit("系统完成标注。"), F.lit("样本较少。")))).alias("compressed"),
        joined(other(F.array(said("模型一", "#", "。"), F.lit("模型二。"), F.lit("模型三。"), F.lit("模型四。")))).alias("varied"),
        joined(repairs.opening_repair(F.array(topic, F.lit("样本较少。")), F.array(F.lit("同时，样本较少。"), F.lit("案例较多。")))).alias("opening"),
        joined(repairs.opening_repair(F.array(F.concat(F.lit("样本"), k, F.lit("很少。"))), F.array(F.concat(F.lit("此外，样本"), k, F.lit("较少。"))))).alias("bare"),
    )


@query(f"""select o_orderkey as k, case o_orderkey % 4 when 0 then '源' when 1 then '源' when 2 then '占 5%。' else '样本' || {K} || '。' end as kept from orders""")
def q_block_surface(spark, sf_dir):
    """A block that adds background, a first person or a percentage goes back to its source."""
    i = F.col("k") % 4
    source = F.when(i == 2, "占 5%。").otherwise("源")
    revised = F.when(i == 0, "普认为源，绝大多数如此").when(i == 1, "我们的源").when(i == 2, "占 5%，另有 7%。").otherwise(said("样本", "#", "。"))
    return orders(spark, sf_dir).select("k", repairs.block_surface(source, revised).alias("kept"))


@query(expected(
    "t_a, t_b", "'能够同时兼顾甲#，能够同时兼顾乙，比较适合用来丙，进行特征提取', '兼顾甲#，兼顾乙，适用于丙，提取特征'", "'系统用于甲#，分析乙', '系统是用来甲#，进行分析乙'", "'这个模型甲#，这个模型乙，该模型丙', '该模型甲#，该模型乙，该模型丙'",
))
def q_fit_target(spark, sf_dir):
    """Bounded replacements towards a target's style: clauses at most 4, function words at most 3, texture at most 2."""
    s = F.replace(case("兼顾甲#，兼顾乙，适用于丙，提取特征", "系统用于甲#，分析乙", "该模型甲#，该模型乙，该模型丙"), F.lit("#"), F.col("k").cast("string"))
    i = F.col("k") % 3
    return orders(spark, sf_dir).select(
        "k", F.when(i == 0, repairs.fitted("expand_clauses")(s)).when(i == 1, repairs.fitted("expand_clauses")(s)).otherwise(repairs.fitted("mild_texture")(s)).alias("t_a"),
        F.when(i == 1, repairs.fitted("function_words")(s)).otherwise(s).alias("t_b"),
    )


@query(expected("grammar, gap, gap_l2", "0.5e0, 0.35e0, 0.45e0", "0.0e0, 0.35e0, 0.45e0", "0.3333e0, 0.35e0, 0.45e0"))
def q_target_alignment(spark, sf_dir):
    s = sentences(case("样本的的较少。乙。", "样本较少。", "甲，，乙。丙。丁。"))

    def dist(length: float, words: float, explained: float, native: float):
        return F.struct(F.lit(length).alias("avg_length"), F.lit(words).alias("function_words"), F.lit(explained).alias("explanatory"), F.lit(native).alias("native"))

    own, target = dist(30.0, 0.5, 0.2, 0.6), dist(38.0, 0.4, 0.35, 0.7)
    return orders(spark, sf_dir).select(
        "k", repairs.grammar_rate(s).alias("grammar"), F.round(repairs.paragraph_gap(own, target, F.lit("method_mechanism")), 6).alias("gap"), F.round(repairs.paragraph_gap(own, target, F.lit("abstract_prose")), 6).alias("gap_l2")
    )


@query(expected("t_body, paragraphs", "'正文#。', 1", "'正文#。' || chr(10) || '第二段，较长的中文说明内容保存在 out/x.pth 中。', 1", "'', 0", "'甲#。' || chr(10) || '乙。', 2"))
def q_body_lines(spark, sf_dir):
    text = F.replace(case(
        "# 标题\n\n正文#。\n![图](a.png)\n- 项\n> 引\n| a | b |\n[1] Smith\n图 1 流程", "正文#。\n第二段，较长的中文说明内容保存在 out/x.pth 中。\nout/y.pth", "## 仅标题#\n\n---", "甲#。\n\n乙。",
    ), F.lit("#"), F.col("k").cast("string"))
    text = F.when(F.col("k") % 4 == 2, "## 仅标题\n\n---").when(F.col("k") % 4 == 0, F.concat(F.lit("# 标题\n\n正文"), F.col("k").cast("string"), F.lit("。\n![图](a.png)\n- 项\n> 引\n| a | b |\n[1] Smith\n图 1 流程"))).when(
        F.col("k") % 4 == 1, F.concat(F.lit("正文"), F.col("k").cast("string"), F.lit("。\n第二段，较长的中文说明内容保存在 out/x.pth 中。\nout/y.pth"))).otherwise(F.concat(F.lit("甲"), F.col("k").cast("string"), F.lit("。\n\n乙。")))
    plain = F.size(align.plain_paragraphs(F.regexp_replace(text, "(?m)^(?:>|\\[1\\]|图 1|---|out/y).*$", "")))
    return orders(spark, sf_dir).select("k", align.body_text(text).alias("t_body"), plain.alias("paragraphs"))


@query(f"""with c as (select o_orderkey as k, cast(o_orderkey % 4 as int) as i, {K} as s from orders)
select k as doc_id, b.block_id, b.original, case i when 0 then case b.block_id when 2 then '新甲' || s || '。' else '新乙。' end when 1 then case b.block_id when 2 then repeat('甲字。', 600) || '新甲' || s || '。' else '新乙。' end
  when 2 then case b.block_id when 2 then '新甲' || s || '。' else b.original end else b.original end as revised, ['chunks', 'paragraphs', 'number', 'kept'][case when i = 2 and b.block_id = 4 then 4 when i = 3 then 4 else i + 1 end] as how
from c, (values (2, '甲。'), (4, '乙。')) as b(block_id, original)""")
def q_block_alignment(spark, sf_dir):
    """By chunks; by paragraphs (one is too long for a chunk); by number; and unchanged."""
    base = orders(spark, sf_dir)
    blocks = base.select(F.col("k").alias("doc_id"), F.inline(F.array(*(F.struct(F.lit(i).alias("block_id"), F.lit(t).alias("text")) for i, t in ((2, "甲。"), (4, "乙。"))))))
    s = F.concat(F.lit("新甲"), F.col("k").cast("string"), F.lit("。"))
    text = (
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("# 题\n\n"), s, F.lit("\n\n新乙。"))).when(F.col("k") % 4 == 1, F.concat(F.repeat(F.lit("甲字。"), 600), s, F.lit("\n\n新乙。")))
        .when(F.col("k") % 4 == 2, F.concat(F.lit("# 题\n\n"), s)).otherwise("")
    )
    out = align.pair_blocks(blocks, base.select(F.col("k").alias("doc_id"), text.alias("text")))
    return out.select("doc_id", "block_id", "original", "revised", "how")


@query(expected("anchors, kept, best", "'本研究,模型', true, '乙模型采用融合。'", "'系统', true, '甲系统较快。'", "'', true, '甲系统较快。'", "'方法,ResNet50', false, '乙模型采用融合。'"))
def q_topic_anchors(spark, sf_dir):
    old, new = case("本研究提出模型。", "系统较快。", "样本较少。", "方法采用 ResNet50。"), case("该模型由本研究提出。", "系统更快。", "样本很少。", "样本较少。")
    best = align.best_source(case("乙模型采用了融合。", "甲系统更快。", "甲系统较快", "乙模型采用融合"), F.array(F.lit("甲系统较快。"), F.lit("乙模型采用融合。")), (F.col("k") % 2).cast("int"))
    return orders(spark, sf_dir).select("k", F.array_join(align.anchors(old), ",").alias("anchors"), align.topic_kept(old, new, F.lit(0.5)).alias("kept"), best.alias("best"))


# ---- guidance
@query(expected(
    "roles, authorial, evidence, naturalization",
    "'preserve_enumeration_item_role,repair_enumeration_flow,avoid_huanbaokuo_style_expansion', '', '', ''",
    "'restore_mechanism_sentence_from_support_like_rewrite,prevent_appendix_like_supporting_sentence,replace_abstracted_subject_with_concrete_referent', 'upgrade_appendix_like_sentence_to_assertion,strengthen_mechanism_verb,replace_weak_modal_verbs,promote_support_sentence_to_core_if_needed', 'restore_mechanism_sentence_to_academic_statement,replace_we_with_original_subject_style,downgrade_overclaimed_judgment', ''",
    "'', 'restore_authorial_choice_expression,reduce_overuse_of_passive_explanations', 'remove_unsupported_expansion,remove_external_domain_commentary,remove_metaphoric_storytelling', ''",
    "'preserve_enumeration_item_role,preserve_semantic_role_of_core_sentence', 'restore_authorial_choice_expression,promote_support_sentence_to_core_if_needed', 'restore_thesis_register,preserve_original_evidence_scope', 'remove_bureaucratic_opening,convert_project_style_opening_to_academic_statement,decompress_overpacked_modifier_prefix,enforce_direct_statement,move_main_clause_forward,remove_slogan_like_goal_phrase,replace_theme_is_with_direct_topic_statement,remove_academic_wrapping,reduce_connectors'",
))
def q_recommended_actions(spark, sf_dir):
    """An enumeration; a mechanism; a stance with outside opinion; a chapter summary with project wording."""
    text = case("甲、乙、丙较多。", "系统通过接口输出。", "重点并非速度，普遍认为如此。", "在方法上，旨在提速，并且稳定。")
    kind, chapter, high = case("narrative", "narrative", "narrative", "chapter_summary"), F.lit("experiment_design"), F.lit(False)
    return orders(spark, sf_dir).select(
        "k", F.array_join(guidance.role_actions(text, kind, chapter, high), ",").alias("roles"), F.array_join(guidance.authorial_actions(text, kind, chapter, high), ",").alias("authorial"),
        F.array_join(guidance.evidence_actions(text, kind, chapter, high), ",").alias("evidence"), F.array_join(guidance.naturalization_actions(text, chapter, high), ",").alias("naturalization"),
    )


@query(expected("sensitive, keep_subject", "true, false", "true, false", "true, false", "true, false", "false, true", "true, false", "false, false"))
def q_sensitive_prose(spark, sf_dir):
    """By type, by title, by chapter, by a review of three sentences, by none (but a checkpoint), by its words, by none."""
    text = case("甲。", "甲。", "甲。", "甲。乙。丙。", "模型默认运行于本地 checkpoint。", "综上，有效。", "甲。乙。")
    kind, title = case("conclusion", *["narrative"] * 6), case("一", "本章 小结", *["一"] * 5)
    chapter = case("method_design", "method_design", "significance", "literature_review", "method_design", "method_design", "result_analysis")
    return orders(spark, sf_dir).select("k", guidance.sensitive(text, kind, chapter, title).alias("sensitive"), guidance.keep_subject(text).alias("keep_subject"))


@query(expected(
    "policy, type, depth, n_actions, heavy",
    "'rewritable', 'narrative', 'developmental_rewrite', 10, true", "'light_edit', 'light_edit_narration', 'light_edit', 5, true", "'rewritable', 'narrative', 'developmental_rewrite', 5, true", "'high_risk', 'x', 'y', 5, true", "'light_edit', 'light_edit_narration', 'light_edit', 6, false",
    "'high_risk', 'x', 'y', 1, true",
))
def q_chapter_override(spark, sf_dir):
    """High; medium and dense; medium and plain; medium with a high-risk block; conservative (heavy actions go); high but with a path."""
    policy = case("light_edit", "rewritable", "rewritable", "high_risk", "rewritable", "high_risk")
    priority = case("high", "medium", "medium", "medium", "conservative", "high")
    i = F.col("k") % 6
    first = F.when(i.isin(4, 5), F.array(F.lit("discourse_reordering"))).when(i == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("y")))
    out = guidance.chapter_override(policy, F.lit("x"), F.lit("y"), first, priority, F.lit(1), i == 1, i == 5)
    return orders(spark, sf_dir).select("k", out.alias("o")).select("k", F.col("o.edit_policy").alias("policy"), F.col("o.block_type").alias("type"), F.col("o.rewrite_depth").alias("depth"), F.size("o.actions").alias("n_actions"), guidance.heavy(F.col("o.actions")).alias("heavy"))


@query(f"""with c as (select o_orderkey as k, {sql_bit(0)} as long_, case when {sql_bit(1)} then 'light_edit' else 'rewritable' end as pol, ['high', 'medium', 'conservative'][o_orderkey % 3 + 1] as pri, o_orderkey % 4 as n from orders),
d as (select *, long_ and pri = 'medium' and pol = 'light_edit' as raised, case when pol = 'rewritable' then 'developmental_rewrite' else 'light_edit' end as dep from c),
e as (select *, case when raised then 'developmental_rewrite' else dep end as dep2 from d)
select k, case when raised then 'rewritable' else pol end as policy, dep2 as depth,
 case when not long_ then null when pri = 'conservative' then 'light' when pri = 'medium' and dep2 = 'developmental_rewrite' then 'medium' when dep = 'developmental_rewrite' then 'high' else 'medium' end as intensity,
 case when not long_ or pri = 'conservative' then 1 when dep2 = 'developmental_rewrite' then 2 else 1 end as min_sentences, case when not long_ then 0 when pri = 'conservative' then 0 when dep2 = 'developmental_rewrite' and pri <> 'medium' then 1 else 0 end as min_clusters,
 case when not long_ then 'sentence_cluster_merge' when pri = 'conservative' then '' when dep2 = 'developmental_rewrite' and n >= 2 then 'sentence_cluster_merge,pair_fusion' else 'sentence_cluster_merge' end as structural,
 case when not long_ then 'narrative_path_rewrite' when pri = 'conservative' then '' when dep2 = 'developmental_rewrite' then 'narrative_path_rewrite,sentence_cluster_rewrite,sentence_cluster_merge,discourse_reordering,uneven_rewrite_distribution,proposition_reorder'
  else 'narrative_path_rewrite,sentence_level_recast' end as discourse from e""")
def q_scale_pressure(spark, sf_dir):
    k = F.col("k")
    policy = F.when(bit(1), "light_edit").otherwise("rewritable")
    depth = F.when(bit(1), "light_edit").otherwise("developmental_rewrite")
    out = guidance.pressure(
        F.when(bit(0), "long").otherwise("medium"), policy, F.lit("narrative"), depth, F.element_at(F.array(*map(F.lit, ("high", "medium", "conservative"))), (k % 3 + 1).cast("int")), guidance.none(),
        F.array(F.lit("sentence_cluster_merge")), F.array(F.lit("narrative_path_rewrite")), k % 4, F.lit(1), F.lit(0),
    )
    return orders(spark, sf_dir).select("k", out.alias("o")).select(
        "k", F.col("o.edit_policy").alias("policy"), F.col("o.rewrite_depth").alias("depth"), F.col("o.intensity").alias("intensity"), F.col("o.min_sentence_changes").alias("min_sentences"),
        F.col("o.min_cluster_changes").alias("min_clusters"), F.array_join("o.structural", ",").alias("structural"), F.array_join("o.discourse", ",").alias("discourse"),
    )


@query(expected(
    "t_notes", "'Block # is heading; keep it verbatim.'", "'Block # is high risk; keep its wording unless its format is broken.'", "'Block # is light_edit with light intensity: patterns [partial_keep, soften], at least 1 sentence change.|Block # opens with its topic sentence; keep it first.'",
    "'Block # is developmental_rewrite with high intensity: patterns [partial_keep, soften], actions [meta_compression].|Block # is sensitive prose; reading well comes first.'",
))
def q_agent_notes(spark, sf_dir):
    i = F.col("k") % 4
    out = guidance.notes(
        F.col("k"), F.lit("heading"), case("do_not_touch", "high_risk", "light_edit", "rewritable"), case("light", "light", "light", "high"), F.array(F.lit("partial_keep"), F.lit("soften")), F.array(F.lit("meta_compression")),
        F.lit(1), i == 3, i == 2,
    )
    return orders(spark, sf_dir).select("k", joined(out).alias("t_notes"))


@query("select doc_id, text as rebuilt from documents")
def q_lossless_chunks(spark, sf_dir):
    """Every document from its chunks, byte for byte."""
    from .plans import guide

    parts = guide.parts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    whole = F.array_sort(F.collect_list(F.struct("block_id", "part", F.concat("before", "text").alias("x"))))  # a document's own parts
    return parts.groupBy("_row", "doc_id").agg(whole.alias("p")).select("doc_id", F.array_join(F.col("p.x"), "").alias("rebuilt"))


@query(None)
def q_repair_readability(spark, sf_dir):
    """Paragraphs of the revision corpus with their hanging sentences repaired from the source."""
    from . import corpus

    df = corpus.blocks(spark, sf_dir).select("block_key", sentences(F.col("text")).alias("a"), sentences(F.col("revised")).alias("b"))
    return df.select("block_key", joined(repairs.readability_repair(F.col("a"), F.col("b"))).alias("repaired"))


@query(None)
def q_guide_actions(spark, sf_dir):
    """Guidance of the revision corpus: sensitivity, what the chapter makes of each block, and what is recommended."""
    from .catalog import chaptered

    from .operators import blocks as B

    df = guidance.guide_actions(B.policy(chaptered(spark, sf_dir).drop("sensitive")))
    return df.select("block_key", "sensitive", "edit_policy", "block_type", "rewrite_depth", F.array_join("recommended", ",").alias("recommended"), F.array_join("forbidden", ",").alias("forbidden"))

