"""Guidance of a block: sensitivity, the chapter's say, the pressure of long documents, the actions that are recommended, and notes.

Actions are tables of (condition, actions): a block's list is the actions of all
conditions that hold, in order and once.  All JVM expressions over the columns
text, block_type, edit_policy, rewrite_depth, chapter_type, chapter_title,
chapter_priority, chapter_id and what operators.blocks.policy adds.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, sentences, squeeze
from ..operators.frames import KEEP_SUBJECT

# Patterns and actions.
SENSITIVE_TYPES = ("abstract_zh", "research_significance", "innovation_points", "conclusion", "future_work", "chapter_summary")
SENSITIVE_TITLE, SENSITIVE_TEXT = r"摘要|研究意义|创新|总结|结论|展望|本章小结", r"研究意义|创新点|总结而言|综上|未来工作|本文完成|本研究的核心价值"
SENSITIVE_CHAPTERS, SENSITIVE_LONG = ("significance", "conclusion", "future_work"), ("literature_review", "result_analysis")
MECHANISMS = ("mechanism_explanation", "method_design", "training_strategy", "system_workflow")
CLOSING = ("innovation_points", "chapter_summary", "conclusion")
ENUMERATED = r"[^，。；]+(?:、[^，。；]+){2,}|^(?:[（(]?\d+[）)]|第一|第二|第三)"
SAYS_HOW = r"(?:模型|系统|模块|分支|接口|机制|路径|损失函数|课程学习|判别机制).*(?:采用|通过|将|把|用于|负责|生成|输出|融合|提取|建模|约束|对外提供|保留|剥离|实施|构成|形成)"
SAYS_USE = r"(?:模型|系统|模块|分支|接口|机制|路径|课程学习|判别机制|训练).*(?:用于|可以|能够|有助于|通过)"
SAYS_DOES = r"(?:模型|系统|模块|分支|接口|机制|课程学习|判别机制).*(?:通过|将|把|负责|实现|约束)"
STANCE = r"相比之下|并非|而是|更关键的是|关键在于|核心在于|选择.+而非.+"
OUTSIDE = r"主流观点|业界通常认为|普遍认为|超过八成|超过半数|绝大多数|如同|仿佛|终于摆脱"
PROJECT_OPENING = r"本研究面向.+需求|本研究的主题为|在方法上|围绕这一目标|在.+目标下|在完成.+后|在.+层面|具体而言|从.+角度|就.+而言|在.+过程中"
SLOGAN = r"旨在构建|旨在|以实现.+落地|从而实现|形成完整闭环|具有显著.+价值|提供清晰方法论路径|提供.+基础|形成.+体系|提供.+路径"
PARALLEL, CONNECTOR, PASSIVE = r"并不是.+而是|不仅.+(?:同时|还)|在结构上.+在决策层面|第一.+进而第二", r"并且|从而|进而|同时", r"被视为|属于|得到体现"
WRAPPED = r"进行(?:评估|分析|验证|控制|处理)|实现(?:控制|部署|融合|落地)|提供(?:支撑|支持)"
NARRATIVE = ("background", "significance", "literature_review", "conclusion", "future_work")

REALISM = {
    "light_edit": "soften_overexplicit_transition light_partial_retain_with_local_rephrase paragraph_readability_smoothing de_template_academic_cliche soft_keep_for_human_revision_feel",
    "developmental_rewrite": "soften_overexplicit_transition reduce_sentence_uniformity introduce_local_hierarchy reshape_supporting_sentence weaken_overfinished_sentence convert_flat_parallel_flow "
    "light_partial_retain_with_local_rephrase paragraph_readability_smoothing vary_support_sentence_texture de_template_academic_cliche retain_some_plain_sentences avoid_overpolished_supporting_sentence "
    "introduce_mild_authorial_asymmetry deuniform_paragraph_texture rephrase_summary_like_sentence_without_cliche soft_keep_for_human_revision_feel",
}
HEAVY = (
    "chapter_high_priority_rewrite", "sentence_cluster_rewrite", "sentence_cluster_merge", "sentence_cluster_split", "narrative_flow_rebuilder", "discourse_reordering", "narrative_path_rewrite",
    "proposition_reorder", "conclusion_absorption", "merge_or_split_sentence_cluster",
)
CHAPTER_ACTIONS = {
    "high": "chapter_high_priority_rewrite sentence_cluster_rewrite narrative_flow_rebuilder meta_compression subject_chain_compression sentence_cluster_merge discourse_reordering narrative_path_rewrite conclusion_absorption",
    "medium": "chapter_medium_priority_rewrite sentence_cluster_rewrite weaken_template_connectors compress_subject_chain",
    "conservative": "chapter_conservative_light_edit partial_keep compress_subject_chain compress_meta_discourse weaken_template_connectors keep_original_if_technical_density_is_high",
}
PRESSED = {
    "medium_light": "chapter_medium_long_document_developmental_rewrite sentence_cluster_rewrite narrative_path_rewrite keep_original_if_technical_density_is_high",
    "developmental": "sentence_cluster_rewrite narrative_flow_rebuilder sentence_cluster_merge discourse_reordering narrative_path_rewrite uneven_rewrite_distribution proposition_reorder transition_absorption",
    "developmental_discourse": "sentence_cluster_rewrite sentence_cluster_merge discourse_reordering narrative_path_rewrite uneven_rewrite_distribution proposition_reorder",
    "light": "sentence_level_recast light_clause_reorder",
}
UNCLUSTERED_DISCOURSE = ("sentence_cluster_rewrite", "sentence_cluster_merge", "sentence_cluster_split", "proposition_reorder", "discourse_reordering", "narrative_path_rewrite", "conclusion_absorption")
UNCLUSTERED_STRUCTURE = ("pair_fusion", "sentence_cluster_merge", "sentence_cluster_split")
PRECONDITIONS = (
    "Core content and format checks all pass.", "Body coverage, changed-block ratio, discourse and cluster scores meet the quota of the document's scale.",
    "Chapters of high priority are rewritten, conservative ones are not rewritten over much.", "Topic sentences stay at the opening, and no paragraph opens with a dangling transition.",
    "Transitions are natural, paragraphs are not flat, sentences are not uniform.", "Nothing unsupported, metaphoric or in the first person is added.", "No support or conclusion sentence is a fragment.",
    "Every editable block satisfies its required actions and minima.", "At least one structural action of high value is present.",
)
DOCTRINE = (
    "Change narration, sentence organisation and paragraph flow only; keep facts, claims, terms, citations, numbers, formulas, captions, placeholders and Markdown.",
    "Rewrite ordinary body prose as an academic editor would rebuild it; do not merely replace words or openers.", "Delete, absorb or merge template wording; do not replace it with another template.",
    "Allocate effort by chapter: open up narrative chapters, keep technical ones controlled.", "Keep topic sentences at the opening.", "Revise unevenly, as people do.", "Keep the tone academic and restrained.",
)
DOCTRINE_L2 = ("Allow mildly more function words and explanatory phrasing; never broken grammar, colloquial wording or unsupported facts.", "Leave blocks dense in formulas, paths, citations and definitions alone.")
FORBIDDEN = {
    "sensitive": "do_not_leave_fragment_like_support_sentences do_not_leave_dangling_conclusion_sentences do_not_uniformly_polish_every_sentence",
    "roles": "do_not_replace_concrete_subject_with_abstract_scaffolding do_not_turn_enumeration_items_into_appendix_like_support",
    "authorial": "do_not_weaken_mechanism_assertions_into_appendix_like_support do_not_remove_source_contrast_or_choice_markers_without_replacement",
    "evidence": "do_not_add_external_background_or_statistics do_not_turn_thesis_prose_into_commentary_or_storytelling do_not_switch_to_first_person_without_source_support",
    "naturalization": "do_not_replace_direct_thesis_sentences_with_project_report_openings do_not_use_slogan_like_goal_phrasing_for_ordinary_thesis_prose",
    "l2": "do_not_make_l2_profile_colloquial do_not_create_ungrammatical_l2_errors do_not_add_external_facts_for_l2_texture",
    "opening": "do_not_move_topic_sentence_from_paragraph_start do_not_absorb_topic_sentence_into_later_sentence",
}
L2_ACTIONS = "expand_compact_academic_clause increase_function_word_density_mildly soften_native_like_concision allow_explanatory_rephrasing inject_mild_l2_texture avoid_too_fluent_native_polish"


def names(words: str) -> Column:
    return F.array(*map(F.lit, words.split()))


def none() -> Column:
    return F.array().cast("array<string>")


def listed(*rows: tuple[Column, str]) -> Column:
    """Actions of all conditions that hold, in order and once."""
    return F.array_distinct(F.concat(*[F.when(on, names(words)).otherwise(none()) for on, words in rows]))


def keep_subject(text: Column) -> Column:
    """What is named must stay named: paths, checkpoints, what runs where."""
    return contains_any(text, KEEP_SUBJECT)


def sensitive(text: Column, block_type: Column, chapter_type: Column, chapter_title: Column) -> Column:
    """Prose where reading well comes before rewriting much."""
    return (
        block_type.isin(*SENSITIVE_TYPES) | squeeze(F.coalesce(chapter_title, F.lit(""))).rlike(SENSITIVE_TITLE) | chapter_type.isin(*SENSITIVE_CHAPTERS)
        | (chapter_type.isin(*SENSITIVE_LONG) & (F.size(sentences(text)) >= 3)) | text.rlike(SENSITIVE_TEXT)
    )


def realism_actions(depth: Column) -> Column:
    return F.when(depth == "light_edit", names(REALISM["light_edit"])).when(depth == "developmental_rewrite", names(REALISM["developmental_rewrite"])).otherwise(none())


def role_actions(text: Column, block_type: Column, chapter_type: Column, high: Column) -> Column:
    return listed(
        (high, "preserve_semantic_role_of_core_sentence remove_generated_scaffolding_phrase replace_abstracted_subject_with_concrete_referent avoid_huanbaokuo_style_expansion"),
        (text.rlike(ENUMERATED), "preserve_enumeration_item_role repair_enumeration_flow avoid_huanbaokuo_style_expansion"),
        (chapter_type.isin(*MECHANISMS) | text.rlike(SAYS_HOW), "restore_mechanism_sentence_from_support_like_rewrite prevent_appendix_like_supporting_sentence replace_abstracted_subject_with_concrete_referent"),
        (block_type.isin(*CLOSING[:2]), "preserve_enumeration_item_role preserve_semantic_role_of_core_sentence"),
    )


def authorial_actions(text: Column, block_type: Column, chapter_type: Column, high: Column) -> Column:
    return listed(
        (high, "upgrade_appendix_like_sentence_to_assertion replace_weak_modal_verbs restore_authorial_choice_expression reduce_overuse_of_passive_explanations"),
        (chapter_type.isin(*MECHANISMS) | text.rlike(SAYS_USE), "upgrade_appendix_like_sentence_to_assertion strengthen_mechanism_verb replace_weak_modal_verbs promote_support_sentence_to_core_if_needed"),
        (text.rlike(STANCE), "restore_authorial_choice_expression reduce_overuse_of_passive_explanations"),
        (block_type.isin(*CLOSING), "restore_authorial_choice_expression promote_support_sentence_to_core_if_needed"),
    )


def evidence_actions(text: Column, block_type: Column, chapter_type: Column, high: Column) -> Column:
    return listed(
        (high, "remove_unsupported_expansion remove_external_domain_commentary remove_metaphoric_storytelling restore_thesis_register replace_we_with_original_subject_style downgrade_overclaimed_judgment preserve_original_evidence_scope"),
        (block_type.isin(*CLOSING), "restore_thesis_register preserve_original_evidence_scope"),
        (chapter_type.isin("mechanism_explanation", "result_analysis", "conclusion", "future_work", "training_strategy") | text.rlike(SAYS_DOES), "restore_mechanism_sentence_to_academic_statement replace_we_with_original_subject_style downgrade_overclaimed_judgment"),
        (text.rlike(OUTSIDE), "remove_unsupported_expansion remove_external_domain_commentary remove_metaphoric_storytelling"),
    )


def naturalization_actions(text: Column, chapter_type: Column, high: Column) -> Column:
    return listed(
        (high, "remove_bureaucratic_opening compress_explicit_subject_chain flatten_overstructured_parallelism advance_main_clause remove_slogan_like_goal_phrase convert_project_style_opening_to_academic_statement enforce_direct_statement "
         "remove_academic_wrapping reduce_connectors convert_passive_to_active split_overlong_sentence diversify_subject"),
        (text.rlike(PROJECT_OPENING), "remove_bureaucratic_opening convert_project_style_opening_to_academic_statement decompress_overpacked_modifier_prefix enforce_direct_statement move_main_clause_forward"),
        (text.rlike(SLOGAN), "remove_slogan_like_goal_phrase replace_theme_is_with_direct_topic_statement remove_academic_wrapping"),
        (text.rlike(PARALLEL), "flatten_overstructured_parallelism denormalize_parallel_structure"), (text.rlike(CONNECTOR), "reduce_connectors"), (text.rlike(PASSIVE), "convert_passive_to_active"),
        (text.rlike(WRAPPED), "remove_academic_wrapping"), (F.length(squeeze(text)) > 110, "split_overlong_sentence"),
        (chapter_type.isin(*NARRATIVE), "compress_explicit_subject_chain replace_theme_is_with_direct_topic_statement diversify_subject"),
    )


def chapter_override(policy: Column, block_type: Column, depth: Column, actions: Column, priority: Column, chapter_id: Column, dense: Column, path: Column) -> Column:
    """struct<edit_policy, block_type, rewrite_depth, actions>: what the chapter makes of a body block. dense: citations, numbers or terms are; path: it names one."""
    technical = dense | path
    open_ = (priority == "high") & (chapter_id > 0) & ~path
    medium, mild = (priority == "medium"), (priority == "medium") & (policy != "high_risk") & ~path
    careful = priority == "conservative"
    softened = F.when(policy == "light_edit", "light_edit").when(technical, "light_edit").otherwise("rewritable")
    new = F.when(open_, "rewritable").when(mild, softened).when(careful, "light_edit").otherwise(policy)
    touched = open_ | mild | careful
    more = F.when(open_, names(CHAPTER_ACTIONS["high"])).when(medium, names(CHAPTER_ACTIONS["medium"])).when(careful, names(CHAPTER_ACTIONS["conservative"])).otherwise(none())
    kept = F.when(careful, F.array_except(actions, F.array(*map(F.lit, HEAVY)))).otherwise(actions)
    return F.struct(
        new.alias("edit_policy"), F.when(touched, F.when(new == "rewritable", "narrative").otherwise("light_edit_narration")).otherwise(block_type).alias("block_type"),
        F.when(touched, F.when(new == "rewritable", "developmental_rewrite").otherwise("light_edit")).otherwise(depth).alias("rewrite_depth"), F.array_distinct(F.concat(kept, more)).alias("actions"),
    )


def heavy(actions: Column) -> Column:
    """Whether a block was rewritten over much for a conservative chapter."""
    return F.arrays_overlap(actions, F.array(*map(F.lit, HEAVY)))


def pressure(scale: Column, policy: Column, block_type: Column, depth: Column, priority: Column, recommended: Column, structural: Column, discourse: Column, n_sentences: Column, min_sentence: Column, min_cluster: Column) -> Column:
    """struct of what a long document makes of a body block: policy, depth, intensity, actions and minima."""
    on = scale.isin("long", "very_long") & policy.isin("light_edit", "rewritable")
    raised = on & (priority == "medium") & (policy == "light_edit")
    policy_, type_, depth_ = F.when(raised, "rewritable").otherwise(policy), F.when(raised, "narrative").otherwise(block_type), F.when(raised, "developmental_rewrite").otherwise(depth)
    careful, dev = priority == "conservative", depth_ == "developmental_rewrite"
    intensity = F.when(careful, "light").when((priority == "medium") & dev, "medium").when(depth == "developmental_rewrite", "high").otherwise("medium")
    first = F.when(raised, names(PRESSED["medium_light"])).otherwise(none())
    then = F.when(careful, names(CHAPTER_ACTIONS["conservative"])).when(dev, F.concat(names(PRESSED["developmental"]), names(REALISM["developmental_rewrite"]))).otherwise(F.concat(names(PRESSED["light"]), names(REALISM["light_edit"])))
    said = F.when(careful, F.array_except(discourse, F.array(*map(F.lit, UNCLUSTERED_DISCOURSE)))).when(dev, F.array_distinct(F.concat(discourse, names(PRESSED["developmental_discourse"]))))
    said = said.otherwise(F.array_distinct(F.concat(discourse, names("sentence_level_recast"))))
    built = F.when(careful, F.array_except(structural, F.array(*map(F.lit, UNCLUSTERED_STRUCTURE)))).when(dev & (n_sentences >= 2), F.array_distinct(F.concat(structural, names("pair_fusion")))).otherwise(structural)
    least = F.when(careful, min_sentence).when(dev, F.greatest(min_sentence, F.lit(2))).otherwise(F.greatest(min_sentence, F.lit(1)))
    clusters = F.when(careful, 0).when(dev & (priority != "medium"), F.greatest(min_cluster, F.lit(1))).otherwise(min_cluster)

    def either(new: Column, old: Column) -> Column:
        return F.when(on, new).otherwise(old)

    return F.struct(
        either(policy_, policy).alias("edit_policy"), either(type_, block_type).alias("block_type"), either(depth_, depth).alias("rewrite_depth"), F.when(on, intensity).alias("intensity"),
        either(F.array_distinct(F.concat(recommended, first, then)), recommended).alias("recommended"), either(built, structural).alias("structural"), either(said, discourse).alias("discourse"),
        either(least, min_sentence).alias("min_sentence_changes"), either(clusters, min_cluster).alias("min_cluster_changes"),
    )


def forbidden(high: Column, *families: tuple[str, Column]) -> Column:
    """What a block's agent must not do, for the families of actions that it has."""
    return listed((high, FORBIDDEN["sensitive"]), *[(on, FORBIDDEN[k]) for k, on in families])


def notes(block_id: Column, block_type: Column, policy: Column, intensity: Column, patterns: Column, discourse: Column, minimum: Column, high: Column, locked: Column) -> Column:
    """Notes on one block, for who revises it."""
    at = F.concat(F.lit("Block "), block_id.cast("string"))
    said = F.array_join(patterns, ", ")
    return F.array_compact(F.array(
        F.when(policy == "do_not_touch", F.concat(at, F.lit(" is "), block_type, F.lit("; keep it verbatim.")))
        .when(policy == "high_risk", F.concat(at, F.lit(" is high risk; keep its wording unless its format is broken.")))
        .when(policy == "light_edit", F.concat(at, F.lit(" is light_edit with "), intensity, F.lit(" intensity: patterns ["), said, F.lit("], at least "), minimum.cast("string"), F.lit(" sentence change.")))
        .otherwise(F.concat(at, F.lit(" is developmental_rewrite with "), intensity, F.lit(" intensity: patterns ["), said, F.lit("], actions ["), F.array_join(discourse, ", "), F.lit("]."))),
        F.when(policy.isin("light_edit", "rewritable") & locked, F.concat(at, F.lit(" opens with its topic sentence; keep it first."))),
        F.when(policy.isin("light_edit", "rewritable") & high, F.concat(at, F.lit(" is sensitive prose; reading well comes first."))),
    ))


def doctrine(style: str = "academic_natural") -> tuple[str, ...]:
    """The principles of a style."""
    known = {"academic_natural": DOCTRINE, "academic_natural_studentlike": DOCTRINE, "zh_academic_l2_mild": (*DOCTRINE, *DOCTRINE_L2)}
    try:
        return known[(style or "academic_natural").strip().lower()]
    except KeyError:
        raise ValueError(f"unknown style {style!r}; known: {', '.join(sorted(known))}") from None


def guide_actions(blocks: DataFrame) -> DataFrame:
    """Adds sensitive, recommended (by all five families and the chapter) and forbidden to blocks with policy and chapter columns."""
    t, kind, chapter, title = (F.col(c) for c in ("text", "block_type", "chapter_type", "chapter_title"))
    df = blocks.withColumn("sensitive", sensitive(t, kind, chapter, title))
    high = F.col("sensitive")
    families = {"roles": role_actions(t, kind, chapter, high), "authorial": authorial_actions(t, kind, chapter, high), "evidence": evidence_actions(t, kind, chapter, high), "naturalization": naturalization_actions(t, chapter, high)}
    df = df.withColumns({f"_{k}": c for k, c in families.items()})
    body = F.col("edit_policy").isin("light_edit", "rewritable")
    every = F.concat(realism_actions(F.col("rewrite_depth")), F.when(high, names("readability_repair_pass sentence_completeness_repair")).otherwise(none()), *[F.col(f"_{k}") for k in families])
    dense = (F.col("n_citations") >= 2) | (F.col("n_numbers") >= 3) | (F.col("n_terms") >= 4)
    over = chapter_override(F.col("edit_policy"), kind, F.col("rewrite_depth"), F.array_distinct(every), F.col("chapter_priority"), F.col("chapter_id"), dense, F.col("has_path"))
    df = df.withColumn("_over", over).withColumn("forbidden", F.when(body, forbidden(high, *[(k, F.size(F.col(f"_{k}")) > 0) for k in families])).otherwise(none()))
    fields = ("edit_policy", "block_type", "rewrite_depth")
    df = df.withColumns({**{f"_{f}": F.when(body, F.col(f"_over.{f}")).otherwise(F.col(f)) for f in fields}, "recommended": F.when(body, F.col("_over.actions")).otherwise(none())})
    return df.drop(*fields, "_over", *[f"_{k}" for k in families]).withColumnsRenamed({f"_{f}": f for f in fields})


def merged(lists: Iterable[Column]) -> Column:
    return F.array_distinct(F.concat(*lists))


__all__ = ["DOCTRINE", "PRECONDITIONS", "chapter_override", "doctrine", "guide_actions", "heavy", "keep_subject", "notes", "pressure", "sensitive"]
