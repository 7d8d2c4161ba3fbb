"""Quotas, review decisions, the write gate, and the choice among candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config


def body_quota(scale: Column, mode: str, field: str, n_sentences: Column | None = None) -> Column:
    """What a document of this scale must reach; conservative runs owe nothing below long documents."""
    out = F.lit(getattr(config.scale_of("short"), field))
    for s in config.SCALES:
        value = getattr(s, field)
        if mode == "conservative" and s.name not in ("long", "very_long"):
            value = type(value)(0)
        out = F.when(scale == s.name, F.lit(value)).otherwise(out)
    return F.when(n_sentences < 2, F.lit(0)).otherwise(out) if n_sentences is not None else out


def body_metrics(blocks: DataFrame, mode: str = "balanced", id_col: str = "doc_id") -> DataFrame:
    """One row per document from body blocks with statistics: coverage, ratio, scores, quotas and reasons."""
    total = F.greatest(F.col("n_sentences"), F.lit(1))
    on = F.col("changed")
    units = F.least(total, F.greatest(F.lit(1), F.col("sentence_changes"), F.col("cluster_changes")))
    dev = F.col("rewrite_depth") == "developmental_rewrite"
    m = blocks.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("blocks"), F.sum(total).alias("sentences"), F.sum("n_chars").alias("chars"), F.count_if(on).alias("changed_blocks"),
        F.sum(F.when(on, units).otherwise(0)).alias("changed_sentences"), F.sum(F.when(on, F.col("discourse_score")).otherwise(0)).alias("discourse"),
        F.sum(F.when(on, F.col("cluster_changes")).otherwise(0)).alias("cluster"), F.count_if(dev).alias("dev_blocks"), F.count_if(dev & on).alias("dev_changed"),
    )
    from .blocks import scale

    m = m.withColumn("scale", scale(F.col("chars")))
    m = m.withColumns({
        "coverage": F.least(F.lit(1.0), F.col("changed_sentences") / F.col("sentences")), "changed_ratio": F.col("changed_blocks") / F.col("blocks"),
        "need_coverage": body_quota(F.col("scale"), mode, "coverage"), "need_ratio": body_quota(F.col("scale"), mode, "changed_ratio"),
        "need_discourse": body_quota(F.col("scale"), mode, "discourse"), "need_cluster": body_quota(F.col("scale"), mode, "cluster", F.col("sentences")),
    })
    long_ = F.col("scale").isin("long", "very_long")
    reasons = F.array_compact(F.array(
        F.when(F.col("coverage") < F.col("need_coverage"), "body_rewrite_coverage_below_quota"),
        F.when(F.col("changed_ratio") < F.col("need_ratio"), "body_changed_blocks_below_quota"),
        F.when(F.col("discourse") < F.col("need_discourse"), "body_discourse_change_score_below_quota"),
        F.when(F.col("cluster") < F.col("need_cluster"), "body_cluster_rewrite_score_below_quota"),
        F.when(long_ & F.lit(mode == "conservative"), "document_scale_disallows_conservative_fallback"),
        F.when((F.col("scale") == "very_long") & (F.col("dev_blocks") > 0) & (F.col("dev_changed") < 1), "body_developmental_rewrite_missing_for_very_long_document"),
    ))
    return m.withColumns({"reasons": reasons, "quota_met": F.size(reasons) == 0})


def decision(problems: Column, warnings: Column) -> Column:
    return F.when(F.size(problems) > 0, "reject").when(F.size(warnings) > 0, "pass_with_minor_risk").otherwise("pass")


def failed(checks: dict[str, Column]) -> Column:
    """Names of the checks that do not hold, in order."""
    return F.array_compact(F.array(*[F.when(~c, f"{k}_integrity_check_failed") for k, c in checks.items()]))


def gate(reviewed: Column, decision_: Column, codes: Column) -> Column:
    """struct<write_allowed,decision,reason_codes>: unreviewed and rejected first, then whatever code there is."""
    first = F.when(~reviewed, "review_missing").when(decision_ == "reject", "review_rejected")
    all_ = F.array_compact(F.concat(F.array(first), codes))
    return F.struct((F.size(all_) == 0).alias("write_allowed"), F.when(F.size(all_) == 0, decision_).otherwise("reject").alias("decision"), all_.alias("reason_codes"))


def missing_actions(required: Column, done: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """Required actions that neither they nor their aliases fulfil."""
    table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.filter(required, lambda a: ~F.arrays_overlap(F.coalesce(table[a], F.array(a)), done))


def select(candidates: DataFrame, id_col: str = "doc_id", score: str = "score", ordinal: str = "ordinal") -> DataFrame:
    """One candidate a document: gated ones first, then the greatest score, then the earliest.

    A max over an ordering key, so a document with many candidates costs one row per task in the shuffle.
    """
    key = F.struct(F.col("write_allowed").cast("int"), F.col(score), -F.col(ordinal))
    cols = [c for c in candidates.columns if c != id_col]
    return candidates.groupBy(id_col).agg(F.max_by(F.struct(*cols), key).alias("_b")).select(id_col, "_b.*")


def worst_classes(rows: DataFrame, keep: int = 3, id_col: str = "doc_id") -> DataFrame:
    """The classes with the lowest match (then the most paragraphs, then by name) of each document."""
    w = Window.partitionBy(id_col).orderBy("match", F.desc("paragraphs"), "class")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


# The parts of a candidate's score, most important first. Without a mark: whole numbers and flags;
# % hundredths of a share; - counts against (hundredths, or times the factor after *).
PARTS = (
    "write_allowed decision chapter_rewrite_quota_check rewrite_quota_met chapter_policy_consistency_check %evidence_fidelity %semantic_role %target_alignment %class_style_match %style_match -evidence_drift*15 "
    "-terminology_drift*10 -grammar_error_rate %readability %thesis_tone %directness %l2_texture -native_like -l2_colloquial -l2_ungrammatical -connector -subject_monotony -overlong -avg_sentence_length_diff*2 "
    "-clause_diff*20 -main_clause_diff -function_word_diff -helper_verb_diff -explanatory_gap -compactness_gap -native_gap -l2_gap -bureaucratic -repeated_subject -overstructured -delayed_clause -slogan -nominalization "
    "-passive -unsupported -metaphor -authorial_claim %assertion_strength %authorial_stance -appendix %completeness %enumeration paragraph_readability_preserved sentence_completeness_preserved "
    "semantic_role_integrity_preserved enumeration_integrity_preserved assertion_strength_preserved appendix_like_support_controlled authorial_stance_present evidence_fidelity_preserved "
    "unsupported_expansion_controlled thesis_tone_restrained metaphor_or_storytelling_controlled authorial_claim_risk_controlled bureaucratic_opening_controlled explicit_subject_chain_controlled "
    "overstructured_syntax_controlled main_clause_position_reasonable slogan_like_goal_phrase_controlled scaffolding_phrase_density_controlled over_abstracted_subject_risk_controlled -dangling -incomplete_support "
    "-fragment_conclusion -scaffolding -abstract_subject -stylistic_uniformity %texture_variation %voice_variation -cliche stylistic_uniformity_controlled support_sentence_texture_varied "
    "paragraph_voice_variation_present academic_cliche_density_controlled -transition_rigidity %realism local_transition_natural local_discourse_not_flat sentence_uniformity_reduced revision_realism_present "
    "%body_coverage body_discourse body_cluster body_changed_blocks -template_penalty*1 effective_change subjects_varied structural_actions -problems*1 changed_characters"
).split()
#: what makes a further pass worth while when it does not hold
RETRIED = (
    "body_coverage_met", "body_discourse_met", "body_cluster_met", "rewrite_quota_met", "chapter_rewrite_quota_check", "no_failed_blocks", "revision_realism_present", "sentence_completeness_preserved",
    "paragraph_readability_preserved", "stylistic_uniformity_controlled", "support_sentence_texture_varied", "paragraph_voice_variation_present", "academic_cliche_density_controlled", "semantic_role_integrity_preserved",
    "enumeration_integrity_preserved", "scaffolding_phrase_density_controlled", "over_abstracted_subject_risk_controlled", "assertion_strength_preserved", "appendix_like_support_controlled", "authorial_stance_present",
    "evidence_fidelity_preserved", "unsupported_expansion_controlled", "thesis_tone_restrained", "metaphor_or_storytelling_controlled", "authorial_claim_risk_controlled", "bureaucratic_opening_controlled",
    "explicit_subject_chain_controlled", "overstructured_syntax_controlled", "main_clause_position_reasonable", "slogan_like_goal_phrase_controlled", "author_style_alignment_controlled",
)


def candidate_score(values: dict[str, Column]) -> Column:
    """The score as one ordered struct of whole numbers; decision: 2 passes, 1 with minor risk, 0 rejected; what is not given counts as nothing."""
    def part(p: str) -> Column:
        name, _, factor = p.lstrip("%-").partition("*")
        if name not in values:
            return F.lit(0)
        value = values[name].cast("double")
        scaled = value * (float(factor) if factor else 100.0 if p[0] in "%-" else 1.0)
        # a hundredth more or less of a share is not the sum's doing
        whole = F.floor(scaled + F.lit(1e-9)).cast("long")
        return -whole if p[0] == "-" else whole

    return F.struct(*[part(p).alias(p.lstrip("%-").partition("*")[0]) for p in PARTS])


def score_text(label: Column, values: dict[str, Column]) -> Column:
    """label:name=value,... for people."""
    return F.concat(label, F.lit(":"), F.concat_ws(",", *[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("-"))) for k, v in values.items()]))


def needs_retry(mode: str, holds: dict[str, Column]) -> Column:
    """Whether another pass is worth while: something of the list does not hold, and the mode is not conservative."""
    out = F.lit(False)
    for name in RETRIED if mode != "conservative" else ():
        if name in holds:
            out = out | ~holds[name]
    return out


def escalated(policy: Column, depth: Column, priority: Column, intensity: Column, structural: Column, discourse: Column, min_sentence: Column, min_cluster: Column, mode: str = "balanced") -> Column:
    """struct of what a further pass asks of a block: more of developmental ones, one sentence of light ones, little of conservative chapters."""
    def arr(*names: str) -> Column:
        return F.array(*map(F.lit, names))

    on = policy.isin("light_edit", "rewritable")
    careful, dev = on & (priority == "conservative"), on & (priority != "conservative") & (depth == "developmental_rewrite")
    light = on & ~careful & ~dev & (policy == "light_edit") & F.lit(mode != "conservative")
    return F.struct(
        F.when(careful, "light").when(dev & (priority == "medium"), "medium").when(dev, "high").when(light, "medium").otherwise(intensity).alias("intensity"),
        F.when(careful, F.array_except(structural, arr("pair_fusion", "sentence_cluster_merge"))).when(dev, F.array_union(structural, arr("pair_fusion"))).otherwise(structural).alias("structural"),
        F.when(careful | light, F.array_union(discourse, arr("sentence_level_recast"))).when(dev, F.array_union(discourse, arr("sentence_cluster_rewrite", "proposition_reorder", "transition_absorption"))).otherwise(discourse).alias("discourse"),
        F.when(dev, F.greatest(min_sentence, F.lit(2))).when(careful | light, F.greatest(min_sentence, F.lit(1))).otherwise(min_sentence).alias("min_sentence_changes"),
        F.when(careful, 0).when(dev & (priority != "medium"), F.greatest(min_cluster, F.lit(1))).otherwise(min_cluster).alias("min_cluster_changes"),
    )
