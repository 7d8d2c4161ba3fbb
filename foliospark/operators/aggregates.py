"""Document aggregates of paragraph signals: means, the paragraphs beyond a threshold, and whether a document holds up.

A family is data: which signals are averaged, which paragraphs are named, and
what must hold of means and counts.  A document's signals are summed in the order
of its paragraphs' numbers, so that no split of the rows decides how a mean that
is a tie gets rounded; one shuffle by document serves sums and lists.
Only changed body paragraphs with sentences count; a document without any gets
the neutral record.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTHS = ("developmental_rewrite", "light_edit")


def checked() -> Column:
    """Paragraphs that count: of columns changed, rewrite_depth, n_sentences."""
    return F.col("changed") & F.col("rewrite_depth").isin(*DEPTHS) & (F.col("n_sentences") > 0)


class Row(dict):
    """What a condition sees: means by name, sizes of the lists as #name, and n."""

    def few(self, name: str, least: int, part: int) -> Column:
        """At most `least` paragraphs, or one in `part`, are in the list."""
        return self[f"#{name}"] <= F.greatest(F.lit(least), F.floor(self["n"] / part))

    def no(self, name: str) -> Column:
        return self[f"#{name}"] == 0


@dataclass(frozen=True)
class Family:
    #: mean -> its value without paragraphs
    means: Mapping[str, float]
    #: list of paragraphs -> condition on one
    lists: Mapping[str, Callable[[], Column]]
    #: what holds
    holds: Mapping[str, Callable[[Row], Column]]


def over(name: str, least: float) -> Callable[[], Column]:
    return lambda: F.col(name) > least


def under(name: str, most: float) -> Callable[[], Column]:
    return lambda: F.col(name) < most


def sensitive(*tests: Callable[[], Column]) -> Callable[[], Column]:
    def all_() -> Column:
        out = tests[0]()
        for t in tests[1:]:
            out = out | t()
        return F.col("sensitive") & out

    return all_


def strictly(name: str, mild: float, strict: float) -> Callable[[], Column]:
    """Beyond a threshold that is lower for sensitive paragraphs."""
    return lambda: F.col(name) > F.when(F.col("sensitive"), strict).otherwise(mild)


def _kept(now: str, before: str, floor: float, give: float) -> Callable[[Row], Column]:
    return lambda r: r[now] >= F.greatest(F.lit(floor), r[before] - give)


# Neutral means, thresholds, allowances.
FAMILIES = {
    "readability": Family(
        {"completeness": 1.0, "readability": 1.0, "dangling": 0.0, "incomplete_support": 0.0, "fragment_conclusion": 0.0, "source_completeness": 1.0, "source_readability": 1.0},
        {
            "dangling_ids": over("dangling", 0), "support_ids": over("incomplete_support", 0), "conclusion_ids": over("fragment_conclusion", 0),
            "sensitive_ids": sensitive(under("completeness", 0.74), under("readability", 0.72), over("dangling", 0), over("incomplete_support", 0), over("fragment_conclusion", 0)),
        },
        {
            "sentence_completeness_preserved": lambda r: _kept("completeness", "source_completeness", 0.72, 0.06)(r) & r.few("support_ids", 1, 12) & r.no("sensitive_ids"),
            "paragraph_readability_preserved": lambda r: _kept("readability", "source_readability", 0.70, 0.06)(r) & r.few("dangling_ids", 1, 12) & r.no("sensitive_ids"),
            "no_dangling_support_sentences": lambda r: r.few("dangling_ids", 1, 12) & r.no("sensitive_ids"), "no_fragment_like_conclusion_sentences": lambda r: r.few("conclusion_ids", 1, 16),
        },
    ),
    "realism": Family(
        {"rigidity": 0.0, "flatness": 0.0, "realism": 1.0, "cadence": 0.0, "uniformity": 0.0, "variation": 1.0, "cliches": 0.0, "source_cadence": 0.0, "source_uniformity": 0.0, "source_cliches": 0.0},
        {
            "low_realism_ids": lambda: (F.col("realism") < 0.42) & (F.col("n_sentences") >= 2), "flat_ids": lambda: (F.col("flatness") > 0.62) & (F.col("n_sentences") >= 3),
            "rigid_ids": lambda: (F.col("rigidity") > 0.30) & (F.col("n_sentences") >= 2), "uniform_ids": lambda: (F.col("uniformity") > 0.58) & (F.col("n_sentences") >= 2),
            "low_texture_ids": lambda: (F.col("variation") < 0.28) & (F.col("n_sentences") >= 3), "cliche_ids": over("cliches", 0.22), "sensitive_cliche_ids": sensitive(over("cliches", 0.14)),
            "local_action_ids": lambda: F.col("local_action"), "varied_ids": lambda: (F.col("variation") >= 0.34) | (F.col("n_sentences") <= 2),
            "improved_ids": lambda: (F.col("cadence") >= F.col("source_cadence")) | (F.col("flatness") <= F.col("source_flatness")),
        },
        {
            "local_transition_natural": lambda r: r["rigidity"] <= 0.48, "local_discourse_not_flat": lambda r: (r["flatness"] <= 0.56) & r.few("flat_ids", 2, 5),
            "sentence_uniformity_reduced": lambda r: (r["#improved_ids"] >= F.greatest(F.lit(1), F.floor(r["n"] / 2))) | (r["cadence"] >= r["source_cadence"] + 0.015) | (r["#local_action_ids"] > 0),
            "revision_realism_present": lambda r: (r["realism"] >= 0.48) & r.few("low_realism_ids", 2, 4),
            "stylistic_uniformity_controlled": lambda r: (r["uniformity"] <= F.greatest(F.lit(0.52), r["source_uniformity"] + 0.04)) & r.few("uniform_ids", 2, 5),
            "support_sentence_texture_varied": lambda r: ((r["variation"] >= 0.30) | (r["#varied_ids"] >= F.greatest(F.lit(1), F.floor(r["n"] / 3)))) & r.few("low_texture_ids", 2, 4),
            "academic_cliche_density_controlled": lambda r: (r["cliches"] <= F.greatest(F.lit(0.18), r["source_cliches"] + 0.03)) & r.few("cliche_ids", 2, 6) & r.no("sensitive_cliche_ids"),
        },
    ),
    "semantics": Family(
        {"integrity": 1.0, "enumeration": 1.0, "scaffolding": 0.0, "abstract_subject": 0.0},
        {
            "semantic_drift_ids": lambda: F.col("semantic_drift") & ~F.col("absorbed"), "enumeration_drift_ids": lambda: F.col("enumeration_drift"), "scaffolding_ids": over("scaffolding", 0.10),
            "sensitive_scaffolding_ids": sensitive(over("scaffolding", 0.04)), "abstract_subject_ids": over("abstract_subject", 0.10), "enumerated_ids": lambda: F.col("has_enumeration"),
        },
        {
            "semantic_role_integrity_preserved": lambda r: (r["integrity"] >= 0.78) & r.few("semantic_drift_ids", 6, 3),
            "enumeration_integrity_preserved": lambda r: r.no("enumerated_ids") | ((r["enumeration"] >= 0.82) & r.few("enumeration_drift_ids", 1, 6)),
            "scaffolding_phrase_density_controlled": lambda r: (r["scaffolding"] <= 0.08) & r.few("scaffolding_ids", 2, 6) & r.no("sensitive_scaffolding_ids"),
            "over_abstracted_subject_risk_controlled": lambda r: (r["abstract_subject"] <= 0.08) & r.few("abstract_subject_ids", 2, 5),
        },
    ),
    "authorship": Family(
        {"assertion": 1.0, "appendix": 0.0, "stance": 1.0, "source_assertion": 1.0},
        {
            "weak_assertion_ids": lambda: F.col("weak_assertion"), "appendix_ids": strictly("appendix", 0.08, 0.06), "stance_drop_ids": lambda: F.col("stance_drop"), "sensitive_appendix_ids": sensitive(over("appendix", 0.06)),
        },
        {
            "assertion_strength_preserved": lambda r: _kept("assertion", "source_assertion", 0.66, 0.05)(r) & r.few("weak_assertion_ids", 3, 4),
            "appendix_like_support_controlled": lambda r: (r["appendix"] <= 0.08) & r.few("appendix_ids", 2, 5) & r.no("sensitive_appendix_ids"),
            "authorial_stance_present": lambda r: (r["stance"] >= 0.90) & r.few("stance_drop_ids", 2, 6),
        },
    ),
    "evidence": Family(
        {"fidelity": 1.0, "unsupported": 0.0, "register": 1.0, "metaphor": 0.0, "claim": 0.0},
        {
            "drift_ids": lambda: F.col("drift"), "unsupported_ids": strictly("unsupported", 0.06, 0.04), "sensitive_unsupported_ids": sensitive(over("unsupported", 0.04)),
            "metaphor_ids": strictly("metaphor", 0.04, 0.02), "claim_ids": strictly("claim", 0.05, 0.03),
        },
        {
            "evidence_fidelity_preserved": lambda r: (r["fidelity"] >= 0.84) & r.few("drift_ids", 3, 5),
            "unsupported_expansion_controlled": lambda r: (r["unsupported"] <= 0.05) & r.few("unsupported_ids", 2, 6) & r.no("sensitive_unsupported_ids"),
            "thesis_tone_restrained": lambda r: (r["register"] >= 0.84) & r.few("metaphor_ids", 1, 8), "metaphor_or_storytelling_controlled": lambda r: (r["metaphor"] <= 0.03) & r.few("metaphor_ids", 1, 10),
            "authorial_claim_risk_controlled": lambda r: (r["claim"] <= 0.04) & r.few("claim_ids", 1, 10),
        },
    ),
    "naturalization": Family(
        {"bureaucratic": 0.0, "repeated_subject": 0.0, "overstructured": 0.0, "delayed": 0.0, "slogan": 0.0, "directness": 1.0, "connector": 0.0, "nominalization": 0.0, "passive": 0.0, "overlong": 0.0, "monotony": 0.0},
        {
            "bureaucratic_ids": over("bureaucratic", 0.14), "repeated_subject_ids": over("repeated_subject", 0.20), "overstructured_ids": over("overstructured", 0.16), "delayed_ids": over("delayed", 0.12),
            "slogan_ids": over("slogan", 0.12), "low_directness_ids": under("directness", 0.82), "connector_ids": over("connector", 0.18), "nominalization_ids": over("nominalization", 0.16),
            "passive_ids": over("passive", 0.14), "overlong_ids": over("overlong", 0.22), "monotony_ids": over("monotony", 0.20),
        },
        {
            "bureaucratic_opening_controlled": lambda r: (r["bureaucratic"] <= 0.08) & r.few("bureaucratic_ids", 3, 6), "explicit_subject_chain_controlled": lambda r: (r["repeated_subject"] <= 0.12) & r.few("repeated_subject_ids", 4, 5),
            "overstructured_syntax_controlled": lambda r: (r["overstructured"] <= 0.10) & r.few("overstructured_ids", 4, 5), "main_clause_position_reasonable": lambda r: (r["delayed"] <= 0.08) & r.few("delayed_ids", 3, 7),
            "slogan_like_goal_phrase_controlled": lambda r: (r["slogan"] <= 0.08) & r.few("slogan_ids", 3, 7),
            "author_style_alignment_controlled": lambda r: (r["directness"] >= 0.88) & (r["connector"] <= 0.12) & (r["nominalization"] <= 0.10) & (r["passive"] <= 0.08) & (r["overlong"] <= 0.16) & (r["monotony"] <= 0.12) & r.few("low_directness_ids", 5, 5),
        },
    ),
    "l2": Family(
        {"texture": 0.0, "function_words": 0.0, "explanatory": 0.0, "native": 0.0, "colloquial": 0.0, "ungrammatical": 0.0},
        {"low_texture_ids": lambda: F.col("low_l2"), "native_ids": lambda: F.col("too_native"), "colloquial_ids": over("colloquial", 0), "ungrammatical_ids": over("ungrammatical", 0)},
        {
            "l2_texture_present": lambda r: (r["texture"] >= 0.18) & r.few("low_texture_ids", 8, 3), "not_too_native_like": lambda r: (r["native"] <= 0.26) & r.few("native_ids", 8, 3),
            "not_colloquial": lambda r: r["colloquial"] == 0, "not_ungrammatical": lambda r: r["ungrammatical"] == 0,
        },
    ),
}


def aggregate(paragraphs: DataFrame, family: Family, *keys: str, number: str = "paragraph") -> DataFrame:
    """(keys, paragraphs_checked, means to four digits, sorted lists of paragraph numbers, what holds). Reads the signals by the family's names."""
    keys = keys or ("doc_id",)
    on = checked()
    enumerated = {"enumeration": F.col("has_enumeration")} if "enumerated_ids" in family.lists else {}
    ordered = Window.partitionBy(*keys).orderBy(number).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    paragraphs = paragraphs.withColumns({f"_mean_{m}": F.avg(F.when(on & enumerated[m], F.col(m)) if m in enumerated else F.when(on, F.col(m))).over(ordered) for m in family.means})
    means = [F.first(f"_mean_{m}").alias(m) for m in family.means]
    lists = [F.array_sort(F.collect_list(F.when(on & F.coalesce(test(), F.lit(False)), F.col(number)))).alias(name) for name, test in family.lists.items()]
    got = paragraphs.groupBy(*keys).agg(F.count_if(on).alias("paragraphs_checked"), *means, *lists)
    # rounded before they are compared, by way of the product, as SQL engines do: at a tie (0.53875) the shortest decimal form, which F.round(x, 4) takes, says otherwise
    got = got.withColumns({m: F.round(F.coalesce(F.col(m), F.lit(v)) * 10_000) / 10_000 for m, v in family.means.items()})
    row = Row({m: F.col(m) for m in family.means} | {f"#{name}": F.size(name) for name in family.lists} | {"n": F.col("paragraphs_checked")})
    holds = {name: (F.col("paragraphs_checked") == 0) | f(row) for name, f in family.holds.items()}
    return got.select(*keys, "paragraphs_checked", *family.means, *family.lists, *[c.alias(n) for n, c in holds.items()])


def absorbed_integrity(integrity: Column, absorbed: Column) -> Column:
    """A paragraph's role integrity, raised where sentences were absorbed on purpose."""
    return F.when(absorbed & (integrity >= 0.55), F.least(F.lit(1.0), integrity + 0.18)).otherwise(integrity)


def revision_behaviour(paragraphs: DataFrame, *keys: str) -> DataFrame:
    """(keys, patterns map, marks, flags): whether a document was revised as people do. Reads patterns, marks, actions (arrays), rules, sentence_changes, cluster_changes, coverage, changed."""
    keys = keys or ("doc_id",)
    cluster = F.array(*map(F.lit, ("sentence_cluster_rewrite", "sentence_cluster_merge", "sentence_cluster_split", "conclusion_absorb", "conclusion_absorption", "transition_absorption", "proposition_reorder", "discourse_reordering", "narrative_path_rewrite")))
    narrative = F.array(*map(F.lit, ("proposition_reorder", "discourse_reordering", "narrative_path_rewrite", "paragraph_reorder")))
    units, covered = F.greatest("sentence_changes", "cluster_changes"), F.round("coverage", 2)
    got = paragraphs.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("patterns")))).alias("patterns"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("marks")))).alias("marks"),
        F.count_distinct(units).alias("_u"), F.count_distinct(covered).alias("_c"), F.count_if("changed").alias("_n"), F.count_distinct(F.when(F.col("changed"), covered)).alias("_cc"),
        F.count_distinct(F.when(F.col("changed"), F.array_join("patterns", ","))).alias("_cp"), F.max((F.col("cluster_changes") > 0) | F.arrays_overlap("actions", cluster)).alias("sentence_cluster_changes_present"),
        F.max(F.arrays_overlap("actions", narrative) | F.exists("rules", lambda r: r.startswith("paragraph:") | r.startswith("cluster:"))).alias("narrative_flow_changed"),
    )
    both = F.size(F.array_intersect("patterns", F.array(F.lit("partial_keep"), F.lit("rewrite_all")))) == 2
    marked = F.arrays_overlap("marks", F.array(*map(F.lit, ("partial_keep", "uneven_sentence_change", "heavy_light_block_contrast", "cluster_length_shift"))))
    uneven = (F.col("_u") >= 2) | (F.col("_c") >= 2) | both | marked
    uniform = (F.col("_n") >= 3) & (F.col("_cc") == 1) & (F.col("_cp") <= 1)
    got = got.withColumns({"non_uniform_rewrite_distribution": uneven, "human_like_variation": (F.size("patterns") >= 2) & uneven & ~uniform})
    return got.drop("_u", "_c", "_n", "_cc", "_cp")


def weighted_mean(rows: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """(keys, mean): by weight; 0 where all weights are 0."""
    keys = keys or ("doc_id",)
    total = F.sum(weight)
    return rows.groupBy(*keys).agg(F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(0.0).alias("mean"))


def first_seen(rows: DataFrame, lists: str, order: str, *keys: str) -> DataFrame:
    """(keys, values): distinct values of a document's lists, in the order in which they first occur."""
    keys = keys or ("doc_id",)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col(lists).alias("v"))))
    return rows.groupBy(*keys).agg(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["v"]))).alias("values"))
