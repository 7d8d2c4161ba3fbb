"""Registered queries of the document aggregates: customers are documents, their orders paragraphs, and signals come from the order's key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: signals between 0 and `span` hundredths, from the key; flags from its remainder
_MADE = """select o_custkey as doc_id, o_orderkey as paragraph, o_orderkey % 3 <> 0 as changed, case o_orderkey % 4 when 0 then 'light_edit' when 1 then 'high_risk' else 'developmental_rewrite' end as rewrite_depth,
 cast(o_orderkey % 5 as int) as n_sentences, o_orderkey % 7 = 0 as sensitive{more} from orders"""


def made(signals: dict[str, tuple[int, int, int]], flags: dict[str, int]) -> str:
    """signals: name -> (factor, least, span) in hundredths; flags: name -> modulus."""
    more = [f"({lo} + (o_orderkey * {f}) % {span}) / cast(100 as double) as {n}" for n, (f, lo, span) in signals.items()] + [f"o_orderkey % {m} = 0 as {n}" for n, m in flags.items()]
    return _MADE.format(more="".join(", " + x for x in more))


ON = "changed and rewrite_depth in ('developmental_rewrite', 'light_edit') and n_sentences > 0"


def family_query(family: str, signals: dict, flags: dict, lists: dict[str, str], holds: dict[str, str]) -> None:
    """lists, holds: the same question in SQL; #name is the size of a list."""
    src = made(signals, flags)
    means = list(A.FAMILIES[family].means)
    neutral = A.FAMILIES[family].means
    agg = [f"round(coalesce(avg(case when {ON}{' and has_enumeration' if m == 'enumeration' else ''} then {m} end), {neutral[m]}), 4) as m_{m}" for m in means]
    agg += [f"list_sort(coalesce(list(paragraph) filter ({ON} and ({c})), [])) as l_{n}" for n, c in lists.items()]

    def fill(c: str) -> str:
        for n in sorted(lists, key=len, reverse=True):
            c = c.replace(f"#{n}", f"len(l_{n})")
        for m in sorted(means, key=len, reverse=True):
            c = c.replace(f"@{m}", f"m_{m}")
        return c

    sql = f"with p as ({src}), g as (select doc_id, count(*) filter ({ON}) as n, {', '.join(agg)} from p group by doc_id) select doc_id, n as paragraphs_checked, " + ", ".join(
        [f"cast(floor(round(m_{m}, 4) * 100 + 0.001) as bigint) as {m}" for m in means] + [f"array_to_string(l_{n}, ',') as {n}" for n in lists] + [f"n = 0 or ({fill(c)}) as {n}" for n, c in holds.items()]
    ) + " from g"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.sql(src.replace("from orders", "from {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
        out = A.aggregate(df, A.FAMILIES[family])
        return out.select("doc_id", "paragraphs_checked", *[F.floor(F.col(m) * 100 + 0.001).alias(m) for m in means], *[F.array_join(F.col(n).cast("array<string>"), ",").alias(n) for n in lists], *holds)

    run.__name__ = f"q_aggregate_{family}"
    run.__doc__ = f"Document aggregate of the {family} signals (means in hundredths here)."
    QUERIES[run.__name__] = run
    ORACLE_SQL[run.__name__] = sql


family_query(
    "evidence", {"fidelity": (7, 75, 25), "unsupported": (3, 0, 9), "register": (11, 70, 30), "metaphor": (5, 0, 5), "claim": (13, 0, 7)}, {"drift": 6},
    {
        "drift_ids": "drift", "unsupported_ids": "unsupported > case when sensitive then 0.04 else 0.06 end", "sensitive_unsupported_ids": "sensitive and unsupported > 0.04",
        "metaphor_ids": "metaphor > case when sensitive then 0.02 else 0.04 end", "claim_ids": "claim > case when sensitive then 0.03 else 0.05 end",
    },
    {
        "evidence_fidelity_preserved": "@fidelity >= 0.84 and #drift_ids <= greatest(3, n // 5)", "unsupported_expansion_controlled": "@unsupported <= 0.05 and #unsupported_ids <= greatest(2, n // 6) and #sensitive_unsupported_ids = 0",
        "thesis_tone_restrained": "@register >= 0.84 and #metaphor_ids <= greatest(1, n // 8)", "metaphor_or_storytelling_controlled": "@metaphor <= 0.03 and #metaphor_ids <= greatest(1, n // 10)",
        "authorial_claim_risk_controlled": "@claim <= 0.04 and #claim_ids <= greatest(1, n // 10)",
    },
)
family_query(
    "readability",
    {"completeness": (7, 65, 35), "readability": (3, 60, 40), "dangling": (11, 0, 3), "incomplete_support": (5, 0, 4), "fragment_conclusion": (13, 0, 6), "source_completeness": (17, 70, 30), "source_readability": (19, 70, 30)}, {},
    {
        "dangling_ids": "dangling > 0", "support_ids": "incomplete_support > 0", "conclusion_ids": "fragment_conclusion > 0",
        "sensitive_ids": "sensitive and (completeness < 0.74 or readability < 0.72 or dangling > 0 or incomplete_support > 0 or fragment_conclusion > 0)",
    },
    {
        "sentence_completeness_preserved": "@completeness >= greatest(0.72, @source_completeness - 0.06) and #support_ids <= greatest(1, n // 12) and #sensitive_ids = 0",
        "paragraph_readability_preserved": "@readability >= greatest(0.70, @source_readability - 0.06) and #dangling_ids <= greatest(1, n // 12) and #sensitive_ids = 0",
        "no_dangling_support_sentences": "#dangling_ids <= greatest(1, n // 12) and #sensitive_ids = 0", "no_fragment_like_conclusion_sentences": "#conclusion_ids <= greatest(1, n // 16)",
    },
)
family_query(
    "authorship", {"assertion": (7, 60, 30), "appendix": (3, 0, 11), "stance": (11, 80, 21), "source_assertion": (13, 60, 30)}, {"weak_assertion": 5, "stance_drop": 4},
    {"weak_assertion_ids": "weak_assertion", "appendix_ids": "appendix > case when sensitive then 0.06 else 0.08 end", "stance_drop_ids": "stance_drop", "sensitive_appendix_ids": "sensitive and appendix > 0.06"},
    {
        "assertion_strength_preserved": "@assertion >= greatest(0.66, @source_assertion - 0.05) and #weak_assertion_ids <= greatest(3, n // 4)",
        "appendix_like_support_controlled": "@appendix <= 0.08 and #appendix_ids <= greatest(2, n // 5) and #sensitive_appendix_ids = 0", "authorial_stance_present": "@stance >= 0.90 and #stance_drop_ids <= greatest(2, n // 6)",
    },
)
family_query(
    "semantics", {"integrity": (7, 65, 35), "enumeration": (3, 70, 30), "scaffolding": (11, 0, 13), "abstract_subject": (5, 0, 15)}, {"semantic_drift": 4, "absorbed": 8, "enumeration_drift": 5, "has_enumeration": 2},
    {
        "semantic_drift_ids": "semantic_drift and not absorbed", "enumeration_drift_ids": "enumeration_drift", "scaffolding_ids": "scaffolding > 0.10", "sensitive_scaffolding_ids": "sensitive and scaffolding > 0.04",
        "abstract_subject_ids": "abstract_subject > 0.10", "enumerated_ids": "has_enumeration",
    },
    {
        "semantic_role_integrity_preserved": "@integrity >= 0.78 and #semantic_drift_ids <= greatest(6, n // 3)",
        "enumeration_integrity_preserved": "#enumerated_ids = 0 or (@enumeration >= 0.82 and #enumeration_drift_ids <= greatest(1, n // 6))",
        "scaffolding_phrase_density_controlled": "@scaffolding <= 0.08 and #scaffolding_ids <= greatest(2, n // 6) and #sensitive_scaffolding_ids = 0",
        "over_abstracted_subject_risk_controlled": "@abstract_subject <= 0.08 and #abstract_subject_ids <= greatest(2, n // 5)",
    },
)
family_query(
    "naturalization",
    {"bureaucratic": (7, 0, 18), "repeated_subject": (3, 0, 25), "overstructured": (11, 0, 20), "delayed": (5, 0, 16), "slogan": (13, 0, 16), "directness": (17, 80, 20), "connector": (19, 0, 22), "nominalization": (23, 0, 20), "passive": (29, 0, 17), "overlong": (31, 0, 27), "monotony": (37, 0, 25)}, {},
    {
        "bureaucratic_ids": "bureaucratic > 0.14", "repeated_subject_ids": "repeated_subject > 0.20", "overstructured_ids": "overstructured > 0.16", "delayed_ids": "delayed > 0.12", "slogan_ids": "slogan > 0.12",
        "low_directness_ids": "directness < 0.82", "connector_ids": "connector > 0.18", "nominalization_ids": "nominalization > 0.16", "passive_ids": "passive > 0.14", "overlong_ids": "overlong > 0.22", "monotony_ids": "monotony > 0.20",
    },
    {
        "bureaucratic_opening_controlled": "@bureaucratic <= 0.08 and #bureaucratic_ids <= greatest(3, n // 6)", "explicit_subject_chain_controlled": "@repeated_subject <= 0.12 and #repeated_subject_ids <= greatest(4, n // 5)",
        "overstructured_syntax_controlled": "@overstructured <= 0.10 and #overstructured_ids <= greatest(4, n // 5)", "main_clause_position_reasonable": "@delayed <= 0.08 and #delayed_ids <= greatest(3, n // 7)",
        "slogan_like_goal_phrase_controlled": "@slogan <= 0.08 and #slogan_ids <= greatest(3, n // 7)",
        "author_style_alignment_controlled": "@directness >= 0.88 and @connector <= 0.12 and @nominalization <= 0.10 and @passive <= 0.08 and @overlong <= 0.16 and @monotony <= 0.12 and #low_directness_ids <= greatest(5, n // 5)",
    },
)
family_query(
    "realism",
    {"rigidity": (7, 30, 30), "flatness": (3, 40, 30), "realism": (11, 35, 30), "cadence": (5, 20, 30), "uniformity": (13, 40, 30), "variation": (17, 20, 30), "cliches": (19, 0, 30), "source_cadence": (23, 20, 30), "source_uniformity": (29, 40, 30), "source_cliches": (31, 0, 30), "source_flatness": (37, 40, 30)},
    {"local_action": 11},
    {
        "low_realism_ids": "realism < 0.42 and n_sentences >= 2", "flat_ids": "flatness > 0.62 and n_sentences >= 3", "rigid_ids": "rigidity > 0.30 and n_sentences >= 2", "uniform_ids": "uniformity > 0.58 and n_sentences >= 2",
        "low_texture_ids": "variation < 0.28 and n_sentences >= 3", "cliche_ids": "cliches > 0.22", "sensitive_cliche_ids": "sensitive and cliches > 0.14", "local_action_ids": "local_action",
        "varied_ids": "variation >= 0.34 or n_sentences <= 2", "improved_ids": "cadence >= source_cadence or flatness <= source_flatness",
    },
    {
        "local_transition_natural": "@rigidity <= 0.48", "local_discourse_not_flat": "@flatness <= 0.56 and #flat_ids <= greatest(2, n // 5)",
        "sentence_uniformity_reduced": "#improved_ids >= greatest(1, n // 2) or @cadence >= @source_cadence + 0.015 or #local_action_ids > 0", "revision_realism_present": "@realism >= 0.48 and #low_realism_ids <= greatest(2, n // 4)",
        "stylistic_uniformity_controlled": "@uniformity <= greatest(0.52, @source_uniformity + 0.04) and #uniform_ids <= greatest(2, n // 5)",
        "support_sentence_texture_varied": "(@variation >= 0.30 or #varied_ids >= greatest(1, n // 3)) and #low_texture_ids <= greatest(2, n // 4)",
        "academic_cliche_density_controlled": "@cliches <= greatest(0.18, @source_cliches + 0.03) and #cliche_ids <= greatest(2, n // 6) and #sensitive_cliche_ids = 0",
    },
)
family_query(
    "l2", {"texture": (7, 5, 30), "function_words": (3, 0, 30), "explanatory": (11, 0, 30), "native": (5, 10, 30), "colloquial": (13, 0, 1), "ungrammatical": (13, 0, 2)}, {"low_l2": 2, "too_native": 3},
    {"low_texture_ids": "low_l2", "native_ids": "too_native", "colloquial_ids": "colloquial > 0", "ungrammatical_ids": "ungrammatical > 0"},
    {
        "l2_texture_present": "@texture >= 0.18 and #low_texture_ids <= greatest(8, n // 3)", "not_too_native_like": "@native <= 0.26 and #native_ids <= greatest(8, n // 3)", "not_colloquial": "@colloquial = 0",
        "not_ungrammatical": "@ungrammatical = 0",
    },
)

_BEHAVED = """select o_custkey as doc_id, o_orderkey as paragraph, {p} as patterns, {m} as marks, {a} as actions, {r} as rules, cast(o_orderkey % 2 as int) as sentence_changes, cast(o_orderkey % 3 % 2 as int) as cluster_changes,
 cast(o_custkey % 4 as double) / 4 as coverage, o_orderkey % 5 <> 0 as changed from orders"""
_SPARK = _BEHAVED.format(
    p="case when o_custkey % 3 = 0 then array('merge') when o_orderkey % 2 = 0 then array('partial_keep') else array('rewrite_all', 'merge') end", m="case when o_custkey % 5 = 0 then array('partial_keep') else array('asymmetric_sentence_rhythm') end",
    a="case when o_custkey % 4 = 0 then array('paragraph_reorder') else array('clause_reorder') end", r="case when o_custkey % 7 = 0 then array('cluster:x') else array('opening:note') end",
)
_DUCK = _SPARK.replace("array(", "list_value(")


def q_revision_behaviour(spark, sf_dir):
    df = spark.sql(_SPARK.replace("from orders", "from {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet")).withColumn("coverage", F.col("coverage") * 0 + F.when(F.col("doc_id") % 2 == 0, 0.5).otherwise(F.col("paragraph") % 2))
    out = A.revision_behaviour(df)
    return out.withColumns({c: F.array_join(c, ",") for c in ("patterns", "marks")})


QUERIES["q_revision_behaviour"] = q_revision_behaviour
ORACLE_SQL["q_revision_behaviour"] = f"""with p as (select * replace (case when doc_id % 2 = 0 then 0.5 else paragraph % 2 end as coverage) from ({_DUCK})),
g as (select doc_id, count(distinct greatest(sentence_changes, cluster_changes)) as u, count(distinct coverage) as c, count(*) filter (changed) as n, count(distinct coverage) filter (changed) as cc, count(distinct array_to_string(patterns, ',')) filter (changed) as cp,
  bool_or(cluster_changes > 0) as cl from p group by doc_id),
pt as (select doc_id, list_sort(list(distinct x)) as patterns from (select doc_id, unnest(patterns) as x from p) group by doc_id), mk as (select doc_id, list_sort(list(distinct x)) as marks from (select doc_id, unnest(marks) as x from p) group by doc_id),
f as (select *, u >= 2 or c >= 2 or (list_contains(patterns, 'partial_keep') and list_contains(patterns, 'rewrite_all')) or list_contains(marks, 'partial_keep') as uneven from g join pt using (doc_id) join mk using (doc_id))
select doc_id, array_to_string(patterns, ',') as patterns, array_to_string(marks, ',') as marks, cl as sentence_cluster_changes_present, doc_id % 4 = 0 or doc_id % 7 = 0 as narrative_flow_changed, uneven as non_uniform_rewrite_distribution,
  len(patterns) >= 2 and uneven and not (n >= 3 and cc = 1 and cp <= 1) as human_like_variation from f"""


def q_weighted_style_mean(spark, sf_dir):
    """By class weight times paragraphs: a customer's orders are classes."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 8 / F.lit(8.0)).alias("match"), (F.col("o_orderkey") % 4 * (F.col("o_orderkey") % 3)).cast("double").alias("w"))
    return A.weighted_mean(df, "match", "w").select("doc_id", F.round(F.col("mean"), 6).alias("mean"))


QUERIES["q_weighted_style_mean"] = q_weighted_style_mean
ORACLE_SQL["q_weighted_style_mean"] = """select o_custkey as doc_id, coalesce(round(cast(sum((o_orderkey % 8) / 8.0 * ((o_orderkey % 4) * (o_orderkey % 3))) as double) / nullif(sum((o_orderkey % 4) * (o_orderkey % 3)), 0), 6), 0.0) as mean from orders group by o_custkey"""


def q_first_seen_actions(spark, sf_dir):
    names = F.array(*map(F.lit, ("pair_fusion", "clause_reorder", "conclusion_absorb", "subject_drop")))
    k = F.col("o_orderkey")
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), k.alias("i"), F.array(names[(k % 4).cast("int")], names[(k % 3).cast("int")]).alias("v"))
    return A.first_seen(df, "v", "i").select("doc_id", F.array_join("values", ",").alias("actions"))


QUERIES["q_first_seen_actions"] = q_first_seen_actions
ORACLE_SQL["q_first_seen_actions"] = """with n as (select ['pair_fusion', 'clause_reorder', 'conclusion_absorb', 'subject_drop'] as a), v as (select o_custkey as doc_id, o_orderkey * 2 as i, a[o_orderkey % 4 + 1] as x from orders, n union all select o_custkey, o_orderkey * 2 + 1, a[o_orderkey % 3 + 1] from orders, n),
f as (select doc_id, x, min(i) as i from v group by doc_id, x) select doc_id, string_agg(x, ',' order by i) as actions from f group by doc_id"""
