"""Registered queries of the paragraph rules, over every order: texts hold its key, so the choices turn from row to row.

The SQL sides write the expected texts out and work out the chooser's turn by
themselves (the sum of the source's code points); they share no table with the
operators.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .operators import paragraph as G

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))


def over_units(rule: Callable[[G.Run, list[G.Unit]], list[G.Unit]], **how):
    """A rule over units as a column function of an array of sentences: the new sentences."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(rows: pd.Series) -> pd.Series:
        def one(s) -> list[str]:
            return [u.text for u in rule(G.Run(G.Memory(), **how), [G.Unit(x, G.label(x), (i,)) for i, x in enumerate(s)])]

        return rows.map(one)

    return run


def over_sentence(rule: Callable[[G.Run, str], str], **how):
    @F.pandas_udf(StringType())
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda s: rule(G.Run(G.Memory(), **how), s))

    return run


def said(*parts: str) -> Column:
    """Text with the order's key where a part is #."""
    return F.concat(*[F.col("k").cast("string") if p == "#" else F.lit(p) for p in parts])


def joined(units: Column) -> Column:
    return F.array_join(units, "|")


#: the place where the chooser begins among n choices, in SQL
TURN = "list_sum(list_transform(string_split({t}, ''), lambda c: unicode(c))) % {n}"


def chosen(source: str, *choices: str) -> str:
    """SQL: the choice whose turn it is, where none is held back."""
    return f"[{', '.join(choices)}][cast({TURN.format(t=source, n=len(choices))} as int) + 1]"


K = "cast(o_orderkey as varchar)"


@query(f"""select o_orderkey as k, {chosen(f"'样本' || {K} || '、图像、文本，都会影响结果'", f"'无论是样本' || {K} || '、图像，还是文本，都会影响结果。'", f"'从样本' || {K} || '到图像，再到文本，都会影响结果。'",
  f"'样本' || {K} || '、图像以及文本，都会影响结果。'", f"'不论样本' || {K} || '、图像，还是文本，都会影响结果。'", f"'只要涉及样本' || {K} || '、图像，还是文本，都会会影响结果。'")} as text from orders""")
def q_rule_enumeration(spark, sf_dir):
    return orders(spark, sf_dir).select("k", over_sentence(G.enumerations)(said("样本", "#", "、图像、文本，都会影响结果。")).alias("text"))


@query(f"""select o_orderkey as k, {chosen(f"'本研究聚焦于图像检测' || {K} || '。本研究提出了新方法'", f"'围绕图像检测' || {K} || '这一问题，本研究提出了新方法。'", f"'针对图像检测' || {K} || '，本研究提出了新方法。'",
  f"'本研究围绕图像检测' || {K} || '展开，提出了新方法。'")} as compressed,
 {chosen(f"'本研究设计了流程' || {K} || '。本研究完成了验证'", f"'本研究设计了流程' || {K} || '，完成了验证。'", f"'本研究设计了流程' || {K} || '，并在此基础上完成了验证。'", f"'本研究设计了流程' || {K} || '，同时完成了验证。'")} as merged,
 {chosen(f"'样本数量为' || {K} || '。因此，本研究完成了验证'", f"'样本数量为' || {K} || '，由此，研究完成了验证。'", f"'样本数量为' || {K} || '，由此，研究完成了验证。'", f"'样本数量为' || {K} || '，相应地，研究完成了验证。'")} as absorbed,
 '该流程已经完成' || {K} || '。|结果较好。' as kept from orders""")
def q_rule_subject_chains(spark, sf_dir):
    """Topic and work, same subjects, an implication about the study (whose strict surface is held back), and nothing to do."""
    run = over_units(G.subject_chains)
    return orders(spark, sf_dir).select(
        "k", joined(run(F.array(said("本研究聚焦于图像检测", "#", "。"), F.lit("本研究提出了新方法。")))).alias("compressed"),
        joined(run(F.array(said("本研究设计了流程", "#", "。"), F.lit("本研究完成了验证。")))).alias("merged"),
        joined(run(F.array(said("样本数量为", "#", "。"), F.lit("因此，本研究完成了验证。")))).alias("absorbed"),
        joined(run(F.array(said("该流程已经完成", "#", "。"), F.lit("结果较好。")))).alias("kept"),
    )


@query(f"""select o_orderkey as k, '本文在第' || {K} || '节给出路径为空。|' || {chosen("'本文说明了结果'", "'本文说明了结果。'", "'本文说明了结果。'", "'围绕这一目标，本文说明了结果。'")} as varied,
 '该系统读取' || {K} || '项。|该系统默认运行于本地。' as explicit from orders""")
def q_rule_repair_heads(spark, sf_dir):
    run = over_units(G.repair_heads)
    return orders(spark, sf_dir).select(
        "k", joined(run(F.array(said("本文在第", "#", "节给出路径为空。"), F.lit("本文说明了结果。")))).alias("varied"), joined(run(F.array(said("该系统读取", "#", "项。"), F.lit("该系统默认运行于本地。")))).alias("explicit")
    )


@query(f"""select o_orderkey as k, {chosen(f"'数据规模' || {K} || '扩大。同时，系统需要更新'", f"'随着数据规模' || {K} || '扩大的推进，系统也需要更新。'", f"'数据规模' || {K} || '扩大不断推进，而系统也需要更新。'",
  f"'在数据规模' || {K} || '扩大持续发展的同时，系统需要更新。'", f"'数据规模' || {K} || '扩大，系统也需要更新。'")} as context,
 {chosen(f"'数据规模' || {K} || '扩大。因此，需要补充样本'", f"'数据规模' || {K} || '扩大，这也使得需要补充样本。'", f"'数据规模' || {K} || '扩大，因此有必要需要补充样本。'", f"'数据规模' || {K} || '扩大，需要补充样本。'")} as implied,
 {chosen(f"'本文主要讨论数据' || {K} || '。此外，文章讨论了样本'", f"'本文主要讨论数据' || {K} || '，同时也文章讨论了样本。'", "'围绕这一目标，也讨论了样本。'", f"'本文主要讨论数据' || {K} || '，并将文章讨论了样本纳入了讨论。'",
  f"'本文主要讨论数据' || {K} || '，文章讨论了样本。'")} as objective, '数据。|第' || {K} || '项。' as kept from orders""")
def q_rule_fusion(spark, sf_dir):
    run = over_units(G.fuse_all)
    return orders(spark, sf_dir).select(
        "k", joined(run(F.array(said("数据规模", "#", "扩大。"), F.lit("同时，系统需要更新。")))).alias("context"),
        joined(run(F.array(said("数据规模", "#", "扩大。"), F.lit("因此，需要补充样本。")))).alias("implied"),
        joined(run(F.array(said("本文主要讨论数据", "#", "。"), F.lit("此外，文章讨论了样本。")))).alias("objective"), joined(run(F.array(F.lit("数据。"), said("第", "#", "项。")))).alias("kept"),
    )


@query(f"""select o_orderkey as k, {chosen(f"'样本' || {K} || '已经标注。结果较为稳定'", f"'样本' || {K} || '已经标注，并结果较为稳定。'", f"'样本' || {K} || '已经标注，进而结果较为稳定。'", f"'样本' || {K} || '已经标注，同时结果较为稳定。'",
  f"'样本' || {K} || '已经标注，结果较为稳定。'")} as merged, '样本' || {K} || '已经标注。|风险较高。' as other_label from orders""")
def q_rule_merge_short(spark, sf_dir):
    run = over_units(G.merge_short)
    return orders(spark, sf_dir).select(
        "k", joined(run(F.array(said("样本", "#", "已经标注。"), F.lit("结果较为稳定。")))).alias("merged"), joined(run(F.array(said("样本", "#", "已经标注。"), F.lit("风险较高。")))).alias("other_label")
    )


@query(f"""select o_orderkey as k, '第' || {K} || '批样本在采集之后先经过人工复核再进入统一的标注流程以便后续环节能够直接读取统一格式的标签数据。|同时所有标签都会按照相同的规则写入数据库并在夜间完成一次完整的备份以防止意外丢失。' as cut,
 '短句' || {K} || '，并不需要拆分。' as short,
 '第' || {K} || '批样本在采集之后先经过人工复核再进入统一的标注流程以便后续环节能够直接读取统一格式的标签数据，从而完成。' as tail_too_short from orders""")
def q_rule_split_long(spark, sf_dir):
    run = over_units(G.split_long, round=2)
    left = "批样本在采集之后先经过人工复核再进入统一的标注流程以便后续环节能够直接读取统一格式的标签数据，"
    return orders(spark, sf_dir).select(
        "k", joined(run(F.array(said("第", "#", left + "同时所有标签都会按照相同的规则写入数据库并在夜间完成一次完整的备份以防止意外丢失。")))).alias("cut"),
        joined(run(F.array(said("短句", "#", "，并不需要拆分。")))).alias("short"), joined(run(F.array(said("第", "#", left + "从而完成。")))).alias("tail_too_short"),
    )


@query(f"""select o_orderkey as k, '案例' || {K} || '如下。|因此，流程更快。|样本较少。' as conclusion_second, '数据' || {K} || '如下。|误差风险较高。|样本较少。|样本较多。' as risk_second,
 '甲' || {K} || '。|丙。|乙。|丁。' as swapped, '本研究提出方法' || {K} || '。|案例一。|综上，有效。' as locked from orders""")
def q_rule_cluster_window(spark, sf_dir):
    run, high = over_units(G.cluster_window), over_units(G.cluster_window, intensity="high")
    return orders(spark, sf_dir).select(
        "k", joined(run(F.array(said("案例", "#", "如下。"), F.lit("样本较少。"), F.lit("因此，流程更快。")))).alias("conclusion_second"),
        joined(run(F.array(said("数据", "#", "如下。"), F.lit("样本较少。"), F.lit("误差风险较高。"), F.lit("样本较多。")))).alias("risk_second"),
        joined(high(F.array(said("甲", "#", "。"), F.lit("乙。"), F.lit("丙。"), F.lit("丁。")))).alias("swapped"),
        joined(run(F.array(said("本研究提出方法", "#", "。"), F.lit("案例一。"), F.lit("综上，有效。")))).alias("locked"),
    )


@query(f"""select o_orderkey as k, '样本较少。|案例' || {K} || '如下。|综上，流程更快。' as summary_last, '研究旨在提速' || {K} || '。|误差风险较高。|样本较少。' as objective_first,
 '近年来数据增加' || {K} || '。|误差风险较高。|细节较多。' as risk_promoted, '甲。|案例。|乙' || {K} || '。|丙。|丁。|因此，更快。' as inner_last, '乙。|甲' || {K} || '。|丙。' as second_first from orders""")
def q_rule_narrative_order(spark, sf_dir):
    """What each case puts first, second or last."""
    run, high = over_units(G.narrative_order), over_units(G.narrative_order, intensity="high")
    return orders(spark, sf_dir).select(
        "k", joined(run(F.array(F.lit("综上，流程更快。"), F.lit("样本较少。"), said("案例", "#", "如下。")))).alias("summary_last"),
        joined(run(F.array(F.lit("误差风险较高。"), said("研究旨在提速", "#", "。"), F.lit("样本较少。")))).alias("objective_first"),
        joined(run(F.array(said("近年来数据增加", "#", "。"), F.lit("细节较多。"), F.lit("误差风险较高。")))).alias("risk_promoted"),
        joined(run(F.array(F.lit("甲。"), F.lit("案例。"), said("乙", "#", "。"), F.lit("因此，更快。"), F.lit("丙。"), F.lit("丁。")))).alias("inner_last"),
        joined(high(F.array(said("甲", "#", "。"), F.lit("乙。"), F.lit("丙。")))).alias("second_first"),
    )


@query(f"select o_orderkey as k, '甲' || {K} || '，乙' as clauses, '甲' || {K} || '。|乙。|甲' || {K} || '。' as neighbours, '这是第' || {K} || '个关于模型训练流程的说明。|别的。' as alike from orders")
def q_rule_dedupe(spark, sf_dir):
    alike = F.pandas_udf(lambda rows: rows.map(lambda s: G.alike_once(list(s))), ArrayType(StringType()))
    once = over_units(lambda _, units: G.same_text_once(units))
    clauses = over_sentence(lambda _, s: G.clauses_once(s))
    return orders(spark, sf_dir).select(
        "k", clauses(said("甲", "#", "，并且甲", "#", "，乙")).alias("clauses"), joined(once(F.array(said("甲", "#", "。"), said("甲 ", "#", "！"), F.lit("乙。"), said("甲", "#", "。")))).alias("neighbours"),
        joined(alike(F.array(said("这是第", "#", "个关于模型训练流程的说明。"), said("这是第", "#", "个关于模型训练流程的说明！"), F.lit("别的。")))).alias("alike"),
    )


@query(f"""select o_orderkey as k, '流程' || {K} || '更快。|样本较少。' as first_bare, '样本' || {K} || '。|同时，更快。' as kept,
 '样本' || {K} || '。|' || {chosen("'此外，流程更快'", "'在这一过程中，流程更快。'", "'与之相伴的是，流程更快。'", "'同时，流程更快。'", "'流程更快。'", "'在这一过程中，流程更快。'")} as varied from orders""")
def q_rule_transitions(spark, sf_dir):
    """The opening loses its transition; a later one is kept at first, and varied in a later round (the original is held back then)."""
    run, later = over_units(G.transitions), over_units(G.transitions, round=2)
    return orders(spark, sf_dir).select(
        "k", joined(run(F.array(said("同时，流程", "#", "更快。"), F.lit("样本较少。")))).alias("first_bare"), joined(run(F.array(said("样本", "#", "。"), F.lit("同时，更快。")))).alias("kept"),
        joined(later(F.array(said("样本", "#", "。"), F.lit("此外，流程更快。")))).alias("varied"),
    )


@query(f"""select o_orderkey as k, {chosen(f"'本研究不仅提出模型' || {K} || '，还完成部署，并形成平台'", f"'除提出模型' || {K} || '之外，本研究还完成部署，最终形成了平台。'", f"'本研究既提出模型' || {K} || '，也完成部署，并在此基础上形成了平台。'",
  f"'在提出模型' || {K} || '的同时，本研究还完成部署，从而形成了平台。'")} as expanded,
 {chosen(f"'对于医院' || {K} || '而言，误报并不局限于图像，更在于流程'", f"'从医院' || {K} || '的实际需求来看，误报并不只体现在图像，更关键的是流程。'", f"'对医院' || {K} || '来说，误报带来的风险不只在于图像，更在于流程。'",
  f"'放到医院' || {K} || '中看，误报带来的风险不只体现在图像，更在于流程。'")} as scope, '因此，本研究采用模型' || {K} || '。' as kept from orders""")
def q_rule_sentence_frames(spark, sf_dir):
    run = over_sentence(G.sentence_frames)
    return orders(spark, sf_dir).select(
        "k", run(said("本研究不仅提出模型", "#", "，还完成部署，并形成平台。")).alias("expanded"), run(said("对于医院", "#", "而言，误报并不局限于图像，更在于流程。")).alias("scope"),
        run(said("因此，本研究采用模型", "#", "。")).alias("kept"),
    )


@query(f"""select o_orderkey as k, '样本' || {K} || '较为稳定' as degree, '十分稳定' || {K} as twice, '文章对样本进行了讨论' || {K} as repeated,
 {chosen(f"'系统' || {K} || '在很多方面有效'", f"'系统' || {K} || '在多个层面有效。'", f"'系统' || {K} || '在不同层面有效。'", f"'系统' || {K} || '在若干方面有效。'", f"'系统' || {K} || '在多个层面有效。'")} as vague from orders""")
def q_rule_fillers(spark, sf_dir):
    run = over_sentence(G.fillers)
    return orders(spark, sf_dir).select(
        "k", run(said("样本", "#", "比较较为稳定")).alias("degree"), run(said("十分非常稳定", "#")).alias("twice"), run(said("文章对样本进行了讨论，并对样本进行了讨论", "#")).alias("repeated"), run(said("系统", "#", "在很多方面有效。")).alias("vague")
    )


@query(f"""select o_orderkey as k, '系统分析了样本' || {K} || '，并完成标注。' as function_words, '样本' || {K} || '较少。' as sequence, '为后续' || {K} || '提供基础。' as slogan, '首先，ResNet50 与 BERT_base 以及 GPT2 ' || {K} || '。' as technical_kept,
 {chosen(f"'不仅要采集样本' || {K} || '，还要完成标注'", f"'采集样本' || {K} || '之外，还需要完成标注。'", f"'采集样本' || {K} || '是基础，完成标注则决定了后续落实效果。'")} as parallel from orders""")
def q_rule_texture(spark, sf_dir):
    run = over_sentence(G.texture)
    return orders(spark, sf_dir).select(
        "k", run(said("系统进行了分析样本", "#", "，并且完成标注。")).alias("function_words"),
        run(said("首先，样本", "#", "较少。")).alias("sequence"), run(said("为后续", "#", "奠定坚实基础。")).alias("slogan"), run(said("首先，ResNet50 与 BERT_base 以及 GPT2 ", "#", "。")).alias("technical_kept"),
        run(said("不仅要采集样本", "#", "，还要完成标注。")).alias("parallel"),
    )


@query(f"""select o_orderkey as k, '更具体地说，样本' || {K} || '较多。' as concrete, '在降低误报这一目标下，系统采用阈值' || {K} || '。' as goal, '就效果' || {K} || '而言，差异较小。' as view, '本章以 流程' || {K} || ' 为主线，分三节说明。' as high_only,
 '本章围绕流程' || {K} || '，分三节说明。' as medium_keeps, '样本' || {K} || '。' as plain from orders""")
def q_rule_recast(spark, sf_dir):
    def run(intensity: str):
        return F.pandas_udf(lambda rows: rows.map(lambda s: G.recast(s, intensity)), StringType())

    medium, high = run("medium"), run("high")
    return orders(spark, sf_dir).select(
        "k", medium(said("具体而言，样本", "#", "较多。")).alias("concrete"), medium(said("为降低误报，系统采用阈值", "#", "。")).alias("goal"), medium(said("从效果", "#", "来看，差异较小。")).alias("view"),
        high(said("本章围绕流程", "#", "，分三节说明。")).alias("high_only"), medium(said("本章围绕流程", "#", "，分三节说明。")).alias("medium_keeps"), medium(said("样本", "#", "。")).alias("plain"),
    )


@query("""select o_orderkey as k, case o_orderkey % 4 when 0 then 'a0|b|c|d' when 1 then 'a|b1|c|d' when 2 then 'a|b|c2|d' else 'a|b|c|d3' end as sentences, 'partial_keep,uneven_sentence_change' as marks from orders""")
def q_rule_uneven(spark, sf_dir):
    """All four sentences changed: the one at (paragraph + 4) mod 4 goes back."""

    @F.pandas_udf("sentences string, marks string")
    def run(paragraph: pd.Series) -> pd.DataFrame:
        def one(p: int) -> tuple[str, str]:
            new, marks = G.uneven(G.Run(G.Memory()), ["a0", "b1", "c2", "d3"], ["a", "b", "c", "d"], int(p))
            return "|".join(new), ",".join(marks)

        return pd.DataFrame([one(p) for p in paragraph], columns=["sentences", "marks"])

    return orders(spark, sf_dir).select("k", run("k").alias("r")).select("k", "r.*")


_MAPPED = (
    ("fusion:context-followup", "pair_fusion,sentence_cluster_merge", "sentence_cluster_rewrite,sentence_cluster_merge,transition_absorption", "merge,partial_keep"),
    ("subject:drop,paragraph:promote-risk", "subject_drop,paragraph_reorder,discourse_reordering,narrative_path_rewrite,subject_chain_compression", "subject_chain_compression,compress_subject_chain,proposition_reorder,discourse_reordering,narrative_path_rewrite", "reorder,partial_keep"),
    ("paragraph:opening-style-guard", "topic_sentence_preservation", "preserve_explicit_subject_if_clarity_needed", "partial_keep"),
    ("structure:split-long-sentence,natural:function-word", "sentence_split,sentence_cluster_split", "rebuild_sentence_rhythm,sentence_cluster_split,reduce_function_word_overuse", "split,partial_keep"),
    ("opening:note", "", "", "partial_keep"),
)


@query("select o_orderkey as k, e.structural, e.discourse, e.patterns from orders join (values " + ", ".join(f"({i}, '{s}', '{d}', '{p}')" for i, (_, s, d, p) in enumerate(_MAPPED)) + ") as e(i, structural, discourse, patterns) on o_orderkey % 5 = e.i")
def q_rule_actions(spark, sf_dir):
    """What lists of rules count as; the texts are unchanged, so the patterns end with a partial keep."""

    @F.pandas_udf("structural string, discourse string, patterns string")
    def run(rules: pd.Series) -> pd.DataFrame:
        rows = [(G.structural_actions(r), G.discourse_actions(r), G.revision_patterns(r, ["甲。"], ["甲。"], "light_edit")) for r in (x.split(",") for x in rules)]
        return pd.DataFrame([[",".join(c) for c in r] for r in rows], columns=["structural", "discourse", "patterns"])

    rules = F.element_at(F.array(*[F.lit(r[0]) for r in _MAPPED]), (F.col("k") % 5 + 1).cast("int"))
    return orders(spark, sf_dir).select("k", run(rules).alias("r")).select("k", "r.*")


@query("""select o_orderkey as k, case o_orderkey % 3 when 0 then 'study_description,repeated_meta_subject,subject_chain' when 1 then 'risk_objective,risk_conclusion' else 'enumeration_unified,background_transition' end as patterns from orders""")
def q_rule_detected(spark, sf_dir):
    @F.pandas_udf(StringType())
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda s: ",".join(G.detected([G.Unit(x, G.label(x), (i,)) for i, x in enumerate(s)])))

    s = (
        F.when(F.col("k") % 3 == 0, F.array(F.lit("本研究提出模型。"), F.lit("本研究完成部署。"), F.lit("案例较多。")))
        .when(F.col("k") % 3 == 1, F.array(F.lit("误差风险较高。"), F.lit("因此，更换模型。"), F.lit("研究旨在提速。")))
        .otherwise(F.array(F.lit("猫、狗、鸟，都会跑。"), F.lit("近年来数据增加。"), F.lit("同时，样本较少。")))
    )
    return orders(spark, sf_dir).select("k", run(s).alias("patterns"))


@query(None)
def q_rewrite_documents(spark, sf_dir):
    """Whole documents of the revision corpus, paragraph by paragraph, with the memory that runs over a document's paragraphs."""
    from . import corpus

    paragraphs = corpus.blocks(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_id", "text"))).alias("b"))  # a document's own blocks
    out = paragraphs.select("doc_id", F.posexplode(G.rewriter()(F.col("b.text"))).alias("i", "r"))
    return out.select("doc_id", (F.col("i") + 1).alias("paragraph"), "r.text", F.array_join("r.rules", ",").alias("rules"), "r.sentence_changes", "r.cluster_changes", "r.discourse_score", "r.coverage")
