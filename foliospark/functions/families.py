"""More signal families: semantic roles, authorial stance, local realism, paragraph skeletons, distribution of style.

Fixed values: patterns, weights and bands.  Arrays of trimmed sentences in,
structs out; source and revision are aligned by position, the shorter padded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .readability import paragraph, per_sentence, technical
from .text import clamp, contains_any, count, has, let, mean, squeeze, strip

SCAFFOLD = (
    r"^(?:这一工作|这项工作|该段论述|相关内容|该部分|这一部分|这一设置|这一调整|这一诊断结果)",
    r"^(?:这一点需要指出|这一点需要说明|这一点需要强调)",
    r"^(?:在此基础上，?研究|相应地，?本文|由此，?研究)",
    r"(?:还包括|也包括|进一步包括|相关内容还包括|相关内容包括|进一步还包括)",
)
ABSTRACTED = r"^(?:这一工作|这项工作|这一点|这一机制|这一设计|该部分|相关内容|这一部分|这一设置|这一调整|这一诊断结果|这一策略|这一过程|这一路径)[，,\s]*"
ENUM_ITEM = r"^(?:[（(]?\d+[）)]|第一|第二|第三|第四|第五|第六|其一|其二|其三)[，:\s]*"
ENUM_HEAD = r"(?:主要包括以下|主要分为|主要包含|主要创新点如下|创新点如下|主要内容如下|包括以下几类|包含三类关键组成部分|主要包含三类关键组成部分)"
MECHANISM = r"(?:模型|系统|模块|分支|接口|机制|路径|判别机制|课程学习|损失函数|主融合模块|语义分支|频域分支|base_only|logit|特征|决策|推理)"
MECHANISM_VERB = r"(?:采用|通过|将|把|用于|负责|生成|输出|融合|提取|建模|约束|对外提供|保留|剥离|实施|构成|形成|限制|连接|由[^。；]{0,24}得到)"
CONCLUSION_HEAD = r"^(?:总结而言|总的来说|总体而言|总体来看|整体来看|综上|由此可见|从最终效果看|从整体上看|从整体上说)[，,\s]*"
CLOSING = r"(?:说明|表明|意味着|更有效|更稳定|更关键|更有利)"
CORE_OPENING = r"^(?:本研究|本文|本章|本系统|本工作|本项目)"
APPENDIX = r"^(?:还包括|也包括|进一步包括|相关内容包括|相关内容还包括|这一(?:机制|设计|工作|部分|路径)|该(?:机制|设计|部分)).*(?:还包括|也包括|进一步)"
ENUM_COLLAPSED = r"第一，.+?(?:，进而|，随后|，接着)?第二，"
WEIGHTS = {"core": 1.2, "mechanism": 1.3, "enumeration": 1.5, "conclusion": 1.2, "support": 0.8}

APPENDIX_LEAD = r"^(?:用于进一步|从[^。；]{2,20}角度来看|在该设置下|在当前设置下|通过这种方式|结合[^。；]{2,40}可以看出|可以看出|这表明)[，,\s]*"
WEAK_MODAL = r"(?:可以|能够|用于|有助于)"
STRONG_VERB = r"(?:直接|显式|负责|实现|形成|约束|限制|剥离|建模|融合|输出|保留|引入|完成|比较|设计|压缩|避免|选择|决定)"
CONCRETE = (
    r"^(?:模型|系统|语义分支|频域分支|噪声分支|主融合模块|融合模块|控制机制|课程采样器|判别路径|基础对数几率|默认部署模式|扩展分析模式|训练|实验|"
    r"该结构|该分支|该模块|该判别路径|该课程采样器|后续研究)"
)
STANCE = (
    r"(?:相比之下|不同于|并非|而是|更关键的是|关键在于|核心在于|本质是|本质在于|本研究选择|本工作选择|"
    r"选择[^。；]{1,48}而非[^。；]{1,48}|重点并非[^。；]{1,96}而是)"
)
AUTHOR_MECHANISM_VERB = r"(?:采用|通过|将|把|用于|负责|生成|输出|融合|提取|建模|约束|对外提供|保留|剥离|实施|构成|形成|限制|连接|刻画|验证|观察)"
CONCLUSION_MARK = r"^(?:可以看出|这表明|这说明|由此可见|综上)[，,\s]*"
WEAK_MAIN = r"^(?:本研究|本文|该方法|该机制|这种方式|该设置|这一路径|这一设计|这一机制|该系统)(?:[^，。；]{0,10})?(?:可以|能够|用于|有助于)"
USED_FOR = r"^(?:本研究|本文|该方法|该机制|这种方式|该设置)用于"
BY_MEANS = r"^通过[^。；]{2,32}(?:可以|能够)"

TRANSITION = r"^(?:同时|此外|另外|与此同时|因此|由此|由此可见|基于此|在此基础上|在这种情况下|具体而言|更具体地说|进一步来看|总体来看|整体来看|综上所述)[，,\s]*"
OVERFINISHED = r"(?:提供(?:了)?(?:重要)?(?:基础|支撑|保障|参考)|具有(?:重要)?意义|发挥(?:重要)?作用|形成(?:完整)?闭环|实现(?:有效)?提升|具有(?:一定)?价值)[。！？?!]?$"
COMPLETE_CLAIM = r"(?:能够|可以|有助于|用于|从而|因此|由此|实现|提升|保证|确保|提供|表明|说明|体现)"
CLICHES = (
    "需要说明的是", "值得进一步说明的是", "需要指出的是", "重点在于", "(?:本研究的)?核心价值在于", "具有重要意义", "从而提升", "实现了(?:一个|完整)?[^。；]{0,16}(?:闭环|体系|流程|框架)",
    "为[^。；]{2,24}提供(?:了)?(?:重要)?(?:基础|支撑|保障|路径)", "在此基础上", "因此可以看出", "有助于(?:提升|缓解|减少|增强|改善|保持)",
)
JUDGMENT = r"(?:表明|说明|意味着|并非|更关键|关键是|更重要|更能|更适合)"
EXPLAINING = r"(?:通过|用于|以便|使得|借助|围绕|依赖|构成|形成|由.+组成)"
SUPPLEMENT_LEAD = r"^(?:其中|尤其|同时|另外|此外|换言之|相较之下|作为补充)[，,\s]*"
HIERARCHY = ("其中", "尤其", "更具体", "这使", "这意味着", "换言之", "相较之下", "但", "不过", "一方面")
OPENER_FAMILIES = ("本研究", "本文", "该系统", "系统", "该模型", "模型", "这一", "该")

TOPIC_OPENING = r"^(?:本研究|本文|本章|该研究|本系统|该系统|系统|模型|方法|实验|结果|近年来|当前|目前|随着|在方法上|在实验设计上|从整体架构上看|综合来看|总体来看|为了解决|针对|面向|围绕)"
TOPIC_FUNCTION = r"(?:面向|围绕|聚焦|提出|构建|采用|具有|旨在|目标|问题|方法|模型|系统|实验|结果|结论|挑战|背景|意义|风险|分析|研究对象|研究内容|总体|最终|核心)"
TOPIC_FORMS = (
    r"^本研究(?:面向|具有|在|围绕|最终|采用|提出|构建)", r"^本文(?:围绕|针对|从|以|主要|旨在|提出|构建)", r"^(?:近年来|当前|目前|随着).{4,80}(?:问题|需求|挑战|研究|技术|场景|任务)",
    r"^(?:在方法上|在实验设计上|从整体架构上看).{4,100}", r"^[（(](?:\d+|\[\[KEEP:CORE_NUMBER:\d+\]\])[）)]?[^：:。！？?!]{2,60}问题(?:主要体现为)?[：:]",
)
EVIDENCE = r"(?:图|表|数据|样本|实验|结果|显示|表明|准确率|召回率|F1|AUC|RMSE|MAE|%|\[\d+\])"
SKELETON_CONCLUSION = r"^(?:因此|综上|综上所述|总体来看|整体来看|综合来看|由此可见|这说明)"
SKELETON_SUPPLEMENT = r"^(?:需要说明的是|具体而言|更具体地说)"
DANGLING_OPENING = r"^(?:并进一步|并且|同时|而是|在这种情况下|相应地|围绕这一点|其中|此外|由此|需要说明的是|与此同时|另外|基于此|在此基础上|对[^，。；]{1,32}来说)"
NOT_DANGLING = r"^同时，?(?:本研究|本文|本章|系统|模型|方法|实验)"

STYLE_FUNCTION = r"(?:的|地|来|进行|会|能够|还有|以此|通过[^。；]{0,18}来|是用来|用来)"
STYLE_HELPER = r"(?:进行|实现|完成|用于|用来|能够|可以|负责)"
STYLE_DELAY = r"^(?:在|从|通过|基于|为了|围绕|针对)[^，。；]{8,40}[，,]"
STYLE_EXPLAIN = r"(?:是用来|主要的作用是|通过[^。；]{0,24}来|这个[^。；]{0,16}会|能够|的工作|用来)"
STYLE_COMPACT = r"(?:兼顾|适用于|用于|构成|负责|提取特征|实现融合|形成闭环|支撑)"
STYLE_TEXTURE = r"(?:是用来|进行[^。；]{0,12}工作|能够|还有|这个(?:模型|系统|分支|模块|策略)|这一类方法|通过[^。；]{0,18}来)"
STYLE_CLASSES = (
    ("significance_prose", ("研究意义", "意义", "价值")), ("summary_conclusion", ("结论", "总结", "展望", "未来工作", "创新点")),
    ("result_analysis", ("实验结果", "结果分析", "误差分析", "对比实验", "可视化分析")), ("system_implementation", ("系统实现", "部署", "前端", "接口", "工作流", "系统架构")),
    ("training_strategy", ("训练", "课程学习", "采样策略", "优化策略")), ("method_mechanism", ("方法", "机制", "模型", "分支", "损失", "策略")),
)
#: distribution field -> the gap that counts as one
STYLE_SCALES = {"avg_length": 60.0, "clauses": 2.0, "function_words": 0.6, "helpers": 1.2, "explanatory": 0.5, "native": 0.5, "texture": 0.5}


# ---- semantic roles
def enumerates(s: Column) -> Column:
    return has(s, ENUM_ITEM) | has(s, ENUM_HEAD)


def semantic_role(s: Column, i: Column, n: Column) -> Column:
    return (
        F.when(s == "", "support").when(enumerates(s), "enumeration").when(has(s, CONCLUSION_HEAD), "conclusion").when((i == n - 1) & s.rlike(CLOSING), "conclusion")
        .when((i == 0) & s.rlike(CORE_OPENING), "core").when(s.rlike(MECHANISM) & s.rlike(MECHANISM_VERB), "mechanism").otherwise("support")
    )


def semantic_roles(sentences: Column) -> Column:
    n = F.size(sentences)
    return F.transform(sentences, lambda s, i: semantic_role(s, i, n))


def semantics(original: Column, revised: Column, sensitive: Column | bool = False) -> Column:
    """Integrity of roles and of enumerations between aligned sentences."""
    sensitive = sensitive if isinstance(sensitive, Column) else F.lit(sensitive)
    weights = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    rows = F.arrays_zip(original.alias("o"), revised.alias("r"), semantic_roles(original).alias("ro"), semantic_roles(revised).alias("rr"))
    enum_o, enum_r = [F.size(F.filter(semantic_roles(x), lambda k: k == "enumeration")) for x in (original, revised)]
    enough = enum_r >= enum_o

    def penalty(x: Column) -> Column:
        r, a, b = F.coalesce(x["r"], F.lit("")), F.coalesce(x["ro"], F.lit("support")), F.coalesce(x["rr"], F.lit("support"))
        appendix = has(r, APPENDIX)
        fits = (
            (a == b) | (a == "support") | ((a == "core") & b.isin("core", "support") & ~has(r, ABSTRACTED)) | ((a == "conclusion") & b.isin("conclusion", "support") & ~appendix)
            | ((a == "enumeration") & ((enumerates(r) & ~appendix) | enough))
        )
        w = F.element_at(weights, a)
        return F.struct(
            w.alias("w"),
            (F.when(fits, 0.0).otherwise(w) + F.when((a == "mechanism") & appendix, 0.35).otherwise(0.0) + F.when((a == "conclusion") & (b == "support"), 0.25).otherwise(0.0)).alias("p"),
        )

    sums = F.aggregate(F.transform(rows, penalty), F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("p")), lambda s, x: F.struct((s["w"] + x["w"]).alias("w"), (s["p"] + x["p"]).alias("p")))
    n = F.greatest(F.size(revised), F.lit(1))
    scaffold = F.round(F.size(F.filter(revised, lambda s: has(s, SCAFFOLD[0]) | has(s, SCAFFOLD[1]) | has(s, SCAFFOLD[2]) | has(s, SCAFFOLD[3]))) / n, 4)
    abstract = F.round(F.size(F.filter(revised, lambda s: has(s, ABSTRACTED))) / n, 4)
    listed = (enum_o > 0) | F.exists(original, enumerates)
    lost = F.when(enum_r < enum_o, F.least(F.lit(0.65), (enum_o - enum_r) * 0.22)).otherwise(0.0)
    hung = F.least(F.lit(0.45), F.size(F.filter(revised, lambda s: enumerates(s) & has(s, APPENDIX))) * 0.18)
    fused = F.when(F.exists(revised, lambda s: s.rlike(ENUM_COLLAPSED)), 0.18).otherwise(0.0)
    empty = F.size(revised) == 0
    score = let(sums, lambda s: clamp(1.0 - s["p"] / F.greatest(F.lit(1.0), s["w"]) - scaffold * F.when(sensitive, 0.24).otherwise(0.16) - abstract * 0.18))
    return F.struct(
        F.when(empty, 0.0).otherwise(F.round(score, 4)).alias("integrity"),
        F.when(empty, 0.0).when(listed, F.round(clamp(1.0 - F.least(F.lit(1.0), lost + hung + fused)), 4)).otherwise(1.0).alias("enumeration"),
        F.when(empty, 0.0).otherwise(scaffold).alias("scaffolding"), F.when(empty, 0.0).otherwise(abstract).alias("abstract_subject"), (listed & ~empty).alias("has_enumeration"),
    )


# ---- authorial stance
def author_role(s: Column, i: Column, n: Column) -> Column:
    return (
        F.when(s == "", "support").when((i == 0) & s.rlike(CORE_OPENING), "core").when((i == n - 1) & (has(s, CONCLUSION_MARK) | s.rlike(STANCE)), "conclusion")
        .when(s.rlike(MECHANISM + "|噪声分支") & s.rlike(AUTHOR_MECHANISM_VERB), "mechanism").otherwise("support")
    )


def appendix_like(s: Column, role: Column) -> Column:
    strong = (role == "mechanism") & s.rlike(CONCRETE) & s.rlike(STRONG_VERB)
    return (s != "") & ~strong & (has(s, APPENDIX_LEAD) | s.rlike(USED_FOR) | s.rlike(BY_MEANS) | s.rlike(WEAK_MAIN))


def assertion(s: Column, i: Column, n: Column) -> Column:
    def by(role: Column) -> Column:
        def plus(test: Column, x: float) -> Column:
            return F.when(test, x).otherwise(0.0)

        concrete, strong, stance = s.rlike(CONCRETE), s.rlike(STRONG_VERB), s.rlike(STANCE)
        score = (
            F.lit(0.62) + plus(concrete, 0.16) + plus(strong, 0.14) + plus(stance, 0.18) + plus((role == "mechanism") & concrete & strong, 0.10)
            + plus(role.isin("core", "conclusion") & stance, 0.08) - F.when(s.rlike(WEAK_MAIN), 0.18).when(s.rlike(WEAK_MODAL), 0.08).otherwise(0.0)
        )
        return F.when(s == "", 0.0).when(technical(s), 0.74).when(appendix_like(s, role), 0.28).otherwise(clamp(score))

    return let(author_role(s, i, n), by)


def authorship(original: Column, revised: Column, sensitive: Column | bool = False) -> Column:
    """Strength of assertion, share of appended support, and kept stance."""
    sensitive = sensitive if isinstance(sensitive, Column) else F.lit(sensitive)

    def strengths(x: Column) -> Column:
        return F.transform(x, lambda s, i: assertion(s, i, F.size(x)))

    before = F.when(F.size(original) > 0, mean(strengths(original))).otherwise(0.72)
    after = mean(strengths(revised))
    hung = F.round(F.size(F.filter(revised, lambda s, i: appendix_like(s, author_role(s, i, F.size(revised))))) / F.greatest(F.size(revised), F.lit(1)), 4)
    had, kept = [F.size(F.filter(x, lambda s: s.rlike(STANCE))) for x in (original, revised)]
    stance = F.when((had == 0) & (kept == 0), 1.0).when(had == 0, F.least(F.lit(1.0), F.lit(0.72) + kept * 0.08)).otherwise(F.round(F.least(F.lit(1.0), kept / F.greatest(had, F.lit(1))), 4))
    drop = (had > 0) & (kept < had)
    score = let(F.struct(before.alias("b"), after.alias("a")), lambda v: v["a"] - F.when(v["a"] + 0.04 < v["b"], F.least(F.lit(0.12), v["b"] - v["a"])).otherwise(0.0))
    score = F.round(clamp(score - hung * F.when(sensitive, 0.26).otherwise(0.18) - F.when(drop, 0.06).otherwise(0.0)), 4)
    empty = F.size(revised) == 0
    return F.struct(
        F.when(empty, 0.0).otherwise(score).alias("assertion"), F.when(empty, 0.0).otherwise(hung).alias("appendix"), F.when(empty, 0.0).otherwise(F.round(clamp(stance), 4)).alias("stance"),
        F.when(empty, F.size(original) > 0).otherwise(drop & (stance < 0.92)).alias("stance_drop"),
    )


# ---- local realism
def cliches(s: Column) -> Column:
    out = F.lit(0)
    for p in CLICHES:
        out = out + s.rlike(p).cast("int")
    return out


def opener_family(s: Column) -> Column:
    lead = F.regexp_replace(F.regexp_extract(s, TRANSITION, 0), "[，, ]+$", "")
    out = F.when(lead != "", lead)
    for m in OPENER_FAMILIES:
        out = out.when(s.startswith(m), m)
    return out.otherwise("")


def support_texture(s: Column, i: Column, n: Column) -> Column:
    return (
        F.when(i == 0, "topic").when(i == n - 1, "conclusion").when(has(s, SUPPLEMENT_LEAD) | (F.length(squeeze(s)) < 22), "supplement").when(cliches(s) > 0, "cliche")
        .when(s.rlike(JUDGMENT), "judgment").when(s.rlike(EXPLAINING) | s.rlike("[，；：]"), "explanatory").otherwise("plain")
    )


def cadence(sentences: Column) -> Column:
    """2.25 times the coefficient of variation of lengths, more if short and long ones mix; 0.35 for one sentence."""
    sizes = F.transform(sentences, lambda s: F.length(squeeze(s)).cast("double"))

    def by(v: Column) -> Column:
        m = v["m"]
        spread = F.sqrt(mean(F.transform(v["x"], lambda x: (x - m) * (x - m)))) / m
        mix = F.when((F.array_min(v["x"]) <= m * 0.72) & (F.array_max(v["x"]) >= m * 1.20), 0.14).otherwise(0.0)
        return F.when(F.size(v["x"]) == 0, 0.0).when(F.size(v["x"]) == 1, 0.35).when(m <= 0, 0.0).otherwise(F.round(clamp(spread * 2.25 + mix), 4))

    return let(F.struct(sizes.alias("x"), F.greatest(mean(sizes), F.lit(1e-9)).alias("m")), by)


def variation(sentences: Column) -> Column:
    """How varied the textures of supporting sentences are."""
    n = F.size(sentences)
    all_ = F.transform(sentences, lambda s, i: support_texture(s, i, n))
    inner = F.when(n > 2, F.slice(all_, 2, F.greatest(n - 2, F.lit(0)))).otherwise(F.slice(all_, 2, F.greatest(n - 1, F.lit(0))))

    def by(t: Column) -> Column:
        k = F.size(t)
        many = (F.size(F.array_distinct(t)) - 1) / F.greatest(k - 1, F.lit(1)) * 0.68 + F.when(F.array_contains(t, "plain"), 0.12).otherwise(0.0)
        many = many + F.when(F.array_contains(t, "supplement"), 0.08).otherwise(0.0) + F.when(F.forall(t, lambda x: x == "cliche"), 0.0).otherwise(0.10)
        return F.when(k == 0, 0.48).when(k == 1, F.when(F.try_element_at(t, F.lit(1)).isin("plain", "explanatory", "judgment"), 0.56).otherwise(0.46)).otherwise(clamp(many))

    return let(inner, by)


def realism(sentences: Column) -> Column:
    """Rigidity of transitions, flatness, uniformity and the score of realism they leave."""
    n = F.size(sentences)
    many = F.greatest(n, F.lit(1))

    def share(p: str) -> Column:
        return F.size(F.filter(sentences, lambda s: has(s, p))) / many

    heads = F.filter(F.transform(sentences, opener_family), lambda x: x != "")
    opener = F.coalesce(F.array_max(F.transform(F.array_distinct(heads), lambda o: F.size(F.filter(heads, lambda x: x == o)))), F.lit(0)) / many
    moves = F.size(F.filter(F.slice(sentences, 2, F.greatest(n - 1, F.lit(0))), lambda s: has(s, TRANSITION))) / F.greatest(n - 1, F.lit(1))
    cliche = clamp(F.aggregate(sentences, F.lit(0), lambda a, s: a + cliches(s)) / (many * 2))
    facts = F.struct(
        cadence(sentences).alias("cadence"), moves.alias("moves"), opener.alias("opener"), share(OVERFINISHED).alias("over"), share(COMPLETE_CLAIM).alias("complete"),
        (F.size(F.filter(sentences, lambda s: contains_any(s, HIERARCHY))) / many).alias("hierarchy"), variation(sentences).alias("variation"), cliche.alias("cliche"),
        let(per_sentence(sentences), paragraph).alias("read"),
    )
    zero = F.lit(0.0)

    def first(f: Column) -> Column:
        c = f["cadence"]
        rigid = clamp(f["moves"] * 0.46 + f["opener"] * 0.24 + f["over"] * 0.18 + F.greatest(zero, 0.35 - c) * 0.35)
        flat = clamp(F.greatest(zero, 0.40 - c) * 0.70 + f["opener"] * 0.24 + f["complete"] * 0.18 + F.greatest(zero, 0.25 - f["hierarchy"]) * 0.22)
        return F.struct(f.alias("f"), rigid.alias("rigid"), flat.alias("flat"))

    def second(v: Column) -> Column:
        f, c = v["f"], v["f"]["cadence"]
        uniform = clamp(
            v["rigid"] * 0.24 + v["flat"] * 0.26 + F.greatest(zero, 0.42 - f["variation"]) * 0.40 + f["cliche"] * 0.28 + f["over"] * 0.12 + F.greatest(zero, 0.34 - c) * 0.10
        )
        score = clamp(
            0.70 - v["rigid"] * 0.34 - v["flat"] * 0.30 - uniform * 0.18 + c * 0.28 + f["hierarchy"] * 0.14 + f["variation"] * 0.16 - f["over"] * 0.10 - f["cliche"] * 0.12
            + (f["read"]["completeness"] - 0.72) * 0.12 + (f["read"]["readability"] - 0.70) * 0.10 - f["read"]["dangling"] * 0.28 - f["read"]["incomplete_support"] * 0.22
        )
        alone = n == 1
        return F.struct(
            F.when(n <= 1, 0.0).otherwise(F.round(v["rigid"], 4)).alias("rigidity"), F.when(n <= 1, 0.0).otherwise(F.round(v["flat"], 4)).alias("flatness"),
            F.when(n == 0, 0.0).when(alone, F.round(clamp(0.72 - f["cliche"] * 0.08), 4)).otherwise(F.round(score, 4)).alias("realism"),
            F.when(n == 0, 0.0).otherwise(F.round(c, 4)).alias("cadence"), F.when(n == 0, 0.0).when(alone, F.round(clamp(f["cliche"] * 0.28), 4)).otherwise(F.round(uniform, 4)).alias("uniformity"),
            F.when(n == 0, 0.0).when(alone, 0.48).otherwise(F.round(f["variation"], 4)).alias("variation"), F.round(f["cliche"], 4).alias("cliches"),
        )

    return let(let(facts, first), second)


# ---- skeletons
def bare_sentence(s: Column) -> Column:
    return F.regexp_replace(strip(s), "[。！？?!；;]+$", "")


def dangling_opening(s: Column) -> Column:
    t = bare_sentence(s)
    return (t != "") & ~t.rlike(NOT_DANGLING) & t.rlike(DANGLING_OPENING)


def topic_sentence(s: Column) -> Column:
    def test(t: Column) -> Column:
        out = t.rlike(TOPIC_OPENING) & t.rlike(TOPIC_FUNCTION)
        for p in TOPIC_FORMS:
            out = out | t.rlike(p)
        return (t != "") & ~dangling_opening(t) & out

    return let(bare_sentence(s), test)


def skeleton_role(s: Column, i: Column) -> Column:
    def by(t: Column) -> Column:
        return (
            F.when(t == "", "support_sentence").when(t.rlike(TOPIC_FORMS[4]) | topic_sentence(t), "topic_sentence").when(t.rlike(SKELETON_CONCLUSION), "conclusion_sentence")
            .when(t.rlike(DANGLING_OPENING) | t.rlike(SKELETON_SUPPLEMENT), "transition_sentence").when(t.rlike(EVIDENCE) | (F.regexp_count(t, F.lit(P.NUMBER)) >= 2), "evidence_sentence")
            .when((i == 0) & (F.length(t) >= 18) & t.rlike(TOPIC_FUNCTION), "topic_sentence").otherwise("support_sentence")
        )

    return let(bare_sentence(s), by)


def skeleton(sentences: Column) -> Column:
    """Roles of a paragraph's sentences, and whether its opening is a topic sentence (and so is locked)."""
    roles = F.transform(sentences, skeleton_role)
    first = F.coalesce(F.try_element_at(sentences, F.lit(1)), F.lit(""))
    locked = F.coalesce(F.try_element_at(roles, F.lit(1)) == "topic_sentence", F.lit(False)) | topic_sentence(first)
    return F.struct(roles.alias("roles"), locked.alias("opening_locked"), F.when(locked, first).otherwise("").alias("topic"), dangling_opening(first).alias("dangling"))


# ---- distribution of style
def style_class(text: Column, heading: Column) -> Column:
    h, both = squeeze(heading), F.concat(squeeze(heading), squeeze(text))
    out = F.when(contains_any(F.lower(h), ("摘要", "abstract")), "abstract_prose")
    for name, words in STYLE_CLASSES:
        out = out.when(contains_any(both, words), name)
    return out.otherwise("background_prose")


def distribution(sentences: Column) -> Column:
    """Ten numbers that describe a text's style."""
    text = F.array_join(sentences, "")
    n = F.greatest(F.size(sentences), F.lit(1))
    chars = F.greatest(F.length(squeeze(text)), F.lit(1))

    def each(p: str) -> Column:
        return F.round(count(text, p) / n, 4)

    def holding(p: str) -> Column:
        return F.round(F.size(F.filter(sentences, lambda s: has(s, p))) / n, 4)

    density = F.round(count(text, STYLE_FUNCTION) / F.greatest(F.lit(1.0), chars / 18), 4)
    compact, texture = each(STYLE_COMPACT), each(STYLE_TEXTURE)
    one = F.lit(1.0)
    native = F.round(clamp(compact * 0.55 + (1.0 - F.least(one, density)) * 0.25 + (1.0 - F.least(one, texture)) * 0.20), 4)
    d = {
        "avg_length": F.round(chars / n, 4), "clauses": F.round(F.aggregate(sentences, F.lit(0), lambda a, s: a + count(s, "[，,；;：:]")) / n, 4), "delay": holding(STYLE_DELAY),
        "function_words": density, "helpers": each(STYLE_HELPER), "explanatory": holding(STYLE_EXPLAIN), "compactness": compact, "native": native, "texture": texture,
    }
    return F.struct(F.size(sentences).alias("sentences"), *[F.when(F.size(sentences) == 0, 0.0).otherwise(v).alias(k) for k, v in d.items()])


def style_match(a: Column, b: Column) -> Column:
    """1 less the mean of seven capped gaps between two distributions."""
    gaps = F.lit(0.0)
    for k, scale in STYLE_SCALES.items():
        gaps = gaps + F.least(F.lit(1.0), F.abs(a[k] - b[k]) / scale)
    return F.round(F.greatest(F.lit(0.0), 1.0 - gaps / len(STYLE_SCALES)), 4)
