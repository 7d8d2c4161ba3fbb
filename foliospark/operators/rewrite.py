"""Rule-based rewriting of single sentences, as column expressions.

Fixed values: the pairs of pattern and replacement.  Every transform leaves a
sentence alone that it does not change, and ends a changed one properly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import ensure_end, let, squeeze, strip, u

OPENINGS = (
    (r"^在方法上[，,\s]*", ""),
    (r"^围绕这一目标[，,\s]*", ""),
    (r"^具体而言[，,\s]*", ""),
    (r"^就[^，。；]{2,28}而言[，,\s]*", ""),
    (r"^从[^，。；]{2,28}角度(?:来看)?[，,\s]*", ""),
    (r"^围绕[^，。；]{2,28}[，,\s]*", ""),
    (r"^在[^，。；]{2,28}(?:中|下|过程中)[，,\s]*(本研究|本文|研究|系统|模型|该方法|该机制)", "$1"),
    (r"^在完成[^，。；]{2,42}后[，,\s]*(本研究|本文|研究|系统|模型)", "$1"),
    (r"^在[^，。；]{2,18}层面[，,\s]*(本研究|本文|研究|系统|模型|该机制)", "$1"),
    (r"^在解决([^，。；]{4,80})这一目标下[，,\s]*(本研究|本文|研究)", "为解决$1，$2"),
)
WRAPPING = (
    (r"为([^，。；]{2,60})提供(?:了)?([^，。；]{1,24})基础", "为$1打下$2基础"),
    (r"提供(?:了)?([^，。；]{1,24})基础", "形成$1基础"),
    (r"提供(?:了)?([^，。；]{1,24})路径", "给出$1路径"),
    (r"形成([^，。；]{1,24})体系", "构成$1"),
    (r"具有([^，。；]{1,18})价值", "在$1中更重要"),
    (r"被视为", "是"),
    (r"属于", "是"),
    (r"得到体现", "体现为"),
    (r"进行(评估|分析|验证|控制|处理)", "$1"),
    (r"实现(控制|部署|融合|落地)", "$1"),
    (r"提供(支撑|支持)", "$1"),
)
SLOGANS = (
    (r"旨在构建", "用于构建"),
    (r"旨在通过", "主要通过"),
    (r"旨在", ""),
    (r"以实现从算法到应用的落地", "用于支持算法在系统中的应用"),
    (r"以实现([^，。；]{2,36})", "并$1"),
    (r"从而实现([^，。；]{2,36})", "并$1"),
    (r"形成(?:了)?从([^。；]{2,28})到([^。；]{2,28})的完整闭环", "串联起从$1到$2的主要环节"),
    (r"形成(?:了)?完整闭环", "形成较完整的系统流程"),
    (r"具有显著的([^，。；]{1,16})价值", "在$1方面具有实际意义"),
    (r"提供清晰方法论路径", "提供较明确的分析路径"),
    (r"筑牢第一道防线", "提供前置筛查支持"),
)
PARALLEL = (
    (r"并不是([^，。；]{2,60})，?而是", "不只是$1，更是"),
    (r"并非([^，。；]{2,60})，?而是", "不只是$1，更是"),
    (r"不仅([^，。；]{2,70})，?(?:同时|还)", "既$1，也"),
    (r"在结构上([^，。；]{2,70})，?在决策层面", "结构上$1，决策层面"),
    (r"第一，([^。；]{2,60})，?进而第二，?", "一方面，$1；另一方面，"),
)
CONNECTORS = (
    (r"不仅([^，。；]{2,70})，?(?:还|也|同时)", "$1，也"),
    (r"并且", "，"),
    (r"从而", "并"),
    (r"进而", "再"),
    (r"同时，(?=[^。；]{0,40}同时)", ""),
    (r"，{2,}", "，"),
)
PASSIVES = ((r"被视为", "是"), (r"得到体现", "体现为"), (r"属于([^，。；]{1,24})", "是$1"))
NOMINALS = ((r"进行(评估|分析|验证|控制|处理)", "$1"), (r"实现(控制|部署|融合|落地)", "$1"), (r"提供(支撑|支持)", "$1"))
SPLIT_MARKS = ("；同时，", "；", "，同时，", "，并且", "，从而", "，进而")


def _some(patterns) -> str:
    """One pattern that matches where any does: most sentences need no more than this test."""
    return u("|".join(f"(?:{p})" for p in patterns))


def _apply(sentence: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    def all_rules(t: Column) -> Column:
        for pattern, new in rules:
            t = F.regexp_replace(t, u(pattern), new)
        return t

    return F.when(strip(sentence).rlike(_some(p for p, _ in rules)), _changed(sentence, all_rules)).otherwise(sentence)


def _changed(sentence: Column, f) -> Column:
    """f of the trimmed sentence, properly ended, if that changes it."""
    def pick(p: Column) -> Column:
        return F.when(p["new"] != p["old"], ensure_end(p["new"])).otherwise(p["whole"])

    return let(F.struct(sentence.alias("whole"), strip(sentence).alias("old"), let(strip(sentence), f).alias("new")), pick)


def direct_opening(s: Column) -> Column:
    need, topic = r"^本研究面向[^，。；]{2,48}需求[，,](.+)$", r"^本研究的主题为“([^”]{2,80})”[。；]?(.*)$"

    def cut(t: Column) -> Column:
        for pattern, new in OPENINGS:
            t = F.regexp_replace(t, u(pattern), new)
        return t

    def needs(t: Column) -> Column:
        body = F.regexp_extract(t, need, 1)
        return F.when(t.rlike(need), F.when(body.rlike("^(设计|提出|构建|实现)"), F.concat(F.lit("本研究"), body)).otherwise(body)).otherwise(t)

    def topics(t: Column) -> Column:
        rest = F.regexp_replace(F.regexp_extract(t, topic, 2), "^[。；，, ]+|[。；，, ]+$", "")
        more = F.when(rest != "", F.concat(F.lit("，"), rest)).otherwise("")
        return F.when(t.rlike(topic), F.concat(F.lit("本文围绕“"), F.regexp_extract(t, topic, 1), F.lit("”展开"), more)).otherwise(t)

    some = _some((*(p for p, _ in OPENINGS), need, topic))
    return F.when(strip(s).rlike(some), _changed(s, lambda t: let(let(cut(t), needs), topics))).otherwise(s)


def unwrap(s: Column) -> Column:
    return _apply(s, WRAPPING)


def restrain_goals(s: Column) -> Column:
    return _apply(s, SLOGANS)


def flatten_parallels(s: Column) -> Column:
    return _apply(s, PARALLEL)


def lighten_connectors(s: Column) -> Column:
    return _apply(s, CONNECTORS)


def activate(s: Column) -> Column:
    return _apply(s, PASSIVES)


def verbalise(s: Column) -> Column:
    return _apply(s, NOMINALS)


def advance_clause(s: Column) -> Column:
    """The main clause before a long modifier."""
    return let(strip(s), lambda t: _advance(t, s))


def _advance(t: Column, s: Column) -> Column:
    goal = r"^在解决([^，。；]{8,90})这一目标下[，,\s]*(本研究|本文|研究)(提出了.+)$"
    done = r"^在完成([^，。；]{6,60})后[，,\s]*(本研究|本文|研究|系统)(.+)$"
    late = r"^([^，。；]{34,90})[，,]((?:本研究|本文|研究|系统|模型).+)$"

    def g(p: str, i: int) -> Column:
        return F.regexp_extract(t, p, i)

    return (
        F.when(t.rlike(goal), ensure_end(F.concat(g(goal, 2), g(goal, 3), F.lit("，用于解决"), g(goal, 1))))
        .when(t.rlike(done), ensure_end(F.concat(g(done, 2), g(done, 3), F.lit("，以前期"), g(done, 1), F.lit("为基础"))))
        .when(t.rlike(late) & g(late, 1).rlike("目标|过程|背景|层面|基础|情况下"), ensure_end(F.concat(g(late, 2), F.lit("，其背景是"), g(late, 1))))
        .otherwise(s)
    )


def split_overlong(s: Column, least: int = 96) -> Column:
    """Two sentences from one of 96 characters or more, at the first mark that leaves enough on both sides."""
    return let(strip(s), lambda t: _split(t, s, least))


def _split(t: Column, s: Column, least: int) -> Column:
    out = None
    for m in SPLIT_MARKS:
        at = F.locate(m, t)
        left = t.substr(F.lit(1), at - 1)
        right = t.substr(at + len(m), F.length(t))
        ok = (at > 0) & (F.length(left) >= 24) & (F.length(right) >= 18)
        cut = F.concat(ensure_end(left), ensure_end(strip(F.regexp_replace(right, "^(?:同时|并且|从而|进而)[，,]?", ""))))
        out = F.when(ok, cut) if out is None else out.when(ok, cut)
    return F.when(F.length(squeeze(t)) >= least, out.otherwise(s)).otherwise(s)


TRANSFORMS = {
    "direct_opening": direct_opening, "unwrap": unwrap, "restrain_goals": restrain_goals, "flatten_parallels": flatten_parallels,
    "lighten_connectors": lighten_connectors, "activate": activate, "verbalise": verbalise, "advance_clause": advance_clause, "split_overlong": split_overlong,
}


def naturalise(s: Column) -> Column:
    """All sentence transforms, one after the other."""
    for f in TRANSFORMS.values():
        s = let(s, f)
    return s


L2_RULES = (
    (r"适用于", "比较适合用来", "soften_concision"),
    (r"(?<!被)用于([^，。；]{1,18})", "是用来$1", "function_words"),
    (r"负责([^，。；]{1,18})", "负责$1的工作", "explanatory"),
    (r"提取特征", "进行特征提取的工作", "expand_clause"),
    (r"实现([^，。；]{1,18})融合", "来实现$1的融合", "texture"),
    (r"构成([^，。；]{1,18})", "形成了$1", "less_fluent"),
)


def _once(t: Column, pattern: str, new: str) -> Column:
    """The first match replaced (Spark has no bounded replace): head, replaced match, tail."""
    m = F.regexp_extract(t, pattern, 0)
    at = F.regexp_instr(t, F.lit(pattern))
    return F.when(at > 0, F.concat(t.substr(F.lit(1), at - 1), F.regexp_replace(m, pattern.replace("(?<!被)", ""), new), t.substr(at + F.length(m), F.length(t)))).otherwise(t)


def l2_variant(s: Column) -> Column:
    """The first rule that fits gives one sentence a mild second-language texture."""
    return let(strip(s), lambda t: _l2(t, s))


def _l2(t: Column, s: Column) -> Column:
    out = None
    for pattern, new, _ in L2_RULES:
        hit = t.rlike(pattern)
        out = F.when(hit, ensure_end(_once(t, pattern, new))) if out is None else out.when(hit, ensure_end(_once(t, pattern, new)))
    verb = "(验证|分析|说明|比较|处理)"
    plain = t.rlike(verb) & ~t.contains("进行") & ~t.rlike("后续验证|验证算法|辅助分析|分析与诊断")
    return out.when(plain, ensure_end(_once(t, verb, "进行$1"))).otherwise(s)
