"""Repairs of a revised paragraph against its source: evidence, assertion, register, protected terms, repeated summaries, and fitting a target's style.

Single sentences are JVM expressions over the revised sentence and the source's;
what drops or compares neighbours is an Arrow function over arrays.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import families
from ..functions.readability import per_sentence, technical
from ..functions.text import ensure_end, has, let, strip
from . import paragraph as G

# Patterns and replacements.
UNSUPPORTED = r"主流观点|业界通常认为|普遍认为|领域共识|超过八成|超过半数|绝大多数|20[0-9]{2}年(?:AIGC|生成式|内容生态|传播环境)|投诉|内容生态|运营人员"
METAPHOR = r"幻想的破灭|边界修复手术|判决书|挣脱出来|终于摆脱|路径终点|被击穿|逼近满分|如同[^。；]{0,24}(?:手术|判决|故事)|仿佛[^。；]{0,24}(?:剧情|手术|较量)"
CLAIM = r"^我们[，,\s]*|^我们的[，,\s]*|本工作证明了|这项工作的终点|我们的工程价值|我们选择|正如该领域主流观点所认为的"
REGISTER = r"^(?:正如该领域主流观点所认为的|业界通常认为|普遍认为|可以看出|由此可见|从这一角度来看|从[^。；]{1,20}角度来看)[，,\s]*"
EXPLICIT = r"^(?:同时|此外|另外|与此同时|因此|由此|由此可见|基于此|在此基础上|在这种情况下|正因为如此|从整体上说|从整体来看)[，,\s]*"
EXPLICIT_THEN = r"^(?:具体而言|更具体地说|进一步来看|总体来看|整体来看)[，,\s]*"
MODALS = (
    (r"有助于(提升|增强|缓解|减少|改善|保持)", "$1"), (r"(?:可以|能够)(实现|完成|避免|保证)", "直接$1"),
)
CONCRETE = r"^(?:模型|系统|语义分支|频域分支|噪声分支|主融合模块|融合模块|控制机制|课程采样器|判别路径|训练|实验|后续研究|该结构|该分支|该模块)"
PURPOSES = ((r"用于(提取|刻画|输出|约束|限制|剥离)", "负责$1"), (r"用于(建模|融合|实现)", "直接$1"), (r"用于(验证|观察)", "用来$1"))
CONTINUED = r"^本研究(?:进一步)?继续围绕"
APPENDIX = (r"^从[^。；]{2,20}角度来看[，,\s]*(.+)$", r"^(?:在该设置下|在当前设置下)[，,\s]*(.+)$", r"^(?:结合[^。；]{2,40}可以看出|可以看出|这表明|这说明)[，,\s]*(.+)$")
RECASTS = (
    (r"^(本研究采用.+?)，兼顾(.+?)[。]*$", "$1，以兼顾$2"), (r"^在([^，]{2,18})，系统不仅(.+?)，还(.+?)[。]*$", "在$1，系统除$2外，还$3"), (r"^整体而言，该模块实现了(.+?)[。]*$", "整体来看，该模块完成了$1"),
    (r"^在部署方面，系统支持(.+?)，通过(.+?)[。]*$", "在部署方面，系统可$1，并通过$2"), (r"^在完成分类判定后，系统进一步生成(.+?)，并将(.+?)[。]*$", "完成分类判定后，系统会生成$1，再将$2"),
)
SUMMARY_LEAD, SUMMARY = r"^(?:总体而言|总体来看|整体来看|综合来看|从整体上看|总的来说|综上)[，,\s]*", r"完整闭环|提供基础|支撑|总结|实现|完成|价值|意义"
VISIBLE_TERMS = r"[A-Z]{2,}[A-Za-z0-9_-]*|[A-Za-z]+_[A-Za-z0-9_]+|[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}|[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9_-]*|[A-Za-z]+[0-9]+[A-Za-z0-9_-]*"
RESHAPED = (
    (r"^(该设计|这种设计|该方法|这种方法|该系统|系统)一方面(.+?)，另一方面(?:也)?(.+?)[。！？?!]?$", r"\1既\2，也\3", 10_000), (r"^(该设计|这种设计|该方法|这种方法)能够(.+?)[。！？?!]?$", r"\1主要\2", 10_000),
    (r"^(该系统|系统)能够(.+?)[。！？?!]?$", r"\1主要\2", 80),
)
FINISHED_SUPPORT = r"^(?P<body>.+?)，?从而为(?P<object>.+?)提供(?:了)?(?:重要)?(?:基础|支撑|保障)[。！？?!]?$"
FINISHED_VALUE = r"^(?P<body>.+?)具有(?:重要)?(?P<kind>意义|价值)[。！？?!]?$"
TAXONOMY, TAXONOMY_CLAIM = r"^[A-Za-z][A-Za-z0-9_-]*(?:尤其是|特别是).{2,60}$", r"^在.+?(?:方面|上).{0,12}(?:具有|具备|表现出|更适合)"
STEPS = r"^(?P<prefix>.+?)(?:，)?第一，(?P<first>.+?)(?:，进而|，)?第二，(?P<second>.+)$"
SUBJECTS = ("本研究", "本文", "该系统", "系统", "该模型", "模型", "该方法", "该机制", "该设计", "研究")
FRAGMENT_LEAD = r"^(?:并进一步|并且进一步|并|因此|由此|同时|此外|在这种情况下|相应地|其中|从而|进而|以及)[，,\s]*(?P<body>.+)$"
OTHER_SUBJECTS = {"本研究": ("该方法", "该机制", "系统", "模型", "该策略"), "研究": ("该方法", "系统", "该策略"), "系统": ("该系统", "模型", "该机制"), "模型": ("该模型", "该机制", "系统")}
GRAMMAR = r"本研究研究|研究研究|是了|可以用于了|被是用来|，，|。。|的的|了了|进行进行"
#: fitting a target: (most replacements, pairs)
FITTING = {
    "expand_clauses": (4, (("兼顾", "能够同时兼顾"), ("适用于", "比较适合用来"), ("提取特征", "进行特征提取"), ("实现融合", "来实现融合"))),
    "function_words": (3, (("用于", "是用来"), ("分析", "进行分析"), ("验证", "进行验证"))),
    "explanatory_phrases": (2, (("模块用于", "模块的主要作用是用来"), ("策略用于", "策略的目的，是通过"), ("模型用于", "模型是用来"), ("系统用于", "系统是用来"))),
    "explanatory_support": (2, (("说明", "能够说明"), ("表明", "能够表明"), ("采用", "会采用"), ("缓解", "来缓解"), ("降低", "来降低"), ("提高", "来提高"), ("保持稳定", "保持比较稳定"), ("支持", "提供支持"))),
    "less_fluent": (2, (("构成", "形成了"), ("负责", "负责相关"), ("支撑", "提供支撑"), ("控制", "进行控制"))),
    "mild_texture": (2, (("该模型", "这个模型"), ("该系统", "这个系统"), ("该分支", "这个分支"), ("该模块", "这个模块"))),
}
CLASS_WEIGHTS = {"background_prose": 0.95, "method_mechanism": 0.95, "training_strategy": 0.95, "system_implementation": 0.95, "technical_dense": 0.30}
CLASS_BUDGETS = {"abstract_prose": 2, "significance_prose": 2, "summary_conclusion": 2, "background_prose": 2, "method_mechanism": 1, "training_strategy": 1, "result_analysis": 1, "system_implementation": 1, "technical_dense": 0}
L2_CLASSES = ("abstract_prose", "significance_prose", "background_prose", "summary_conclusion", "result_analysis")


def _or_source(bad: Column, source: Column, otherwise: Column, sentence: Column) -> Column:
    """The source's sentence where there is one, else what is left of the bad sentence."""
    return F.when(~bad, sentence).when(source != "", ensure_end(source)).otherwise(ensure_end(F.when(strip(otherwise) == "", sentence).otherwise(strip(otherwise))))


def unsupported(sentence: Column, source: Column) -> Column:
    """Without background that the source does not have."""
    bare = F.regexp_replace(F.regexp_replace(strip(sentence), REGISTER, ""), UNSUPPORTED, "")
    return _or_source(sentence.rlike(UNSUPPORTED), source, F.regexp_replace(bare, "^[，, ]+|[，, ]+$", ""), sentence)


def metaphors(sentence: Column, source: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(strip(sentence), METAPHOR, ""), "(?:终于|如同|仿佛)[，,\\s]*", "")
    return _or_source(sentence.rlike(METAPHOR), source, F.regexp_replace(bare, "^[，, ]+|[，, ]+$", ""), sentence)


def first_person(sentence: Column, source: Column) -> Column:
    """The source's kind of subject instead of a first person that it does not use."""
    t = strip(sentence)
    subject = F.when(strip(source).rlike("^(?:本研究|本文|本章|系统|该系统|模型|该方法|该机制|该设计)"), F.regexp_extract(strip(source), "^(本研究|本文|本章|系统|该系统|模型|该方法|该机制|该设计)", 1)).otherwise("本研究")
    new = ensure_end(F.concat(subject, F.regexp_replace(t, "^我们", "")))
    return F.when(~t.startswith("我们"), sentence).when(strip(source).startswith("我们"), ensure_end(source)).otherwise(new)


def overclaims(sentence: Column, source: Column) -> Column:
    t = strip(sentence)
    new = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "^本工作证明了", "本研究表明"), "^这项工作的终点", "本研究的目标"), REGISTER, "")
    bad = t.rlike(CLAIM) | t.rlike(UNSUPPORTED) | t.rlike(METAPHOR)
    return F.when(~bad, sentence).when(source.rlike("证明|主流观点|我们"), ensure_end(source)).otherwise(ensure_end(F.when(new == "", t).otherwise(new)))


def evidence(sentence: Column, source: Column) -> Column:
    """All evidence repairs of one sentence, in turn."""
    for f in (unsupported, metaphors, first_person, overclaims):
        sentence = let(sentence, _with(f, source))
    return sentence


def _with(f, source: Column):
    return lambda s: f(s, source)


def plain_modals(sentence: Column) -> Column:
    """Direct verbs instead of weak ones; technical sentences stay."""
    t = F.regexp_replace(strip(sentence), "[。！？?!]+$", "")
    new = t
    for p, r in MODALS:
        new = F.regexp_replace(new, p, r)
    direct = new
    for p, r in PURPOSES:
        direct = F.regexp_replace(direct, p, r)
    new = F.regexp_replace(F.when(new.rlike(CONCRETE), direct).otherwise(new), CONTINUED, "后续研究仍将围绕")
    return F.when((t == "") | technical(t), sentence).otherwise(ensure_end(new))


def assertions(sentence: Column) -> Column:
    """What stands in an appendix-like wrapper, by itself."""
    t = F.regexp_replace(strip(sentence), "[。！？?!]+$", "")
    out = None
    for p in APPENDIX:
        hit = ensure_end(F.regexp_extract(t, p, 1))
        out = F.when(t.rlike(p), hit) if out is None else out.when(t.rlike(p), hit)
    return out.otherwise(sentence)


def softened(sentence: Column) -> Column:
    """Without an explicit transition at its beginning, unless what is left dangles."""
    t = strip(sentence)
    new = F.regexp_replace(F.regexp_replace(t, EXPLICIT, ""), EXPLICIT_THEN, "")
    return F.when(technical(t) | (new == "") | (new == t) | families.dangling_opening(new), sentence).otherwise(ensure_end(new))


def recast_once(sentence: Column) -> Column:
    """A safe recast of a complete sentence that nothing else changed; one with protected terms stays."""
    t = strip(sentence)
    out = F.when(t.rlike(VISIBLE_TERMS) | technical(t), sentence)
    for p, new in RECASTS:
        out = out.when(t.rlike(p), ensure_end(F.regexp_replace(t, p, new)))
    return out.otherwise(sentence)


def surface_drift(source: Column, revised: Column) -> Column:
    """Whether a block added what sends it back to its source: unsupported background, metaphor, first person, claims, percentages or years."""
    def adds(p: str) -> Column:
        return F.regexp_count(revised, F.lit(p)) > F.regexp_count(source, F.lit(p))

    return adds(UNSUPPORTED) | adds(METAPHOR) | adds(CLAIM) | adds("我们") | adds("[0-9]+(?:\\.[0-9]+)?%") | adds("20[0-9]{2}年")


def block_surface(source: Column, revised: Column) -> Column:
    return F.when(surface_drift(source, revised), source).otherwise(revised)


# ---- neighbours
def summary_core(s: str) -> str:
    t = re.sub(SUMMARY_LEAD, "", G.core(s.strip()))
    return G.same_key(t) if re.search(SUMMARY, t) else ""


def without_summaries(sentences: list[str], least: float = 0.62) -> list[str]:
    """A summary that says what the one before it says goes."""
    out: list[str] = []
    for s in sentences:
        a, b = (summary_core(out[-1]) if out else ""), summary_core(s)
        if not (a and b and G.similarity(a, b) >= least):
            out.append(s)
    return out


def without_prefixes(sentences: list[str], least: int = 24) -> list[str]:
    """A sentence that begins with all of the one before it keeps its rest, or goes."""
    out = sentences[:1]
    for s in sentences[1:]:
        a, b = G.core(out[-1]), G.core(s)
        if len(a) >= least and b.startswith(a):
            rest = re.sub(r"^(?:需要说明的是|需要指出的是)[，,\s]*", "", b[len(a) :].lstrip("，,；; "))
            if rest:
                out.append(G.ended(rest))
        else:
            out.append(s)
    return out


def covered(source: list[str], revised: list[str]) -> list[str]:
    """Revised sentences that keep the bag of protected terms: where only some are missing their sentences go back, else the whole paragraph."""
    def bag(s: Iterable[str]) -> Counter:
        return Counter(re.findall(VISIBLE_TERMS, "".join(s)))

    want, have = bag(source), bag(revised)
    if want == have:
        return revised
    missing = list((want - have).elements())
    if missing and not have - want:
        new = list(revised)
        for term in missing:
            i = next((i for i, s in enumerate(source) if term in s), None)
            if i is not None and i < len(new):
                new[i] = G.ended(source[i])
        if bag(new) == want:
            return new
    return list(source)


def post_chains(revised: list[str]) -> list[str]:
    """Repeated prefixes, summaries and subjects are repaired, unless a protected term would change."""
    new = without_summaries(without_prefixes(list(revised)))
    heads = [G.subject_head(s) for s in new]
    if any(a in G.META and a == b for a, b in zip(heads, heads[1:], strict=False)):
        run = G.Run(G.Memory(), "strong", 2)
        new = [u.text for u in G.repair_heads(run, [G.Unit(s, "topic_sentence" if i == 0 else "support", (i,)) for i, s in enumerate(new)])]
    terms = [Counter(re.findall(VISIBLE_TERMS, "".join(x))) for x in (revised, new)]
    return new if terms[0] == terms[1] else list(revised)


def best_source(sentence: str, source: list[str], index: int) -> str:
    """The source sentence that a revised one comes from: similarity, a little for its own place, and for shared tokens."""
    if not source:
        return ""
    tokens = set(re.findall(G.TOKEN, sentence))

    def score(i: int) -> float:
        shared = len(tokens & set(re.findall(G.TOKEN, source[i])))
        more = 0.12 * ("而是" in source[i] and any(w in sentence for w in ("更强调", "设计了", "选择", "压缩"))) + 0.12 * ("继续围绕" in source[i] and "围绕" in sentence)
        return G.similarity(sentence, source[i]) + 0.08 * (i == index) + min(0.18, 0.06 * shared) + more

    first = min(index, len(source) - 1)
    return source[max([first, *range(len(source))], key=score)]


def replaced(text: str, kind: str) -> str:
    """Words of a target's style, at most as many as the kind allows."""
    most, pairs = FITTING[kind]
    for old, new in pairs:
        at = 0
        while most and (at := text.find(old, at)) >= 0:
            text = text[:at] + new + text[at + len(old) :]
            at += len(new)
            most -= 1
    return text


def fitted(kind: str):
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: replaced(t or "", kind))

    return run


def on_sentences(f):
    """A function of one list of sentences as a column function."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda s: f(list(s)))

    return run


@F.pandas_udf(ArrayType(StringType()))
def coverage_repair(source: pd.Series, revised: pd.Series) -> pd.Series:
    return pd.Series([covered(list(a), list(b)) for a, b in zip(source, revised, strict=True)], dtype=object)


def reshaped(s: str) -> str:
    """A support sentence in a plainer shape; technical ones stay."""
    t = s.strip()
    if not G.technical(t):
        for pattern, new, most in RESHAPED:
            if (m := re.match(pattern, t)) and len(t) <= most:
                return G.ended(m.expand(new))
    return s


def unfinished(s: str, last: bool = False) -> str:
    """A sentence that closes too roundly in the middle of a paragraph closes more plainly."""
    t = s.strip()
    if not last and not G.technical(t):
        if m := re.match(FINISHED_SUPPORT, t):
            return G.ended(f"{m['body'].strip('，, ')}，也使{m['object'].strip()}更容易展开")
        if (m := re.match(FINISHED_VALUE, t)) and len(t) <= 90:
            return G.ended(f"{m['body'].strip()}的{m['kind']}也体现在这里")
    return s


def supplement_merged(sentences: list[str]) -> list[str]:
    """The first short sentence that points back goes into the one before it."""
    for i in range(1, len(sentences) if len(sentences) >= 3 else 0):
        a, b = sentences[i - 1], sentences[i]
        if len(G.same_key(b)) <= 34 and not G.technical(a) and not G.technical(b) and re.match(r"^(?:这|该|这一|其|这种|上述)", G.core(b)):
            return [*sentences[: i - 1], G.ended(f"{G.core(a)}，{G.core(b)}"), *sentences[i + 1 :]]
    return sentences


def flowing(sentences: list[str]) -> list[str]:
    """Fragments of a taxonomy join their claim, numbered steps in one sentence part, captions read as sentences, summaries are said once."""
    out: list[str] = []
    rest = list(sentences)
    while rest:
        s = rest.pop(0)
        if out and rest and re.match(TAXONOMY, G.core(s)) and re.match(TAXONOMY_CLAIM, rest[0].strip()) and not G.technical(s) and not G.technical(rest[0]):
            s = G.ended(f"{G.core(s)}，{G.core(rest.pop(0))}")
        m = re.match(STEPS, s.strip())
        if m and not G.technical(s):
            first, second, lead = (G.core(m[k].strip("，, ")) for k in ("first", "second", "prefix"))
            if first and second:
                out += [G.ended(f"{lead}，第一，{first}"), G.ended(f"第二，{second}")]
                continue
        m = re.match(rf"^该段论述(?P<body>.+\[\[KEEP:CORE_CAPTION:\d{{4,}}\]\])$", G.core(s))
        out.append(G.ended("图示部分对应" + m["body"].strip("，, ")) if m else s)
    return without_summaries(out)


def subject_of(*sources: str) -> str:
    """The subject that one of the sentences names near its beginning."""
    for s in sources:
        for word in SUBJECTS:
            if word in s.strip()[:24]:
                return "本研究" if word == "研究" else word
    return "本研究"


def completed(s: str, source: str, before: str) -> str:
    """A fragment with the smallest head that makes it a sentence."""
    t, subject = s.strip(), subject_of(before, source)
    if m := re.match(FRAGMENT_LEAD, t):
        body = m["body"].strip("，, ")
        plain = body.startswith(("提出", "形成", "实现", "说明", "表明", "完成", "用于", "支持", "强调")) or re.match("^(?:是|为|有|具有|能够|可以|需要)", body)
        return G.ended(subject + body if plain else f"{subject}进一步{body.lstrip('进一步')}")
    if re.match(r"^是比.+更.+$", t):
        return G.ended(subject + t)
    if t.startswith("而是"):
        return G.ended(f"{subject}更强调{t[2:].strip('，, ')}")
    if m := re.match(r"^([A-Za-z][A-Za-z0-9_-]*)((?:尤其是|特别是).+)$", t):
        return G.ended(f"其中，{m[1]}{G.core(m[2])}是该类方法的重要代表")
    if re.match(r"^(?:强调|说明|体现|支持|展示|反映|用于|包括|包含|呈现|提供|形成|实现|使|让)", t):
        return G.ended(subject + t)
    if m := re.match(r"^(?:结合|根据|基于)(.{2,35}(?:结果|数据|分析|实验|评测|诊断))[。！？?!]?$", t):
        return G.ended(f"{subject}还需要结合{' ' if m[1].startswith('[[') or re.match('[A-Z]{2,}', m[1].strip()) else ''}{m[1].strip()}")
    if len(t) < 24 and not re.match(r"^(?:本研究|本文|该|这|系统|模型|方法|结果|实验|策略|问题)", t):
        return G.ended(t if t.startswith("研究") else subject + t)
    return s


def readable(source: list[str], revised: list[str], source_bad: list[bool], revised_bad: list[bool]) -> list[str]:
    """Sentences that hang or miss a part: the source's at the same place if it is whole and not said already, else completed; what is left over joins the one before."""
    out: list[str] = []
    for i, s in enumerate(revised):
        before = out[-1] if out else ""
        if revised_bad[i]:
            own = source[i] if i < len(source) else ""
            said = bool(own) and G.core(own) in G.core(before)
            s = own if own and not source_bad[i] and not said else completed(s, "" if said else own, before)
        out.append(s)
    return out


def subjects_compressed(sentences: list[str]) -> list[str]:
    """A subject that the sentence before has as well is left out."""
    out = sentences[:1]
    for a, b in zip(sentences, sentences[1:], strict=False):
        heads = [re.match(r"^(本研究|本文|研究|系统|模型)", x.strip()) for x in (out[-1] if out[-1] != a else a, b)]
        if heads[0] and heads[1] and heads[0][1] == heads[1][1]:
            new = re.sub(r"^(?:系统|模型)[，,\s]*", "同时，", re.sub(r"^(?:本研究|本文|研究)[，,\s]*", "", b.strip(), count=1), count=1)
            b = G.ended(new) if new else b
        out.append(b)
    return out


def subjects_varied(sentences: list[str]) -> list[str]:
    """From the third of a run on, a repeated subject gets another name, in turn."""
    out, head, run = list(sentences), "", 0
    for i, s in enumerate(sentences if len(sentences) >= 3 else ()):
        m = re.match(r"^(本研究|研究|系统|模型)", s.strip())
        own = m[1] if m else ""
        run = run + 1 if own and own == head else 1
        head = own
        if own and run >= 3:
            names = OTHER_SUBJECTS[own]
            out[i] = G.ended(names[(run - 3) % len(names)] + s.strip()[len(own) :])
    return out


def opening_kept(source: list[str], revised: list[str]) -> list[str]:
    """The topic sentence opens the paragraph: the revision's if it is valid and of the same subject, else a recast of the source's or itself; later sentences that repeat it go."""
    if not source or not revised:
        return revised
    first, own = revised[0], source[0]
    drifted = bool(re.match(r"^(?:本研究|本文|本章)", own.strip())) and (G.core(first).startswith(("围绕", "就", "对", "基于", "在此")) or "本文展开讨论" in first and not own.startswith("本文"))
    if not G.locked_opening(own):
        bare = re.sub(families.DANGLING_OPENING + r"[，,\s]*", "", first.strip())
        return [G.ended(bare), *revised[1:]] if G.dangling_opening(first) and bare else revised
    if G.valid_opening(first) and not drifted and G.similarity(own, first) >= 0.38:
        return revised
    recasts = [r for i in ("high", "medium") if (r := G.recast(own, i)) != own and G.valid_opening(r)]
    safe = recasts[0] if recasts else G.ended(own)
    marks = set(re.findall(rf"{G.TOKEN}|[A-Za-z][A-Za-z0-9_./-]{{2,}}", safe))
    repeats = [G.similarity(own, s) >= 0.58 and set(re.findall(rf"{G.TOKEN}|[A-Za-z][A-Za-z0-9_./-]{{2,}}", s)) <= marks for s in revised]
    return [safe, *[s for s, again in zip(revised, repeats, strict=True) if not again]]


def _bad(sentences: Column) -> Column:
    """Which sentences hang or miss a part."""
    return F.transform(per_sentence(sentences), lambda r: r["dangling"] | r["support"] | r["conclusion"])


@F.pandas_udf(ArrayType(StringType()))
def _readable(source: pd.Series, revised: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([readable(list(x), list(y), list(p), list(q)) for x, y, p, q in zip(source, revised, a, b, strict=True)], dtype=object)


def readability_repair(source: Column, revised: Column) -> Column:
    """Repaired sentences of a paragraph; which ones need it is decided in the JVM."""
    return _readable(source, revised, _bad(source), _bad(revised))


@F.pandas_udf(ArrayType(StringType()))
def opening_repair(source: pd.Series, revised: pd.Series) -> pd.Series:
    return pd.Series([opening_kept(list(a), list(b)) for a, b in zip(source, revised, strict=True)], dtype=object)


# ---- target style
def grammar_rate(sentences: Column) -> Column:
    """Share of sentences with a mark of broken grammar."""
    n = F.size(sentences)
    return F.when(n == 0, 0.0).otherwise(F.round(F.size(F.filter(sentences, lambda s: has(s, GRAMMAR))) / n, 4))


def paragraph_gap(own: Column, target: Column, class_: Column) -> Column:
    """How far a paragraph's distribution is from the target's."""
    gap = F.abs(own["avg_length"] - target["avg_length"]) / 80 + F.abs(own["function_words"] - target["function_words"]) + F.abs(own["explanatory"] - target["explanatory"])
    return gap + F.when(class_.isin(*L2_CLASSES), F.abs(own["native"] - target["native"])).otherwise(0.0)


def deviations(sentences: Column, target: Column) -> Column:
    """struct of numbers of sentences, the first 20 of each: too compact and native, not explained, too short."""
    numbered = F.transform(sentences, lambda s, i: F.struct(s.alias("s"), (i + 1).alias("i")))

    def first(test) -> Column:
        return F.slice(F.transform(F.filter(numbered, test), lambda x: x["i"]), 1, 20)

    return F.struct(
        first(lambda x: has(x["s"], families.STYLE_COMPACT) & (target["native"] < 0.72)).alias("over_native"), first(lambda x: ~has(x["s"], families.STYLE_EXPLAIN) & (target["explanatory"] >= 0.20)).alias("under_explained"),
        first(lambda x: F.length(F.regexp_replace(x["s"], "\\s+", "")) < F.greatest(F.lit(24.0), target["avg_length"] * 0.65)).alias("compact"),
    )


def alignment(model: Column, target: Column, sentences: Column, class_match: Column, term_drift: Column, evidence_drift: Column) -> Column:
    """struct: score of a model's distribution against a target's, the match that ranks candidates, and the grammar rate."""
    def gap(name: str, most: float, scale: float = 1.0, side: int = 0) -> Column:
        d = model[name] - target[name]
        return F.least(F.lit(most), (F.abs(d) if side == 0 else F.greatest(F.lit(0.0), d * side)) / scale)

    grammar = grammar_rate(sentences)
    off = (
        gap("avg_length", 0.18, 140) + gap("clauses", 0.12, 3) + gap("delay", 0.08) + gap("function_words", 0.10) + gap("helpers", 0.08) + gap("explanatory", 0.10, side=-1) + gap("compactness", 0.08, side=1)
        + gap("native", 0.08, side=1) + gap("texture", 0.08, side=-1) + F.least(F.lit(0.16), grammar * 4) + F.least(F.lit(0.16), term_drift * 0.16) + F.least(F.lit(0.16), evidence_drift * 0.18)
        + F.least(F.lit(0.14), F.greatest(F.lit(0.0), F.lit(0.70) - class_match))
    )
    return F.struct(
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - off)), 4).alias("score"), F.greatest(families.style_match(model, target), class_match).alias("match"), grammar.alias("grammar_error_rate")
    )


__all__ = ["alignment", "assertions", "best_source", "block_surface", "covered", "deviations", "evidence", "fitted", "grammar_rate", "paragraph_gap", "plain_modals", "post_chains", "recast_once", "softened"]
