"""Frames of the paragraph rewriter: what a sentence, or two neighbours, may become.

Fixed values: patterns, words, keys and replacements.  A choice is (key, text,
surface) or (key, text, surface, PLAIN); plain ones belong to no family of
templates.  Texts are filled with the groups of the pattern and what the rule
works out of them.
"""

from __future__ import annotations

PLAIN = True

SUMMARY = ("总的来说", "总而言之", "总体来看", "总体而言", "综合来看", "综上")
TRANSITION = ("与此同时", "同时", "此外", "另外", "在这一过程中", "与之相伴的是")
IMPLICATION = ("因此", "由此可见", "由此", "这也意味着", "这也说明", "基于此", "在这种情况下")
RULE_LIKE = ("summary-opening", "note-opening", "practical-opening", "implication-opening", "transition-opening", "study-focus", "therefore-study", "therefore-build")
STRICT_SURFACES = ("从……角度看", "在此基础上", "这也意味着", "进一步来看", "综上")
#: family of templates: the families of rules, the surfaces, and the words in a text that put a choice into it
TEMPLATES = (
    ("study_subject_family", ("subject-variation", "subject-drop"), ("研究", "本文", "本研究", "该系统"), ()),
    ("implication_family", ("implication-opening", "therefore-study", "therefore-build", "implication-followup", "subject-followup"), (), ()),
    ("transition_family", ("transition-opening", "context-followup", "objective-followup"), (), ()),
    ("framing_family", ("study-focus", "meta-compression"), (), ("围绕", "聚焦于", "尝试回应", "讨论的核心问题")),
)
#: how often before the original is kept: family of rules in a document, strict surface, family of templates in a paragraph and a document
RULE_LIMIT, STRICT_LIMIT, PARAGRAPH_LIMIT, DOCUMENT_LIMIT, RECENT = 2, 1, 1, 2, 4

LABELS = (
    ("objective", r"本研究|本文|研究旨在|目标是|聚焦于|围绕.+展开|主要讨论|重点在于"), ("risk", r"风险|问题|挑战|局限|偏差|不稳定|瓶颈"),
    ("capability", r"能够|可以|可用于|支持|实现|完成|开始|进入|延伸到|扩展到"), ("background", r"近年来|当前|目前|随着|在.+背景下|在.+情境下"),
    ("support", r"讨论|分析|说明|表明|案例|应用|场景|对象|样本|结果"),
)
SUBJECT_LEADS = (r"^围绕[^，]+，", r"^针对[^，]+，", r"^放到[^，]+中看，", r"^从[^，]+来看，", r"^对[^，]+来说，", r"^就[^，]+而言，", r"^在此基础上，", r"^由此，", r"^相应地，")
SUBJECT_HEAD = r"^(?P<head>[^，。；]{1,10}?)(?:正在|已经|能够|可以|不仅|还|会|将|带来的|的风险|在|并不)"
TOPICS = (
    r"^本研究的主题为(?P<topic>.+)$", r"^本文讨论的核心问题是(?P<topic>.+)$", r"^本研究尝试回应(?P<topic>.+?)(?:这一问题)?$", r"^本研究聚焦于(?P<topic>.+)$",
    r"^本研究围绕(?P<topic>.+?)展开$", r"^本文主要讨论(?P<topic>.+)$", r"^本研究的重点在于(?P<topic>.+)$", r"^围绕(?P<topic>.+?)的设计与实现，本文展开讨论$",
)
WORK = r"不仅|包含|完成|实现|形成|构建|设计|覆盖|讨论|分析|提出|回应|优化"
EXPLICIT = (
    "最终采用", "默认运行于", "作为本地部署模型", "作为部署模型", "checkpoint", "checkpoints/", ".pth", ".pt", ".ckpt", "epoch_", "Phase", "base_only", "best.pth", "文件路径",
    "路径为", "保存到",
)
KEEP_SUBJECT = ("最终采用", "默认运行于", "作为本地部署模型", "checkpoint", "checkpoints/", ".pth", ".pt", ".ckpt", "epoch_", "Phase", "base_only", "路径")
EMBEDDED = r"^(?P<prefix>[^，。]{2,60})，(?P<subject>本研究|本文|该研究|该系统)(?P<body>.+)$"
PARTICLE = r"^(?P<subject>[^，。；]{1,12}?)(?P<lemma>已经|正在|开始|能够|可以|会|将|仍然|仍|需要|还)(?P<rest>.+)$"
FOLLOWUPS = (("讨论了", "讨论"), ("分析了", "分析"), ("提到了", "提及"), ("说明了", "说明"))
FOLLOWUP = r"^(?:文章|本文|本研究|研究)?(?:还|也)?{verb}(?P<object>.+)$"
CLAUSE_LEAD = r"^(?:并且|而且|并|还|同时|此外|另外|与此同时|因此|所以|由此|基于此)\s*"
SEQUENCE = r"^(?:首先|其次|再次|此外|最后|综上所述)[，,\s]*"
SPLIT_MARKS = ("，同时", "，并且", "，并", "，而", "，从而", "，进而", "，这也意味着", "，其中", "，不过")
TASK_LEFT = r"在\s*(?:{token}|[A-Za-z0-9_./-]+|[^，。；]{{2,24}})\s*[^，。；]{{0,8}}任务中$"
PLACE_LEFT = r"在\s*(?:{token}|[A-Za-z0-9_./-]+|[^，。；]{{2,24}})\s*中$"
PLACE_RIGHT = ("这一", "该", "其", "模型", "系统")
SCENE_LEFT = r"(?:过程中|场景中|背景下|层面|方面|语境下|设计中)$"
SCENE_RIGHT = ("针对", "通过", "对", "以", "并", "从而")

#: pairs of neighbours: family -> (rule, choices)
PAIRS = {
    "meta-compression": ("subject:meta-compression", (
        ("around", "围绕{topic}这一问题，本研究{body}。", "围绕……这一问题"), ("target", "针对{topic}，本研究{body}。", "针对……"), ("expand", "本研究围绕{topic}展开，{body}。", "本研究围绕"),
    )),
    "subject-followup": ("subject:followup-absorb", (
        ("drop", "{left}，在此基础上，{body}。", "在此基础上"), ("research", "{left}，由此，{varied}。", "由此，研究"), ("respond", "{left}，相应地，{system}。", "相应地"),
    )),
    "subject-merge": ("subject:merge-consecutive", (
        ("comma", "{left}，{body}。", "直接并句"), ("jiner", "{left}，并在此基础上{body}。", "并在此基础上"), ("meanwhile", "{left}，同时{body}。", "同时"),
    )),
    "objective-followup": ("fusion:objective-followup", (
        ("also", "{left}，同时也{right}。", "同时也……"), ("deeper", "围绕这一目标，{tail}。", "围绕这一目标"), ("covered", "{left}，并将{right}纳入了讨论。", "并将……纳入讨论"),
        ("drop", "{left}，{linked}。", "省略过渡", PLAIN),
    )),
    "context-followup": ("fusion:context-followup", (
        ("while", "随着{left}的推进，{linked}。", "随着……的推进"), ("and", "{left}不断推进，而{linked}。", "……而……也"), ("accompany", "在{left}持续发展的同时，{right}。", "在……持续发展的同时"),
        ("drop", "{left}，{linked}。", "省略过渡", PLAIN),
    )),
    "implication-subject": ("fusion:implication-followup", (
        ("drop", "{left}，在此基础上，{body}。", "在此基础上"), ("research", "{left}，由此，{varied}。", "由此，研究"), ("accordingly", "{left}，相应地，{system}。", "相应地"),
        ("direct", "{left}，{body}。", "省略因果句首", PLAIN),
    )),
    # the choice that keeps only the right sentence is left out: it would lose the left one
    "implication-plain": ("fusion:implication-followup", (
        ("means", "{left}，这也使得{right}。", "这也使得"), ("based-on-this", "{left}，因此有必要{right}。", "因此有必要"), ("direct", "{left}，{right}。", "省略因果句首", PLAIN),
    )),
    "short-merge": ("structure:merge-short-followup", (
        ("bing", "{left}，并{bing}。", "并"), ("jiner", "{left}，进而{jiner}。", "进而"), ("tongshi", "{left}，同时{right}。", "同时"), ("drop", "{left}，{right}。", "省略连接", PLAIN),
    )),
}
#: families whose frames go by another name in the counts
FAMILY = {"implication-subject": "implication-followup", "implication-plain": "implication-followup"}

#: single sentences: (family, rule, who may: any, balanced (not conservative) or strong, prefers change, may keep, pattern, choices)
END = r"[。！？?!]?$"
SENTENCES = (
    ("study-focus", "sentence:study-focus", "any", "later", True, r"^(?:本研究(?:的主题为|主要围绕|围绕)|本文讨论的核心问题是)(?P<topic>.+?)(?:展开讨论|展开|进行讨论)?" + END, (
        ("around", "本研究围绕{topic}展开。", "本研究围绕"), ("main", "本文主要讨论{topic}。", "本文主要讨论"), ("problem", "本研究尝试回应{topic}这一问题。", "本研究尝试回应"),
        ("task", "围绕{topic}的设计与实现，本文展开讨论。", "围绕……的设计与实现"), ("priority", "本研究的重点在于{topic}。", "本研究的重点在于"),
    )),
    ("scope-risk", "sentence:scope-risk", "any", "yes", "conservative", r"^对于(?P<context>.+?)而言，(?P<subject>.+?)并不局限于(?P<limit>.+?)，更在于(?P<focus>.+?)" + END, (
        ("needs", "从{context}的实际需求来看，{subject}并不只体现在{limit}，更关键的是{focus}。", "从……的实际需求来看"), ("issue", "对{context}来说，{risk}不只在于{limit}，更在于{focus}。", "对……来说"),
        ("manifest", "放到{context}中看，{risk}不只体现在{limit}，更在于{focus}。", "在……中"),
    )),
    ("therefore-build", "sentence:therefore-build", "balanced", "yes", True, r"^因此，构建(?P<target>.+?)(?P<lemma>十分必要|十分关键|尤为关键|尤为必要|非常关键|非常必要)" + END, (
        ("based-on-this", "基于此，有必要构建{target}。", "基于此"), ("in-this-case", "在这种情况下，构建{target}就显得{emphasis}。", "在这种情况下"), ("it-shows", "这也说明，需要构建{target}。", "这也说明"),
    )),
    ("therefore-study", "sentence:therefore-study", "balanced", "later", True, r"^因此，本研究(?P<rest>.+?)" + END, (
        ("direct", "因此，本研究{rest}。", "因此，本研究"), ("accordingly", "据此，本文{rest}。", "据此，本文"), ("goal", "在这一目标下，本研究{rest}。", "在这一目标下"),
    )),
    ("parallel-expansion", "sentence:parallel-expansion", "balanced", "yes", "conservative", r"^本研究不仅(?P<x>.+?)，还(?P<y>.+?)，(?:形成了|并形成)(?P<z>.+?)" + END, (
        ("except", "除{x}之外，本研究还{y}，最终形成了{z}。", "除……之外"), ("both", "本研究既{x}，也{y}，并在此基础上形成了{z}。", "本研究既……也……"), ("while", "在{x}的同时，本研究还{y}，从而形成了{z}。", "在……的同时"),
    )),
    ("parallel-expansion-short", "sentence:parallel-expansion-short", "strong", "yes", False, r"^本研究不仅(?P<x>.+?)，还(?P<y>.+?)" + END, (
        ("except", "除{x}之外，本研究还{y}。", "除……之外"), ("both", "本研究既{x}，也{y}。", "本研究既……也……"), ("cover", "本研究既涉及{x}，也覆盖了{y}。", "本研究既涉及……也覆盖……"),
    )),
)
ENUMERATION = r"^(?P<items>[^，。；]+(?:、[^，。；]+){2,})，(?P<predicate>(?:都|都会|均会|都将|都可能|都会对).+?)" + END
ENUMERATIONS = (
    ("wulunshi", "无论是{either}，{predicate}。", "无论是……"), ("range", "从{first}到{next_last}，再到{last}，{predicate}。", "从……到……再到……"), ("yiji", "{but_last}以及{last}，{predicate}。", "……以及……"),
    ("bulun", "不论{either}，{predicate}。", "不论……"), ("zhishe", "只要涉及{either}，都会{tail}。", "只要涉及……"),
)
OPENINGS = (
    ("summary-opening", "opening:summary", "any", "second", r"^(总的来说|总而言之|总体来看|总体而言|综合来看)，?", ("总体来看", "综合来看", "从整体上看")),
    ("note-opening", "opening:note", "any", "later", r"^(值得注意的是|需要指出的是)，?", ("需要注意的是", "值得进一步说明的是", "需要说明的是")),
    ("practical-opening", "opening:practical", "any", "balanced", r"^对于(?P<context>[^，]+?)而言，(?!.+?并不局限于.+?，更在于)", ("从{context}的实际需求来看", "就{context}而言", "对{context}来说", "放在{context}中看")),
)
IMPLICATION_OPENING = r"^(因此|由此可见|由此|基于此|在这种情况下)，"
IMPLICATION_OPENINGS = (
    ("based-on-this", "基于此，{rest}", "基于此"), ("in-this-case", "在这种情况下，{rest}", "在这种情况下"), ("it-shows", "这也说明，{rest}", "这也说明"), ("drop", "{ended}", "省略因果句首", PLAIN),
)
TRANSITIONS = (
    ("process", "在这一过程中，{rest}", "在这一过程中"), ("accompany", "与之相伴的是，{rest}", "与之相伴的是"), ("meanwhile", "同时，{rest}", "同时"), ("drop", "{ended}", "省略过渡句首", PLAIN),
)
FILLERS = (
    (r"(比较|相对)较为", "较为", "filler:degree"), (r"(非常|十分)(非常|十分)", r"\1", "filler:duplicate-intensity"),
    (r"(?P<prefix>.+?对(?P<object>.+?)进行了(?P<verb>讨论|分析))，并对(?P=object)进行了(?P=verb)", r"\g<prefix>", "filler:duplicate-object-verb"),
    (r"进行了分析，并且进行了分析", "进行了分析", "filler:duplicate-analysis"),
)
#: (family, rule, literal, prefers change, replacements)
LITERALS = (
    ("vague-scope", "filler:vague-scope", "在很多方面", "balanced", ("在多个层面", "在不同层面", "在若干方面")),
    ("vague-expression", "filler:vague-expression", "当前表述仍然比较概括", "balanced", ("现有表述仍偏概括", "现有论述仍显概括", "整体表述仍较为概括")),
    ("discussion-opening", "filler:discussion-opening", "当前讨论已经指出", "second_any", ("现有讨论已经表明", "已有讨论已经显示", "前面的讨论已经指出")),
)
TECHNICAL = r"[A-Za-z][A-Za-z0-9_.\-/]{2,}|checkpoints?/[^，。；\s]+|[\w.-]+\.(?:pth|pt|ckpt)|\[\d+\]"
STUDIED = r"^(?P<subject>[^，。；]{2,18}?)(?P<verb>研究了|分析了|讨论了|梳理了)(?P<object>[^，。；]{2,60})" + END
STUDIES = (("drop-le", "{subject}{base}{object}。", "减少了", PLAIN), ("object-study", "{subject}对{object}进行{base}。", "对……进行", PLAIN))
VERBS = "研究|分析|讨论|梳理|设计|评价|比较|验证"
FUNCTION_WORDS = (
    (rf"进行了(?P<object>[^，。；]{{2,30}})的(?P<verb>{VERBS})", r"\g<verb>了\g<object>"), (rf"进行了(?P<verb>{VERBS})", r"\g<verb>了"), (rf"进行(?P<verb>{VERBS})", r"\g<verb>"), ("并且", "并"),
    ("为了能够", "为"), (r"在(?P<context>[^，。；]{2,18})过程中", r"\g<context>过程中"), (r"在(?P<context>[^，。；]{2,18})背景下", r"\g<context>背景下"),
)
IN_PRACTICE = (r"在(?P<context>实际[^，。；]{2,18})中，", r"\g<context>下，")
WEAKENED = r"^(首先|其次|再次|此外|最后|综上所述)[，,](?P<body>.+)$"
PARALLELISM = r"^不仅要(?P<x>.+?)，?还要(?P<y>.+?)" + END
PARALLELISMS = (("compress", "{x}之外，还需要{y}。", "压缩排比", PLAIN), ("recast", "{x}是基础，{y}则决定了后续落实效果。", "改写排比骨架", PLAIN))
SLOGANS = (
    (r"为(?P<object>.+?)奠定坚实基础", r"为\g<object>提供基础"), ("具有重要意义并提供有力支撑", "具有一定意义，也能提供支撑"), ("形成完整闭环并实现有效提升", "形成较完整的衔接关系，并改善整体效果"),
)
NOMINAL = (r"(?P<a>[^，。；]{2,8})的(?P<b>[^，。；]{2,8})的(?P<c>[^，。；]{2,12})", r"\g<a>\g<b>的\g<c>")
#: recasts of single sentences, the first that fits: (at high intensity only, pattern, new text)
RECASTS = (
    (True, r"^(?P<a>本章|本文|本研究)围绕(?P<b>.+?)，(?P<c>.+?)" + END, "{a}以 {b} 为主线，{c}"),
    (True, r"^(?P<a>本研究|本文|本章)在(?P<b>[^，。；]{2,32})中主要遇到了(?P<c>.+?)" + END, "{a}在{b}中面对的主要挑战包括{c}"),
    (False, r"^为(?P<a>[^，。；]{3,42})，(?P<b>.+?)" + END, "在{a}这一目标下，{b}"),
    (False, r"^通过(?P<a>[^，。；]{3,48})，系统实现了(?P<b>.+?)" + END, "{a}使系统形成了{b}"),
    (False, r"^通过(?P<a>[^，。；]{3,48})，(?P<b>.+?)" + END, "{a}使得{b}"),
    (True, r"^尽管(?P<a>.+?)，但(?P<b>.+?)" + END, "{a}并不意味着相关工作已经完成，{b}"),
    (True, r"^这为(?P<a>.+?)提供了(?P<b>.+?)" + END, "{a}由此获得了{b}"),
    (False, r"^从(?P<a>[^，。；]{2,32})上看，(?P<b>.+?)" + END, "在{a}层面，{b}"),
    (False, r"^从(?P<a>[^，。；]{2,32})来看，(?P<b>.+?)" + END, "就{a}而言，{b}"),
    (False, r"^基于(?P<a>[^。！？?!]{2,36})的方法" + END, "另一类路径是基于{a}的方法"),
    (False, r"^(?P<a>该类方法|该方法|这种方法)在(?P<b>[^，。；]{2,36})中(?P<c>.+?)" + END, "在{b}中，{a}{c}"),
    (False, r"^在(?P<a>该分层架构|该系统架构|这一架构)中，(?P<b>.+?)" + END, "{a}将{b}"),
    (False, r"^(?P<a>[^，。；]{2,28}?)以(?P<b>[^，。；]{3,46})为基础，并(?P<c>.+?)" + END, "{b}构成了{a}的基础，{c}"),
    (False, r"^具体而言，(?P<a>.+?)" + END, "更具体地说，{a}"),
    (False, r"^同时，(?P<a>.+?)" + END, "{a}"),
    (False, r"^整体来看，(?P<a>.+?)" + END, "从整体上说，{a}"),
)

#: what a rule counts as; a name that ends in * stands for all rules that begin so, the first entry that fits decides
STRUCTURAL = (
    (("fusion:context-followup", "fusion:objective-followup"), ("pair_fusion", "sentence_cluster_merge")),
    (("fusion:implication-followup",), ("conclusion_absorb", "conclusion_absorption", "sentence_cluster_merge")),
    (("structure:parallel-enumeration",), ("enumeration_reframe",)), (("structure:split-long-sentence",), ("sentence_split", "sentence_cluster_split")),
    (("structure:merge-short-followup",), ("sentence_merge", "sentence_cluster_merge")),
    (("paragraph:topic-sentence-preserved", "paragraph:opening-style-guard"), ("topic_sentence_preservation",)),
    (("paragraph:*",), ("paragraph_reorder", "discourse_reordering", "narrative_path_rewrite")), (("cluster:*",), ("sentence_cluster_rewrite", "discourse_reordering", "narrative_path_rewrite")),
    (("sentence:study-focus",), ("topic_reframe",)),
    (("sentence:developmental-recast", "sentence:scope-risk", "sentence:parallel-expansion", "sentence:parallel-expansion-short", "natural:break-parallelism", "natural:weaken-template-connectors"), ("clause_reorder",)),
    (("subject:merge-consecutive",), ("merge_consecutive_subject_sentences",)), (("subject:drop",), ("subject_drop",)), (("subject:variation",), ("subject_variation",)),
    (("subject:meta-compression",), ("meta_compression",)), (("subject:followup-absorb",), ("followup_absorb",)),
    (("human:partial-keep", "human:uneven-rewrite-distribution"), ("uneven_rewrite_distribution",)),
)
CHAINED = ("merge_consecutive_subject_sentences", "subject_drop", "subject_variation", "meta_compression", "followup_absorb")
DISCOURSE = (
    (("fusion:context-followup", "fusion:objective-followup", "structure:merge-short-followup"), ("sentence_cluster_rewrite", "sentence_cluster_merge", "transition_absorption")),
    (("fusion:implication-followup",), ("sentence_cluster_rewrite", "sentence_cluster_merge", "conclusion_absorb", "conclusion_absorption")), (("structure:parallel-enumeration",), ("enumeration_reframe",)),
    (("paragraph:topic-sentence-preserved", "paragraph:opening-style-guard"), ("preserve_explicit_subject_if_clarity_needed",)),
    (("paragraph:*", "cluster:*"), ("proposition_reorder", "discourse_reordering", "narrative_path_rewrite")), (("subject:meta-compression",), ("meta_compression",)),
    (("subject:merge-consecutive", "subject:drop", "subject:variation", "subject:followup-absorb"), ("subject_chain_compression", "compress_subject_chain")),
    (("sentence:scope-risk",), ("rationale_expansion",)), (("sentence:developmental-recast",), ("narrative_path_rewrite",)),
    (("structure:split-long-sentence",), ("rebuild_sentence_rhythm", "sentence_cluster_split")), (("natural:function-word",), ("reduce_function_word_overuse",)),
    (("natural:weaken-template-connectors",), ("weaken_template_connectors",)), (("natural:break-parallelism",), ("break_parallelism",)), (("natural:dense-nominal",), ("rewrite_dense_nominal_phrases",)),
    (("natural:keep-technical-dense",), ("keep_original_if_technical_density_is_high",)), (("human:partial-keep", "human:uneven-rewrite-distribution"), ("uneven_rewrite_distribution",)),
)
PATTERNS = (
    (("subject:meta-compression", "natural:dense-nominal", "subject:merge-consecutive"), ("compress",)), (("sentence:scope-risk", "sentence:parallel-expansion", "sentence:parallel-expansion-short"), ("expand",)),
    (("fusion:context-followup", "fusion:objective-followup", "structure:merge-short-followup", "cluster:sentence-cluster-merge"), ("merge",)), (("structure:split-long-sentence",), ("split",)),
    (("paragraph:topic-sentence-preserved", "paragraph:opening-style-guard", "human:partial-keep", "local:light-partial-retain-with-local-rephrase", "readability:*"), ("partial_keep",)),
    (("paragraph:*", "cluster:cause-effect-reframe", "cluster:discourse-reordering", "cluster:local-sentence-reorder"), ("reorder",)),
    (("natural:weaken-template-connectors", "opening:transition", "local:soften-overexplicit-transition"), ("soften",)),
    (("sentence:*", "cluster:narrative-path-rewrite", "local:reshape-supporting-sentence", "local:weaken-overfinished-sentence"), ("reframe",)),
    (("local:reduce-sentence-uniformity", "local:introduce-local-hierarchy"), ("merge",)),
)
CLUSTER_ACTIONS = (
    "sentence_cluster_rewrite", "sentence_cluster_merge", "sentence_cluster_split", "proposition_reorder", "discourse_reordering", "narrative_path_rewrite", "meta_compression",
    "subject_chain_compression", "conclusion_absorb", "conclusion_absorption", "enumeration_reframe", "transition_absorption",
)
