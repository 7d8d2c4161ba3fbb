"""Patterns, as Java regular expressions with explicit classes.

Fixed values: the patterns and word lists below decide what counts as a
citation, a heading and so on, so they must be what they are.
"""

from __future__ import annotations

CJK = r"[\x{4e00}-\x{9fff}]"
SENTENCE = r"[^。！？?!]+[。！？?!]?"
CITATION = r"\[\d+\](?:\[\d+\])*|\([A-Z][A-Za-z\-]+,\s*\d{4}[a-z]?\)|（[A-Z][A-Za-z\-]+,\s*\d{4}[a-z]?）"
NUMBER = r"[0-9]+(?:\.[0-9]+)?%?"
ENGLISH_WORD = r"[A-Za-z]+(?:-[A-Za-z]+)*"
HEADING = r"^\s{0,3}#{1,6}\s+"
HEADING_LINE = r"(?m)^(?:\s{0,3}#{1,6}\s+.*|第[一二三四五六七八九十百0-9]+章.*|摘\s*要\s*$|关\s*键\s*词[:：]?.*$|Abstract\s*$|Keywords[:：]?.*)$"
SPECIAL_HEADING = r"^(?:第[一二三四五六七八九十百0-9]+章.*|摘\s*要\s*$|关\s*键\s*词[:：]?.*$|Abstract\s*$|Keywords[:：]?.*)$"
REFERENCE = r"^\[\d+\]"
REFERENCE_LINE = r"(?m)^\[\d+\].*$"
CAPTION_LINE = r"(?m)^\s*(?:图|表)\s*\d+(?:-\d+)?[^\n]*$|^\s*(?:Figure|Table)\s*\d+[^\n]*$"
CAPTION_FRAGMENT = r"(?:如图|如表|图\s*\d+(?:-\d+)?|表\s*\d+(?:-\d+)?|Figure\s*\d+|Table\s*\d+)[^。\n]*?(?:所示|如下|展示|流程)[：:]?"
CAPTION = r"(?m)^(?:(?:图|表)\s*\d+(?:-\d+)?[^\n]*|(?:Figure|Table)\s*\d+[^\n]*)$"
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
LINK = r"(?<!!)\[[^\]]+\]\([^)]+\)"
LINK_DEF = r"(?m)^\[[^\]]+\]:\s+\S+.*$"
AUTOLINK = r"<https?://[^>\n]+>"
URL = r"https?://[^\s<>()]+(?:\([^\s<>()]*\)[^\s<>()]*)*"
FORMULA = r"\$\$|\\\(|\\\[|\\tag\{"
FORMULA_BLOCK = r"(?ms)^\$\$.*?^\$\$[ \t]*$"
FORMULA_INLINE = r"\\\(.+?\\\)|\\\[.+?\\\]"
FORMULA_LINE = r"(?m)^\s*(?:\*+\s*)?(?:[\(（][^)）]+[\)）]\s*)?(?:[A-Za-z][A-Za-z0-9_]*|[α-ωΑ-Ωτλσ]+).{0,40}?=\s*.+$"
PATH = r"(?:[A-Za-z]:\\[^\s<>()]+|(?:[\w.-]+/)+[\w./-]+|[\w.-]+\.(?:pth|pt|ckpt|png|jpg|jpeg|pdf))"
CHECKPOINT = r"\b(?:checkpoint[s]?/[^\s<>()]+|[\w.-]+\.(?:pth|pt|ckpt))\b"
TERMS = (
    r"\b[A-Z]{2,}[A-Za-z0-9_-]*\b",
    r"\b[A-Za-z]+_[A-Za-z0-9_]+\b",
    r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b",
    r"\b[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9_-]*\b",
    r"\b[A-Za-z]+[0-9]+[A-Za-z0-9_-]*\b",
    r"[A-Za-z][A-Za-z0-9_-]{2,}(?=[\x{4e00}-\x{9fff}，。；、:：\s]|$)",
)
FENCE = r"(?ms)^(?<fence>`{3,}|~{3,})[^\n]*\n.*?^\s*\k<fence>[ \t]*$"
INLINE_MATH = r"(?<!\$)\$(?!\$)(?:\\.|[^$\n])+\$(?!\$)"
INLINE_CODE = r"`[^`\n]+`"
LIST_LINE = r"^\s*(?:[-*+]\s+|\d+\.\s+)"
LIST_START = r"^\s*(?:[-*+]\s+|\d+\.\s+|l\s+)"
TABLE_RULE = r"^[:\-\|\s]+$"
LINK_DEF_LINE = r"^\[[^\]]+\]:\s+\S+"

META_OPENERS = ("本研究的主题为", "本文讨论的核心问题是", "本研究尝试回应", "本研究聚焦于", "本研究围绕")
TEMPLATE_CONNECTORS = ("同时", "与此同时", "因此", "此外", "由此", "在这种情况下", "综上所述")
META_SUBJECTS = ("本研究", "本文", "该研究", "该系统")
STIFF_OPENERS = ("本研究", "本文", "从", "对", "这也意味着", "基于此", "在这种情况下", "总体来看", "综合来看")
IMPLICATION_OPENER = r"^(?:因此|由此|这也意味着|基于此|在这种情况下|正因为如此|在此基础上)[，,\s]*"
FUNCTION_WORDS = r"(?:进行了|进行|在[^，。；]{2,20}(?:中|过程中|背景下)|的[^，。；]{1,12}的)"
STIFF_VERBS = r"(?:进行|构建|实现|确保|提升|开展|推动)"
PARALLELISM = r"(?:不仅要.+?还要|应从.+?层面|奠定坚实基础|具有重要意义并提供有力支撑|形成完整闭环并实现有效提升)"
DENSE_NOMINAL = r"(?:[^，。；]{1,8}的){3,}[^，。；]{1,12}"
LIGHT_EDIT = (
    r"(?:本研究|本文).{0,12}(?:方法|模型|系统|实现|部署|阈值|实验|流程|模块|架构|定义|结论)|"
    r"(?:方法|系统|实现|部署|结论|定义|架构|模型).{0,10}(?:如下|主要|包括|采用)"
)
META_TOPIC = r"(?:方法|模型|系统|实现|部署|阈值|实验|流程|模块|架构|定义|总结|展望|结论)"
LEADING_NUMBER = r"^[（(]?\d+[）)]"

# chapters
CHAPTER_FORMULA = r"\$\$|\\\(|\\\[|\\tag\{|\\begin\{|\\end\{"
CHAPTER_PATH = r"(?:[A-Za-z]:\\[^\s<>()]+|(?:[\w.-]+/)+[\w./-]+|checkpoint[s]?/[^\s<>()]+|[\w.-]+\.(?:pth|pt|ckpt|png|jpg|jpeg|pdf))"
TECH_TOKEN = r"[A-Za-z][A-Za-z0-9_.\-/]{2,}|checkpoint[s]?/[^\s<>()]+|[\w.-]+\.(?:pth|pt|ckpt)"
TECH_TOKEN_OR_CITATION = TECH_TOKEN + r"|\[\d+\]"
CHAPTER_HEADING = r"^\s{0,3}#{1,6}\s+|^第[一二三四五六七八九十百0-9]+章|^\d+(?:\.\d+)+\s+\S"
MIXED_MARKER = r"(?i)(?:图|表|系统|界面|数据库|接口|路径|版本|checkpoint|阈值|字段|E-R)"
TITLE_WORDS = (
    ("future_work", ("展望", "未来工作", "后续工作", "future")),
    ("conclusion", ("总结", "结论", "本章小结", "小结", "conclusion")),
    ("error_analysis", ("错误分析", "误差分析", "失败分析", "消融", "边界样本", "error")),
    ("result_analysis", ("结果分析", "实验结果", "关键结果", "结果", "result")),
    ("evaluation_metrics", ("评价指标", "评估指标", "指标", "metrics")),
    ("experiment_setup", ("实验设置", "实验环境", "参数设置", "实验配置", "setup")),
    ("dataset_description", ("数据集", "数据说明", "数据来源", "dataset")),
    ("deployment_description", ("部署", "运行环境", "服务实现", "推理服务", "deployment")),
    ("system_workflow", ("系统流程", "工作流", "页面", "交互", "流程", "workflow")),
    ("system_architecture", ("系统总体架构", "系统架构", "系统实现", "功能设计", "前端", "后端")),
    ("loss_function", ("损失函数", "损失", "loss")),
    ("training_strategy", ("训练策略", "课程学习", "训练", "优化策略", "training")),
    ("mechanism_explanation", ("判别机制", "机制", "原理", "模块", "可解释性")),
    ("model_architecture", ("模型架构", "网络结构", "模型结构", "架构")),
    ("problem_definition", ("问题形式化", "问题定义", "任务定义", "定义", "符号")),
    ("method_design", ("方法设计", "研究方法", "方案设计", "方法", "method")),
    ("literature_review", ("国内外研究现状", "相关研究", "文献综述", "研究现状", "综述", "review")),
    ("challenge_analysis", ("挑战", "风险", "问题分析", "捷径问题", "困难", "分布偏移")),
    ("significance", ("研究意义", "意义", "价值")),
    ("background", ("研究背景", "绪论", "引言", "背景", "introduction")),
)
CONTENT_WORDS = (
    ("future_work", ("未来工作", "后续工作", "展望", "未来可")),
    ("conclusion", ("总结而言", "综上", "本研究的核心价值", "本文完成")),
    ("error_analysis", ("误报", "错误", "失败", "边界样本", "漂移")),
    ("result_analysis", ("实验结果", "结果表明", "结果显示", "分析可以看出")),
    ("evaluation_metrics", ("accuracy", "precision", "recall", "f1", "auc", "评价指标", "召回率", "精度")),
    ("experiment_setup", ("实验设置", "batch", "epoch", "learningrate", "参数", "阈值")),
    ("dataset_description", ("数据集", "样本", "训练集", "验证集", "测试集")),
    ("deployment_description", ("部署", "flask", "接口", "版本", "checkpoint", "运行环境")),
    ("system_workflow", ("页面", "交互", "上传", "检测流程", "展示")),
    ("system_architecture", ("前端", "后端", "架构", "模块", "系统")),
    ("loss_function", ("损失", "loss", "公式", "目标函数")),
    ("training_strategy", ("训练", "课程学习", "优化", "缓冲区")),
    ("mechanism_explanation", ("机制", "判别", "决策路径", "分支", "融合")),
    ("model_architecture", ("模型", "架构", "网络", "语义分支", "频域分支")),
    ("problem_definition", ("定义为", "建模为", "表示为", "给定", "输出概率")),
    ("method_design", ("方法", "设计", "方案", "框架")),
    ("literature_review", ("现有研究", "已有方法", "研究中", "文献", "相关工作")),
    ("challenge_analysis", ("挑战", "风险", "问题", "不足", "困难")),
    ("significance", ("意义", "价值", "重要", "有助于")),
    ("background", ("近年来", "随着", "背景", "现实场景")),
)
CONSERVATIVE_TYPES = ("problem_definition", "loss_function", "evaluation_metrics", "experiment_setup", "deployment_description")
HIGH_TYPES = ("background", "significance", "literature_review", "challenge_analysis", "result_analysis", "error_analysis", "conclusion", "future_work")
TECHNICAL_MEDIUM_TYPES = ("dataset_description", "experiment_setup", "evaluation_metrics", "system_architecture", "system_workflow", "deployment_description", "training_strategy")
#: priority -> (coverage, changed ratio, discourse, cluster)
QUOTAS = {"high": (0.60, 0.50, 2, 1), "medium": (0.40, 0.25, 1, 0), "conservative": (0.0, 0.0, 0, 0)}

# readability
PREDICATE = (
    r"(?:是|为|有|具有|能够|可以|需要|提出|构建|采用|表明|说明|体现|提升|降低|实现|形成|保持|依赖|包括|包含|用于|面向|围绕|描述|展示|验证|支持|导致|反映|解决|完成|提供|增强|"
    r"引入|关注|分析|设计|部署|训练|评价|计算|识别|检测|分类|生成|保留|冻结|保护|约束|避免|使|遇到|经历|达到|减少|增加|优于|适合|支撑|承担|作为|展现|呈现|可能|学到|偏向)"
)
SUBJECT = (
    r"^(?:本研究|本文|该研究|研究内容|该系统|系统|该模型|模型|该方法|该策略|该设计|这种设计|这一过程|这一结果|这一问题|该问题|实验结果|结果|方法|模型结构|检测流程|系统实现|用户|图像|"
    r"门控机制|融合层|分支贡献|某一分支)"
)
NOMINAL_HEAD = r"(?:研究|系统|模型|方法|结果|问题|任务|设计|策略|流程|结构|数据)"
DANGLING_EXEMPT = ("同时", "此外", "由此", "相应地", "其中", "需要说明的是")
DANGLING = r"^(?:并进一步|并且进一步|并(?=提出|形成|实现|说明|表明|进一步|完成|用于)|而是|由此|同时|此外|在这种情况下|相应地|其中|需要说明的是|从而|进而|随后|之后|以及)[，,\s]*"
COMPARISON = r"^是比.+更.+"
PREPOSITION = r"^(?:在|通过|基于|面向|围绕).+(?:之后|之中|过程中)[。！？?!]?$"
COLON_TAIL = r"：\s*(?:在|通过|基于|面向|围绕)[^，,；;。！？?!]{2,30}[。！？?!]?$"
RESULT_LEAD = r"^(?:结合|根据|基于).{2,35}(?:结果|数据|分析|实验|评测|诊断)[。！？?!]?$"
VERB_OPEN = r"^(?:强调|说明|体现|支持|展示|反映|用于|包括|包含|呈现|提供|形成|实现)"
CAUSATIVE = r"^(?:使|让)[^。！？?!]{8,}"
TAXONOMY = r"^基于.{2,40}的方法(?:\[\[KEEP:CORE_CITATION:\d+\]\])?[。！？?!]?$"
LIST_LEAD = r"(?:如下|如下所示|核心表达式如下|定义如下|包含以下[一二三四五六七八九十\d]+个部分)[:：]?[。！？?!]?$"
ESPECIALLY = r"^[A-Za-z][A-Za-z0-9_-]*(?:尤其是|特别是).{2,50}[。！？?!]?$"
TECH_MARKER = r"\[\[KEEP:CORE_[A-Z_]+:\d+\]\]|[A-Za-z][A-Za-z0-9_.\-/]{2,}|checkpoint[s]?/[^，。；\s]+|[\w.-]+\.(?:pth|pt|ckpt)|\[\d+\]"
IMPLICATION = r"^(?:因此|由此|由此可见|基于此|在此基础上)[，,\s]*"
ORDINAL = r"^第[一二三四五六七八九十\d]+[，,\s]*"

# evidence
UNSUPPORTED = (
    r"\b20\d{2}年(?:AIGC|生成式|内容生态|传播环境|舆论场|虚假信息)",
    r"(?:超过|高于|接近)(?:八成|半数|九成|七成|六成|五成|四成|三成)",
    r"(?:绝大多数|大多数|主流观点|业界通常认为|普遍认为|领域共识|业内普遍认为)",
    r"(?:投诉|内容生态|真实世界中|行业现状|平台治理|运营人员)",
)
COMMENTARY = (
    r"(?:正如[^。；]{0,40}所认为)", r"(?:终于摆脱|终于脱离|挣脱出来|被击穿|逼近满分|拖进来|走向终点)", r"(?:宁可错杀|宁可放过)",
    r"(?:如同|仿佛)[^。；]{0,36}(?:手术|判决书|幻想|剧情|故事)",
)
METAPHOR = (r"(?:幻想的破灭|边界修复手术|判决书|挣脱出来|终于摆脱|路径终点)", r"(?:如同一次|像一次)[^。；]{0,24}(?:手术|修复|判决|拉锯|较量)")
AUTHORIAL = (r"^(?:我们|我们的)[，,\s]*", r"(?:本工作证明了|这项工作的终点|我们的工程价值|我们选择)", r"(?:主流观点|业界通常认为|普遍认为)")
REGISTER = (
    r"^(?:本研究|本文|研究|模型|系统|语义分支|频域分支|噪声分支|课程采样器|判别路径|实验|结果)",
    r"(?:表明|说明|显示|采用|通过|将|把|负责|实现|约束|缓解|保持|比较|构建|设计)",
)

# naturalization
BUREAUCRATIC = (
    r"^(?:本研究面向[^。；，,]{2,36}需求|在方法上|围绕这一目标|在解决[^。；]{2,60}目标下|"
    r"在完成[^。；]{2,48}后|在[^。；，,]{2,24}层面|本研究具有显著[^。；]{0,24}价值|本研究的主题为)"
)
SLOGAN = r"(?:旨在构建|旨在通过|以实现[^。；]{1,36}(?:落地|闭环)|形成(?:了)?完整闭环|具有显著[^。；]{0,24}价值|提供清晰方法论路径|筑牢第一道防线)"
OVERSTRUCTURED = r"(?:并不是[^。；]{2,80}而是|不仅[^。；]{2,80}(?:同时|还)|在结构上[^。；]{2,80}在决策层面|第一[^。；]{2,60}进而第二)"
EXPLICIT_SUBJECT = r"^(本研究|本文|研究|系统|模型|该系统|该模型)"
DELAYED_MAIN = r"^在(?:解决|完成|推进|实现|[^，。；]{2,16})(?:[^，。；]{18,90})[，,](?:本研究|本文|研究|系统|模型)"
DELAYED_PREFIX = r"(?:目标|过程|背景|层面|基础|情况下|完成|解决)"
WRAPPER = r"(?:^在[^，。；]{2,28}(?:中|下|过程中)[，,]|^具体而言[，,]|^围绕[^，。；]{2,28}[，,]|^从[^，。；]{2,28}角度(?:来看)?[，,]|^就[^，。；]{2,28}而言[，,])"
CONNECTOR = r"(?:不仅[^。；]{2,80}(?:还|也|同时)|并且|从而|进而|同时)"
NOMINALIZATION = r"(?:进行(?:评估|分析|验证|控制|处理)|实现(?:控制|部署|落地|融合)|提供(?:支撑|支持|基础|路径))"
PASSIVE = r"(?:被视为|属于|得到体现)"
LOGIC_MARK = r"(?:，|；|并且|从而|进而|同时|不仅|还|以便|用于|通过)"

# second-language texture
L2_FUNCTION = r"(?:的|了|来|进行|会|能够|还有|以此|通过[^。；]{0,18}来|是用来|用来)"
L2_TEXTURE = r"(?:是用来|进行[^。；]{0,12}工作|能够|还有|这个(?:模型|系统|分支|模块|策略)|这一类方法|通过[^。；]{0,18}来)"
L2_COLLOQUIAL = r"(?:这块|这边|大家|超|超级|真的|其实|大白话|搞定|拉满|靠谱|玩)"
L2_UNGRAMMATICAL = r"(?:本研究研究|研究研究|是了|可以用于了|被是用来|能够(?:复杂度|并非|更新|必须)|进行验证算法|辅助进行分析与诊断|，，|。。|的的|了了|进行进行)"
L2_NATIVE = r"(?:兼顾|适用于|用于|构成|负责|提取特征|实现融合|形成闭环)"
L2_EXPLANATORY = r"(?:主要的作用是|这个.+?会|通过.+?来|是用来|的工作)"

# suggestions
VAGUE = ("一些研究", "很多研究", "相关研究", "许多学者", "在很多方面", "具有重要意义", "起到了重要作用", "值得进一步研究", "many studies", "some studies", "important role", "significant impact")
RESEARCH_HINTS = ("研究", "文献", "实验", "调查", "样本", "study", "survey", "experiment")
CASE_HINTS = ("案例", "实践", "应用", "场景", "对象", "现象", "问题", "case", "scenario")
SAMPLE_HINTS = ("样本", "调查", "实验", "问卷", "访谈", "survey", "experiment")
SUGGEST_YEAR = r"\b(?:19|20)\d{2}\b"
SUGGEST_CITATION = r"(?i)\[[0-9,\-\s]+\]|\((?:19|20)\d{2}\)|et al\."
SUGGESTIONS = (
    "可补充真实文献来源、引用位置或已有研究脉络。",
    "可补充真实年份、时间范围或研究阶段信息。",
    "可补充具体案例、场景或研究对象细节。",
    "可补充真实样本量、方法设置或对象说明。",
    "可补充可核验的事实依据，以减少空泛表述。",
)
