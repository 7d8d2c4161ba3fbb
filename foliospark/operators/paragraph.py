"""The paragraph rewriter: ordered rules over a document's paragraphs, with the memory of what was used before.

A paragraph is a list of labelled sentences.  A rule looks at one sentence, two
neighbours or the whole list; where it has several ways to put something, the
chooser takes the least used one, and memory runs over all paragraphs of the
document, so a document is one row: an array of paragraphs goes in, an array of
results comes out, without a shuffle.  The frames are data (operators.frames).
Nothing is random: equal documents give equal results.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from difflib import SequenceMatcher
from math import ceil
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import families
from ..functions import patterns as P
from ..functions.text import split_outside_brackets
from . import frames as R
from .mask import TOKEN

META = P.META_SUBJECTS
_CJK = re.compile("[一-鿿]")


# ---- sentences
def core(s: str) -> str:
    return re.sub(r"[。！？?!]+$", "", s).strip()


def same_key(s: str) -> str:
    return re.sub(r"\s+", "", core(s))


def ended(s: str) -> str:
    t = s.strip()
    if not t or t.endswith("]]") or t[-1] in "。！？?!.:：;；":
        return t
    return t + ("。" if _CJK.search(t) else ".")


def after_comma(s: str) -> str:
    return s.lstrip("，, ")


def opening(s: str, words: Iterable[str]) -> tuple[str, str]:
    """(the longest of the words that the sentence begins with, or nothing, and the rest)."""
    t = s.strip()
    for w in sorted(words, key=len, reverse=True):
        if t.startswith(w):
            return w, after_comma(t[len(w) :])
    return "", t


def label(s: str) -> str:
    t = core(s)
    if t.startswith(R.SUMMARY + R.IMPLICATION):
        return "conclusion"
    return next((name for name, p in R.LABELS if re.search(p, t)), "detail")


def subject_head(s: str) -> str:
    t = opening(opening(s, R.IMPLICATION)[1], R.TRANSITION)[1]
    for p in R.SUBJECT_LEADS:
        t = re.sub(p, "", t)
    t = after_comma(t)
    known = next((m for m in (*META, "研究", "系统", "该机制", "该设计") if t.startswith(m)), None)
    if known:
        return known
    m = re.match(R.SUBJECT_HEAD, t)
    return m["head"] if m else t[:6]


def subject_and_body(s: str) -> tuple[str, str]:
    t = core(s.strip())
    for m in (*META, "研究", "系统"):
        if t.startswith(m):
            return m, after_comma(t[len(m) :])
    return "", t


def varied(subject: str, body: str, system: bool = False) -> str:
    """The body under another name of its subject."""
    body = after_comma(body[2:]) if body.startswith("同时") else body
    if subject.endswith("系统"):
        return ("该系统" if subject == "该系统" and not system else "系统") + body
    study = subject in ("本研究", "该研究")
    return body if study and body.startswith("研究") else ("研究" if study else "本文") + body


def explicit(body: str) -> bool:
    """What is said of a subject that must stay named."""
    return any(m in core(body.strip()) for m in R.EXPLICIT)


def with_particle(s: str, particle: str = "也") -> str:
    if s.startswith((particle, "文章", "本文", "本研究", "研究")):
        return s
    m = re.match(R.PARTICLE, s)
    return m["subject"] + particle + m["lemma"] + m["rest"] if m else s


def followups(right: str) -> list[str]:
    for verb, noun in R.FOLLOWUPS:
        pattern = R.FOLLOWUP.format(verb=verb[:-1] + ("(?:了)?" if noun == "提及" else "了"))
        if m := re.match(pattern, right):
            o = m["object"].strip()
            return [f"同时{verb}{o}", f"也{verb}{o}", f"{noun}也覆盖了{o}"]
    return [with_particle(right), "同时" + right.lstrip("并"), f"相关分析也覆盖了{right}"]


def _is(p: str, s: str) -> bool:
    return bool(re.search(p, s))


def dangling_opening(s: str) -> bool:
    t = re.sub(r"[。！？?!；;]+$", "", s.strip())
    return bool(t) and not _is(families.NOT_DANGLING, t) and _is(families.DANGLING_OPENING, t)


def topic_sentence(s: str) -> bool:
    t = re.sub(r"[。！？?!；;]+$", "", s.strip())
    if not t or dangling_opening(t):
        return False
    return _is(families.TOPIC_OPENING, t) and _is(families.TOPIC_FUNCTION, t) or any(_is(p, t) for p in families.TOPIC_FORMS)


def valid_opening(s: str) -> bool:
    return not dangling_opening(s) or topic_sentence(s)


def locked_opening(first: str) -> bool:
    """Whether a paragraph's first sentence is its topic sentence, which stays first."""
    t = re.sub(r"[。！？?!；;]+$", "", first.strip())
    long_topic = len(t) >= 18 and _is(families.TOPIC_FUNCTION, t)
    other = any(_is(p, t) for p in (families.SKELETON_CONCLUSION, families.DANGLING_OPENING, families.SKELETON_SUPPLEMENT, families.EVIDENCE)) or len(re.findall(P.NUMBER, t)) >= 2
    return topic_sentence(first) or long_topic and not other


def similarity(a: str, b: str) -> float:
    return SequenceMatcher(a=same_key(a), b=same_key(b)).ratio()


# ---- memory and choice
class Choice(NamedTuple):
    key: str
    text: str
    surface: str
    plain: bool = False

    @property
    def keeps(self) -> bool:
        return self.key.endswith(":keep")


def template(family: str, c: Choice) -> str:
    """The family of templates of a choice, or nothing."""
    if c.plain:
        return ""
    for name, rules, surfaces, words in R.TEMPLATES:
        if family in rules or c.surface in surfaces or any(w in c.surface or w in c.text for w in words):
            return name
    return ""


def strict(c: Choice) -> bool:
    return c.surface in R.STRICT_SURFACES or c.text.startswith("从") and "角度看" in c.text


@dataclass
class Memory:
    """What a document's paragraphs have used so far: counts by kind, of the document and of the paragraph, and the last few."""

    all: Counter = field(default_factory=Counter)
    here: Counter = field(default_factory=Counter)
    recent: dict = field(default_factory=lambda: {k: deque(maxlen=R.RECENT) for k in ("key", "surface", "template")})
    paragraph: int = 0

    def next_paragraph(self) -> int:
        self.here.clear()
        self.paragraph += 1
        return self.paragraph

    def keeps(self, family: str, choices: list[Choice], prefer: bool) -> bool:
        """Whether the original is the better choice at once."""
        rule_like = family in R.RULE_LIKE
        if not prefer and any(rule_like and not c.plain or template(family, c) for c in choices):
            return True
        if self.here["family", family] or self.all["rule", family] >= R.RULE_LIMIT:
            return True
        return any(
            strict(c) and self.all["surface", c.surface] >= R.STRICT_LIMIT
            or (t := template(family, c)) and (self.here["template", t] >= R.PARAGRAPH_LIMIT or self.all["template", t] >= R.DOCUMENT_LIMIT)
            for c in choices
        )

    def penalty(self, family: str, c: Choice, prefer: bool) -> float:
        out = 4.0 * self.all["key", c.key] + 3.0 * self.all["surface", c.surface] + 4.0 * (c.key in self.recent["key"]) + 5.0 * (c.surface in self.recent["surface"])
        if t := template(family, c):
            out += 3.5 * self.all["template", t] + 6.0 * self.here["template", t] + 4.0 * (t in self.recent["template"])
        if family in R.RULE_LIKE and not c.plain and not c.keeps:
            out += 3.0 * self.all["rule", family] + 5.0 * self.here["rule", family]
        if strict(c):
            out += 12.0 + 8.0 * self.all["surface", c.surface]
        return out + ((6.0 if prefer else -1.0) if c.keeps else 0.0 if prefer else 1.0)

    def note(self, family: str, c: Choice) -> None:
        t = template(family, c)
        for kind, name in (("family", family), ("template", t), ("rule", family if family in R.RULE_LIKE and not c.plain else "")):
            if name:
                self.all[kind, name] += 1
                self.here[kind, name] += 1
        self.all["key", c.key] += 1
        self.all["surface", c.surface] += 1
        for kind, value in (("key", c.key), ("surface", c.surface), ("template", t)):
            if value:
                self.recent[kind].append(value)

    def choose(self, family: str, source: str, choices: list[Choice], prefer: bool, may_keep: bool) -> Choice:
        """The choice with the least penalty, beginning at a place that the source and the family's use decide."""
        keep = Choice(f"{family}:keep", source, "keep-original")
        if may_keep and self.keeps(family, choices, prefer):
            return keep
        every = [*choices, keep] if may_keep else choices
        turn = (sum(map(ord, same_key(source))) + self.all["family", family]) % len(every)
        turned = every[turn:] + every[:turn]
        best = min(range(len(turned)), key=lambda i: self.penalty(family, turned[i], prefer) + 0.01 * i)
        if not turned[best].keeps:
            self.note(family, turned[best])
        return turned[best]


@dataclass(frozen=True)
class Unit:
    text: str
    label: str
    sources: tuple[int, ...]


@dataclass
class Run:
    """One call of the rewriter on one paragraph."""

    memory: Memory
    mode: str = "balanced"
    round: int = 1
    depth: str = "developmental_rewrite"
    intensity: str = "medium"
    rules: list[str] = field(default_factory=list)

    @property
    def later(self) -> bool:
        return self.mode == "strong" or self.round > 1

    def when(self, how: str | bool) -> bool:
        if isinstance(how, bool):
            return how
        return {"yes": True, "later": self.later, "balanced": self.mode != "conservative", "conservative": self.mode == "conservative", "second_any": self.round > 1, "second": self.mode != "conservative" and self.round > 1}[how]

    def may(self, who: str) -> bool:
        return who == "any" or self.mode == "strong" or who == "balanced" and self.mode == "balanced"

    def put(self, family: str, rule: str, source: str, frames: Iterable[tuple], fields: dict, prefer: bool, may_keep: bool = False) -> str:
        name = R.FAMILY.get(family, family)
        choices = [Choice(f"{name}:{f[0]}", f[1].format(**fields), f[2], len(f) > 3) for f in frames]
        got = self.memory.choose(name, source, choices, prefer, may_keep)
        if got.text == source:
            return source
        self.rules.append(rule)
        return got.text

    def pair(self, family: str, a: Unit, b: Unit, prefer: bool, new_label: str | None = None, **fields: str) -> Unit:
        rule, choices = R.PAIRS[family]
        return Unit(self.put(family, rule, a.text + b.text, choices, fields, prefer), new_label or a.label, a.sources + b.sources)


# ---- rules over two neighbours
def compress_topic(run: Run, a: Unit, b: Unit) -> Unit | None:
    """A topic and the work on it, of one subject, become one sentence."""
    topic = next((m["topic"].strip("，, ") for p in R.TOPICS if (m := re.match(p, core(a.text.strip())))), None)
    subject, body = subject_and_body(b.text)
    if not topic or subject not in META or subject != subject_head(a.text) or not _is(R.WORK, body):
        return None
    return run.pair("meta-compression", a, b, True, "objective", topic=topic, body=body)


def absorb(run: Run, a: Unit, b: Unit) -> Unit | None:
    """An implication about the study goes into the sentence before it."""
    prefix, rest = opening(b.text, R.IMPLICATION)
    subject, body = subject_and_body(rest)
    if not prefix or subject not in META or not body or not core(a.text):
        return None
    return run.pair("subject-followup", a, b, run.later, left=core(a.text), body=body, varied=varied(subject, body), system=varied(subject, body, True))


def merge_subjects(run: Run, a: Unit, b: Unit) -> Unit | None:
    subject, body = subject_and_body(b.text)
    if subject not in META or subject != subject_head(a.text) or not body:
        return None
    return run.pair("subject-merge", a, b, True, left=core(a.text), body=body)


def vary_subject(run: Run, u: Unit) -> Unit | None:
    subject, body = subject_and_body(u.text)
    if subject not in META or not body or explicit(body):
        return None
    v = varied(subject, body)
    frames = (("research", "{v}。", "研究"), ("study", "{subject}{body}。", subject), ("focus", "围绕这一目标，{v}。", "围绕这一目标"))
    return replace(u, text=run.put("subject-variation", "subject:variation", u.text, frames, {"v": v, "subject": subject, "body": body}, run.later))


def drop_subject(run: Run, u: Unit) -> Unit | None:
    subject, body = subject_and_body(u.text)
    if subject not in META or not body or explicit(body):
        return None
    frames = (("base", "在此基础上，{body}。", "在此基础上"), ("accordingly", "相应地，{body}。", "相应地"))
    return replace(u, text=run.put("subject-drop", "subject:drop", u.text, frames, {"body": body}, run.mode == "strong" and run.round > 1))


def drop_embedded(run: Run, u: Unit) -> Unit | None:
    m = re.match(R.EMBEDDED, core(u.text))
    if not m or not m["body"].strip() or explicit(m["body"]):
        return None
    body = m["body"].strip()
    frames = (("embedded-base", "{prefix}，{body}。", "省略主语", R.PLAIN), ("embedded-research", "{prefix}，{v}。", "研究"))
    return replace(u, text=run.put("subject-drop", "subject:drop", u.text, frames, {"prefix": m["prefix"].strip(), "body": body, "v": varied(m["subject"], body)}, run.mode != "conservative" or run.round > 1))


def same_subject(a: Unit, b: Unit) -> bool:
    head = subject_head(a.text)
    return head in META and head == subject_head(b.text)


def repair_heads(run: Run, units: list[Unit]) -> list[Unit]:
    """A sentence that begins with its neighbour's subject gets another beginning."""
    out = units[:1]
    for u in units[1:]:
        new = next((v for f in (vary_subject, drop_subject, drop_embedded) if (v := f(run, u))), None) if same_subject(out[-1], u) else None
        out.append(new or u)
    return out


def subject_chains(run: Run, units: list[Unit]) -> list[Unit]:
    """From left to right: topic and work, implications, then neighbours of one subject; what is left of repeated subjects is repaired."""
    if len(units) < 2 or run.mode == "conservative":
        return repair_heads(run, units)
    out, rest = [], deque(units)
    told = ("objective", "support", "detail", "conclusion")
    while rest:
        a = rest.popleft()
        if rest:
            if one := compress_topic(run, a, rest[0]):
                rest.popleft()
                if rest and (two := absorb(run, one, rest[0])):
                    one = two
                    rest.popleft()
                out.append(one)
                continue
            if one := absorb(run, a, rest[0]):
                rest.popleft()
                out.append(one)
                continue
            if same_subject(a, rest[0]) and a.label in told and rest[0].label in told:
                b = rest[0]
                if one := merge_subjects(run, a, b):
                    rest.popleft()
                    out.append(one)
                    continue
                if new := vary_subject(run, b) or drop_subject(run, b):
                    rest.popleft()
                    out += [a, new]
                    continue
        out.append(a)
    return repair_heads(run, out)


def fuse(run: Run, a: Unit, b: Unit) -> Unit | None:
    """A sentence that goes on from the one before, or follows from it, is fused with it."""
    left = core(a.text)
    prefix, rest = opening(b.text, R.TRANSITION)
    right = core(rest)
    if prefix and left and right:
        linked = with_particle(right)
        if a.label == "objective":
            return run.pair("objective-followup", a, b, True, left=left, right=right, tail=followups(right)[1], linked=linked)
        if len(left) <= 70:
            return run.pair("context-followup", a, b, run.later, left=left, right=right, linked=linked)
    prefix, rest = opening(b.text, R.IMPLICATION)
    right = core(rest)
    if not prefix or len(left) > 58 or not left or not right:
        return None
    subject, body = subject_and_body(right)
    if subject in META and body:
        return run.pair("implication-subject", a, b, run.later, left=left, body=body, varied=varied(subject, body), system=varied(subject, body, True))
    return run.pair("implication-plain", a, b, run.later, left=left, right=right)


def by_pairs(run: Run, units: list[Unit], rule: Callable[[Run, Unit, Unit], Unit | None]) -> list[Unit]:
    """Greedy, from left to right: neighbours that the rule joins become one and are not joined again."""
    out, rest = [], deque(units)
    while rest:
        a = rest.popleft()
        one = rule(run, a, rest[0]) if rest else None
        if one:
            rest.popleft()
        out.append(one or a)
    return out


def fuse_all(run: Run, units: list[Unit]) -> list[Unit]:
    return units if run.mode == "conservative" else by_pairs(run, units, fuse)


def merge_short(run: Run, units: list[Unit]) -> list[Unit]:
    """Two short neighbours become one sentence."""
    if run.mode == "conservative":
        return units
    most = (32, 30) if run.mode == "balanced" else (36, 36)

    def join(run: Run, a: Unit, b: Unit) -> Unit | None:
        left, right = core(a.text), core(b.text)
        if len(left) >= most[0] or len(right) >= most[1] or b.label not in ("support", "detail", "conclusion"):
            return None
        right = re.sub(R.SEQUENCE, "", right)
        return run.pair("short-merge", a, b, True, left=left, right=right, bing=right.lstrip("并"), jiner=right.lstrip("进而"))

    return by_pairs(run, units, join)


# ---- rules over the whole paragraph
def same_text_once(units: list[Unit]) -> list[Unit]:
    """Without neighbours of equal text."""
    out: list[Unit] = []
    before = ""
    for u in units:
        key = same_key(u.text)
        if not key or key != before:
            out.append(u)
            before = key
    return out


def alike_once(sentences: list[str], least: float = 0.92) -> list[str]:
    """Without sentences that repeat the last kept one almost word for word."""
    out: list[str] = []
    for s in sentences:
        if not (out and similarity(out[-1], s) >= least):
            out.append(s)
    return out


def clauses_once(s: str) -> str:
    """Without a clause that repeats the one before it."""
    pieces = re.split(r"(，|,)", s)
    out, before = [], ""
    for i in range(0, len(pieces), 2):
        key = re.sub(r"\s+", "", re.sub(R.CLAUSE_LEAD, "", pieces[i].strip()))
        if not key or key != before:
            out += pieces[i : i + 2]
            before = key
    return "".join(out).strip() if len(pieces) > 1 else s


def reordered(run: Run, units: list[Unit], order: list[int], *rules: str) -> list[Unit] | None:
    """Units in a new order, if the topic sentence stays first and the new first sentence can open a paragraph."""
    new = [units[i] for i in order]
    if locked_opening(units[0].text) and 0 not in new[0].sources or not valid_opening(new[0].text):
        return None
    run.rules += rules
    return new


def cluster_window(run: Run, units: list[Unit]) -> list[Unit]:
    """In the first five sentences: a conclusion comes second, a risk comes after the detail, or two sentences change places."""
    if run.mode == "conservative" or len(units) < 3:
        return units
    w = min(5, len(units))
    kinds = [u.label for u in units[:w]]
    tail = list(range(w, len(units)))
    if kinds[-1] == "conclusion" and kinds[0] in ("background", "detail", "support", "capability"):
        return reordered(run, units, [0, w - 1, *range(1, w - 1), *tail], "cluster:cause-effect-reframe", "cluster:narrative-path-rewrite") or units
    if kinds[0] == "detail" and "risk" in kinds[1:]:
        i = kinds.index("risk")
        return reordered(run, units, [0, i, *(j for j in range(1, w) if j != i), *tail], "cluster:cause-effect-reframe", "cluster:discourse-reordering") or units
    if run.intensity == "high" and w >= 4 and kinds[1] in ("support", "capability", "detail"):
        return reordered(run, units, [0, 2, 1, *range(3, len(units))], "cluster:local-sentence-reorder", "cluster:narrative-path-rewrite") or units
    return units


def narrative_order(run: Run, units: list[Unit]) -> list[Unit]:
    """The order of a paragraph: the first case that fits, and only if its new opening is a good one."""
    n, kinds = len(units), [u.label for u in units]
    if run.depth != "developmental_rewrite" or n < 3:
        return units
    objective = kinds.index("objective") if "objective" in kinds else -1
    inner = next((i for i in range(n - 1) if kinds[i] == "conclusion"), None)
    cases = (
        (kinds[0] == "conclusion", [*range(1, n), 0], "paragraph:move-summary-to-close"),
        (0 < objective < 3 and kinds[0] in ("background", "risk", "capability"), [objective, *(i for i in range(n) if i != objective)], "paragraph:promote-objective"),
        (kinds[0] in ("background", "capability") and kinds[-1] in ("risk", "conclusion") and kinds[1] in ("detail", "support", "capability"), [0, n - 1, *range(1, n - 1)], "paragraph:promote-risk"),
        (inner is not None, [*(i for i in range(n) if i != inner), inner or 0], "paragraph:move-conclusion-to-close"),
    )
    first = next((c for c in cases if c[0]), None)
    if first:
        new = reordered(run, units, first[1], first[2])
        if new:
            return new
    more = (
        (kinds[:3] == ["background", "detail", "conclusion"], [0, 2, 1, *range(3, n)], "paragraph:surface-conclusion-earlier"),
        (kinds[0] == "risk" and objective > 0, [0, objective, *(i for i in range(1, n) if i != objective)], "paragraph:align-risk-objective"),
        (run.intensity == "high" and kinds[1] in ("risk", "capability", "support", "detail"), [1, 0, *range(2, n)], "paragraph:high-intensity-promote-second"),
    )
    found = next((c for c in more if c[0]), None)
    return (reordered(run, units, found[1], found[2]) if found else None) or units


_TASK, _PLACE = re.compile(R.TASK_LEFT.format(token=TOKEN)), re.compile(R.PLACE_LEFT.format(token=TOKEN))


def dangling_split(left: str, right: str) -> bool:
    return bool(_TASK.search(left) or _PLACE.search(left) and right.startswith(R.PLACE_RIGHT) or re.search(R.SCENE_LEFT, left) and right.startswith(R.SCENE_RIGHT))


def split_point(s: str, least: int) -> int:
    """Where a long sentence is cut: before a connector, else at a comma, nearest the middle; -1 if nowhere."""
    t = core(s)
    if len(t) < least:
        return -1
    at = [m.start() for mark in R.SPLIT_MARKS for m in re.finditer(re.escape(mark), t)] or [m.start() for m in re.finditer("[，,]", t)]
    for p in sorted(at, key=lambda p: abs(p - len(t) // 2)):
        left, right = t[:p].strip(), t[p + 1 :].strip()
        if len(left) >= 18 and len(right) >= 18 and not dangling_split(left, right):
            return p
    return -1


def split_long(run: Run, units: list[Unit]) -> list[Unit]:
    out = []
    for u in units:
        p = split_point(u.text, 92 if run.mode == "balanced" and run.round == 1 else 78)
        left, right = (ended(u.text[:p].rstrip("，, ")), ended(after_comma(u.text[p + 1 :]))) if p >= 0 else ("", "")
        if left and right:
            out += [replace(u, text=left), Unit(right, "detail", u.sources)]
            run.rules.append("structure:split-long-sentence")
        else:
            out.append(u)
    return out


# ---- rules over single sentences
def enumerations(run: Run, s: str) -> str:
    t = s.strip()
    m = re.match(R.ENUMERATION, t)
    items = [x.strip() for x in m["items"].split("、") if x.strip()] if m else []
    if run.mode == "conservative" or len(items) < 3:
        return t
    predicate = m["predicate"].strip()
    fields = {
        "either": "、".join(items[:-1]) + "，还是" + items[-1], "predicate": predicate, "first": items[0], "next_last": items[-2], "last": items[-1], "but_last": "、".join(items[:-1]),
        "tail": re.sub("^(都|都会|均会|都将|都可能)", "", predicate).strip(),
    }
    return run.put("parallel-enumeration", "structure:parallel-enumeration", t, R.ENUMERATIONS, fields, True)


def sentence_frames(run: Run, s: str) -> str:
    t = s.strip()
    for family, rule, who, prefer, keep, pattern, choices in R.SENTENCES:
        m = re.match(pattern, t)
        if m and run.may(who):
            f = {k: v.strip("，, ") if k == "topic" else v.strip() for k, v in m.groupdict().items()}
            if "subject" in f:
                f["risk"] = f["subject"] if "风险" in f["subject"] else f["subject"] + "带来的风险"
            if "lemma" in f:
                f["emphasis"] = "尤为必要" if "必要" in f["lemma"] else "尤为关键"
            return run.put(family, rule, t, choices, f, run.when(prefer), run.when(keep))
    return t


def openers(run: Run, s: str) -> str:
    t = s.strip()
    for family, rule, _, prefer, pattern, leads in R.OPENINGS:
        if m := re.match(pattern, t):
            rest = after_comma(t[m.end() :])
            frames = [(str(i), x.replace("{context}", m.groupdict().get("context") or "") + ("，{rest}" if rest else "。"), x.replace("{context}", m.groupdict().get("context") or "")) for i, x in enumerate(leads, 1)]
            return run.put(family, rule, t, frames, {"rest": rest}, run.when(prefer), True)
    m = re.match(R.IMPLICATION_OPENING, t)
    if m and run.mode != "conservative":
        rest = after_comma(t[m.end() :])
        return run.put("implication-opening", "opening:implication", t, R.IMPLICATION_OPENINGS, {"rest": rest, "ended": ended(rest)}, run.later, True)
    return t


def fillers(run: Run, s: str) -> str:
    for pattern, new, rule in R.FILLERS:
        s, n = re.subn(pattern, new, s)
        run.rules += [rule] * bool(n)
    for family, rule, literal, prefer, words in R.LITERALS:
        if literal in s:
            s = run.put(family, rule, s, [(str(i), s.replace("{", "{{").replace("}", "}}").replace(literal, w), w) for i, w in enumerate(words, 1)], {}, run.when(prefer), True)
    return s


def technical(s: str) -> bool:
    return len(re.findall(R.TECHNICAL, s)) >= 3


def texture(run: Run, s: str) -> str:
    """Fewer function words, sequence words, parallel slogans and chains of nouns; technical sentences stay."""
    if technical(s):
        run.rules.append("natural:keep-technical-dense")
        return s
    soft = run.mode == "conservative"
    m = re.match(R.STUDIED, s.strip())
    if m and not soft:
        s = run.put("function-word-reduction", "natural:function-word", s.strip(), R.STUDIES, {"subject": m["subject"], "base": m["verb"][:-1], "object": m["object"].strip()}, True, True)
    for pattern, new in R.FUNCTION_WORDS:
        s, n = re.subn(pattern, new, s)
        run.rules += ["natural:function-word"] * bool(n)
    if "在实际" in s and "中，" in s:
        s, n = re.subn(*R.IN_PRACTICE, s, count=1)
        run.rules += ["natural:function-word"] * bool(n)
    if soft:
        return s
    m = re.match(R.WEAKENED, s.strip())
    if m and ended(m["body"]) not in ("", s.strip()):
        s = ended(m["body"])
        run.rules.append("natural:weaken-template-connectors")
    if m := re.match(R.PARALLELISM, s.strip()):
        s = run.put("natural-parallelism", "natural:break-parallelism", s.strip(), R.PARALLELISMS, {k: v.strip() for k, v in m.groupdict().items()}, True)
    else:
        t, n = s.strip(), 0
        for pattern, new in R.SLOGANS:
            t, k = re.subn(pattern, new, t)
            n += bool(k)
        s = ended(t) if n else s
        run.rules += ["natural:break-parallelism"] * n
    s, n = re.subn(*R.NOMINAL, s, count=1)
    run.rules += ["natural:dense-nominal"] * bool(n)
    return s


def polish(run: Run, s: str) -> str:
    for f in (sentence_frames, openers, fillers, texture):
        s = f(run, s)
    return s


def transitions(run: Run, units: list[Unit]) -> list[Unit]:
    """A paragraph does not begin with a transition; later ones vary."""
    if run.mode == "conservative":
        return units
    out = []
    for i, u in enumerate(units):
        prefix, rest = opening(u.text, R.TRANSITION)
        if prefix and i == 0 and rest.strip():
            run.rules.append("paragraph:opening-style-guard")
            u = replace(u, text=ended(rest))
        elif prefix and i:
            u = replace(u, text=run.put("transition-opening", "opening:transition", u.text, R.TRANSITIONS, {"rest": rest, "ended": ended(rest)}, run.later, True))
        out.append(u)
    return out


def recast(s: str, intensity: str) -> str:
    t = s.strip()
    for high, pattern, new in R.RECASTS:
        if (not high or intensity == "high") and (m := re.match(pattern, t)):
            return ended(new.format(**{k: v.strip() for k, v in m.groupdict().items()}))
    return s


def recast_if_static(run: Run, units: list[Unit], source: list[str]) -> list[Unit]:
    """Sentences are recast until two fifths (three at high intensity) differ from the source, from the end unless intensity is high."""
    if run.mode == "conservative" or not units or run.intensity not in ("medium", "high") and run.round <= 1 or len(units) != len(source):
        return units
    out = list(units)
    differs = [same_key(a) != same_key(u.text) for a, u in zip(source, units, strict=True)]
    need = max(1, ceil(len(source) * (0.6 if run.intensity == "high" else 0.4)))
    order = range(len(units)) if run.intensity != "medium" else reversed(range(len(units)))
    for i in order:
        if sum(differs) >= need:
            break
        new = recast(out[i].text, run.intensity) if not differs[i] else out[i].text
        if not differs[i] and same_key(new) != same_key(out[i].text):
            out[i] = replace(out[i], text=new)
            differs[i] = True
            run.rules.append("sentence:developmental-recast")
    return out


def uneven(run: Run, source: list[str], new: list[str], paragraph: int) -> tuple[list[str], list[str]]:
    """(sentences, marks of an uneven revision); where all of four or more were changed one goes back."""
    if run.mode == "conservative" or run.depth != "developmental_rewrite" or not source or not new:
        return new, []
    new, n = list(new), min(len(source), len(new))
    changed = [i for i in range(n) if same_key(source[i]) != same_key(new[i])]
    marks = []
    if len(source) == len(new) == len(changed) and len(source) >= 4:
        i = (paragraph + len(source)) % len(source)
        new[i] = source[i]
        changed.remove(i)
        run.rules.append("human:partial-keep")
        marks.append("partial_keep")
    sizes = [len(same_key(s)) for s in new]
    marks += ["asymmetric_sentence_rhythm"] * (len(sizes) >= 3 and max(sizes) - min(sizes) >= 12)
    marks += ["uneven_sentence_change"] * (0 < len(changed) < n) + ["cluster_length_shift"] * (len(source) != len(new)) + ["heavy_light_block_contrast"] * (run.intensity == "high" and len(changed) >= 2)
    if marks:
        run.rules.append("human:uneven-rewrite-distribution")
    return new, marks


def detected(units: list[Unit]) -> list[str]:
    """Named patterns of a paragraph."""
    kinds, heads = {u.label for u in units}, [subject_head(u.text) for u in units]
    out = ["enumeration_unified"] * any(re.match(r"^[^，。；]+(?:、[^，。；]+){2,}，(?:都|都会|均会|都将|都可能).+$", u.text.strip()) for u in units)
    out += ["study_description"] * ("objective" in kinds and bool(kinds & {"support", "capability"})) + ["risk_objective"] * (kinds >= {"risk", "objective"})
    out += ["repeated_meta_subject"] * any(a in META and a == b for a, b in zip(heads, heads[1:], strict=False))
    for i, (a, b) in enumerate(zip(units, units[1:], strict=False)):
        out += ["background_transition"] * (a.label in ("background", "capability", "support") and bool(opening(b.text, R.TRANSITION)[0]))
        out += ["risk_conclusion"] * (a.label in ("risk", "support", "detail") and (bool(opening(b.text, R.IMPLICATION)[0]) or b.label == "conclusion"))
        out += ["capability_extension"] * (a.label in ("capability", "support") and b.label in ("detail", "support", "capability"))
        out += ["subject_chain"] * (heads[i] in META and heads[i] == heads[i + 1])
    return list(dict.fromkeys(out))


# ---- what rules count as
def _counted(rules: Iterable[str], table: tuple) -> list[str]:
    def one(rule: str) -> tuple[str, ...]:
        return next((names for keys, names in table if any(rule.startswith(k[:-1]) if k.endswith("*") else rule == k for k in keys)), ())

    return list(dict.fromkeys(name for r in rules for name in one(r)))


def structural_actions(rules: Iterable[str]) -> list[str]:
    out = _counted(rules, R.STRUCTURAL)
    return [*out, "subject_chain_compression"] if set(out) & set(R.CHAINED) and "subject_chain_compression" not in out else out


def discourse_actions(rules: Iterable[str]) -> list[str]:
    return _counted(rules, R.DISCOURSE)


def changes(source: list[str], new: list[str]) -> int:
    return sum(same_key(a) != same_key(b) for a, b in zip(source, new, strict=False)) + abs(len(source) - len(new))


def revision_patterns(rules: list[str], source: list[str], new: list[str], depth: str) -> list[str]:
    """At most two names of how a paragraph was revised."""
    out = _counted(rules, R.PATTERNS) + ["merge"] * (len(new) < len(source)) + ["split"] * (len(new) > len(source))
    n = changes(source, new)
    if n == 0 or n < len(source) and not (depth == "developmental_rewrite" and n >= max(1, len(source) - 1)):
        out.append("partial_keep")
    elif depth == "developmental_rewrite" and n >= max(1, len(source) - 1):
        out.append("rewrite_all")
    return list(dict.fromkeys(out or ["reframe"]))[:2]


# ---- a paragraph, a document
def rewrite_paragraph(text: str, memory: Memory, mode: str = "balanced", round_: int = 1, depth: str = "developmental_rewrite", intensity: str = "medium") -> dict:
    run = Run(memory, mode, round_, depth, intensity)
    number = memory.next_paragraph()
    source = split_outside_brackets(re.sub(r"[ \t]{2,}", " ", re.sub(r"[ \t]*\n[ \t]*", " ", text)).strip())
    units = same_text_once([Unit(s, label(s), (i,)) for i, s in enumerate(source)])
    found = detected(units)
    dev = depth == "developmental_rewrite"
    units = [replace(u, text=enumerations(run, clauses_once(u.text))) for u in units]
    if mode == "strong":
        units = narrative_order(run, units)
    units = subject_chains(run, units)
    if dev:
        before = len(run.rules)
        units = fuse_all(run, units)
        run.round = max(round_, 2 if intensity in ("medium", "high") else round_)
        units = fuse_all(run, units)
        run.rules += ["cluster:sentence-cluster-merge"] * (len(run.rules) > before)
        units = cluster_window(run, units)
        if intensity == "high":
            run.mode = "strong"
            units = merge_short(run, units)
            run.mode = mode
        run.round = round_
        if mode != "conservative":
            units = merge_short(run, split_long(run, units))
    if dev or mode == "strong":
        units = narrative_order(run, units)
    units = [replace(u, text=polish(run, u.text)) for u in units]
    if dev:
        units = recast_if_static(run, units, source)
    units = transitions(run, units)
    new, marks = uneven(run, source, [u.text for u in units], number)
    if new and not valid_opening(new[0]) and (bare := after_comma(re.sub(families.DANGLING_OPENING, "", new[0].strip()))):
        new[0] = ended(bare)
        run.rules.append("paragraph:opening-style-guard")
    new = alike_once(new)
    rules = list(dict.fromkeys(run.rules))
    actions, cluster = discourse_actions(rules), 0
    cluster = sum(a in R.CLUSTER_ACTIONS for a in actions)
    n = changes(source, new)
    return {
        "text": "".join(new), "rules": rules, "patterns": found, "structural": structural_actions(rules), "discourse": actions, "revision_patterns": revision_patterns(rules, source, new, depth),
        "marks": marks, "sentence_changes": n, "cluster_changes": cluster, "discourse_score": 2 * len(actions) + 3 * cluster + min(n, 4),
        "coverage": min(len(source), max(n, cluster)) / len(source) if source else 0.0,
    }


_NAMES = ("rules", "patterns", "structural", "discourse", "revision_patterns", "marks")
RESULT = StructType([
    StructField("text", StringType()), *(StructField(n, ArrayType(StringType())) for n in _NAMES), *(StructField(n, IntegerType()) for n in ("sentence_changes", "cluster_changes", "discourse_score")),
    StructField("coverage", DoubleType()),
])


def rewriter(mode: str = "balanced", round_: int = 1, depth: str = "developmental_rewrite", intensity: str = "medium", backend: Callable[..., dict] = rewrite_paragraph):
    """A column function: array of a document's paragraphs -> array of results. Another backend with the same arguments may take the rules' place."""

    @F.pandas_udf(ArrayType(RESULT))
    def run(documents: pd.Series) -> pd.Series:
        def one(paragraphs) -> list[dict]:
            memory = Memory()
            return [backend(p or "", memory, mode, round_, depth, intensity) for p in (paragraphs if paragraphs is not None else ())]

        return documents.map(one)

    return run
