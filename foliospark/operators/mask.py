"""Masking of what must survive a revision, and its exact inverse.

Spans become numbered tokens `[[KEEP:LABEL:0000]]` in the order of the passes;
text inside tokens is never masked again.  Numbering runs over all passes of a
document, so masking is one Arrow function (documents are independent: no
shuffle); restoring is a fold over the placeholders in the JVM.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import patterns as P

TOKEN = r"\[\[KEEP:[A-Z_]+:\d{4,}\]\]"
#: what looks like a token in the source is masked before all else, under a label that the source does not have
LITERAL = "LITERAL"
MARKDOWN = (
    ("CODE", P.FENCE), ("MATH_BLOCK", P.FORMULA_BLOCK), ("IMAGE", P.IMAGE), ("LINK", P.LINK), ("LINK_DEF", P.LINK_DEF), ("AUTOLINK", P.AUTOLINK),
    ("URL", P.URL), ("INLINE_MATH", P.INLINE_MATH), ("INLINE_CODE", P.INLINE_CODE),
)
CORE = (
    ("CORE_HEADING", P.HEADING_LINE), ("CORE_REFERENCE", P.REFERENCE_LINE), ("CORE_FORMULA_BLOCK", P.FORMULA_BLOCK), ("CORE_FORMULA_INLINE", P.FORMULA_INLINE),
    ("CORE_FORMULA_LINE", P.FORMULA_LINE), ("CORE_CITATION", P.CITATION), ("CORE_CAPTION_LINE", P.CAPTION_LINE), ("CORE_CAPTION", P.CAPTION_FRAGMENT),
    ("CORE_CHECKPOINT", P.CHECKPOINT), ("CORE_PATH", P.PATH), *(("CORE_TERM", t) for t in P.TERMS), ("CORE_NUMBER", P.NUMBER),
)
_KEPT = StructType([StructField(n, StringType()) for n in ("token", "label", "value")])
MASKED = StructType([StructField("text", StringType()), StructField("kept", ArrayType(_KEPT))])


def python_pattern(java: str) -> re.Pattern:
    """The same pattern for Python's engine."""
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", java).replace("(?<fence>", "(?P<fence>").replace(r"\k<fence>", "(?P=fence)"))


_COMPILED = {p: python_pattern(p) for _, p in (*MARKDOWN, *CORE)}
#: what every match of a pattern holds one of, as literals; terms and numbers are told by one search
_NEEDS = {
    P.FENCE: ("```", "~~~"), P.FORMULA_BLOCK: ("$$",), P.IMAGE: ("![",), P.LINK: ("](",), P.LINK_DEF: ("]:",), P.AUTOLINK: ("<http",), P.URL: ("http",), P.INLINE_MATH: ("$",), P.INLINE_CODE: ("`",),
    P.HEADING_LINE: ("#", "第", "摘", "关", "Abstract", "Keywords"), P.REFERENCE_LINE: ("[",), P.FORMULA_INLINE: ("\\(", "\\["), P.FORMULA_LINE: ("=",), P.CITATION: ("[", "(", "（"),
    P.CAPTION_LINE: ("图", "表", "Figure", "Table"), P.CAPTION_FRAGMENT: ("图", "表", "Figure", "Table"), P.CHECKPOINT: ("checkpoint", ".pt", ".ckpt"), P.PATH: ("/", ":\\", "."),
}
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
_TOKEN = re.compile(f"({TOKEN})")
_GAP = re.compile(r"(\n\s*\n)")
_WORD = re.compile(P.ENGLISH_WORD)
_CJK = re.compile("[\u4e00-\u9fff]")


def _may_match(pattern: str, s: str) -> bool:
    """Whether a text may hold a match: most of a document's pieces have no mark of most patterns."""
    if needs := _NEEDS.get(pattern):
        return any(x in s for x in needs)
    return (_DIGIT if pattern == P.NUMBER else _LETTER).search(s) is not None


def _english(s: str) -> bool:
    if _CJK.search(s):
        return False
    t = s.strip()
    return len(_WORD.findall(t)) >= 4 and len(_LETTER.findall(t)) / len("".join(t.split())) >= 0.45


def mask_text(text: str | None, markdown: bool = True, core: bool = True) -> dict:
    kept: list[dict] = []

    def token(label: str, value: str) -> str:
        kept.append({"token": f"[[KEEP:{label}:{len(kept):04d}]]", "label": label, "value": value})
        return kept[-1]["token"]

    literal = LITERAL
    while f"[[KEEP:{literal}:" in (text or ""):
        literal += "X"
    out = _TOKEN.sub(lambda m: token(literal, m[0]), text or "")
    if markdown:
        for label, p in MARKDOWN:
            if _may_match(p, out):
                out = _COMPILED[p].sub(lambda m, label=label: token(label, m[0]), out)
    if core:
        out = "".join(token("CORE_ENGLISH", s) if i % 2 == 0 and _english(s) else s for i, s in enumerate(_GAP.split(out)))
        pieces = _TOKEN.split(out)
        for label, p in CORE:
            if any(_may_match(p, s) for s in pieces[::2]):
                out = "".join(s if i % 2 else _COMPILED[p].sub(lambda m, label=label: token(label, m[0]) if m[0] else "", s) for i, s in enumerate(pieces))
                pieces = _TOKEN.split(out)
    return {"text": out, "kept": kept}


@F.pandas_udf(MASKED)
def mask(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([mask_text(t) for t in texts], columns=["text", "kept"])


@F.pandas_udf(MASKED)
def mask_markdown(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([mask_text(t, core=False) for t in texts], columns=["text", "kept"])


def unmask(text: str, kept: dict[str, dict]) -> str:
    """The source of a masked text; kept: what stands for each token. Tokens inside values come out too, those of the source stay."""

    def value(m: re.Match) -> str:
        k = kept[m[0]]
        return k["value"] if k["label"].startswith(LITERAL) else _TOKEN.sub(value, k["value"])

    return _TOKEN.sub(value, text)


def restore(text: Column, kept: Column) -> Column:
    """Put the values back, last token first, so that tokens inside values come out too; those of the source, which are first, stay."""
    return F.aggregate(F.reverse(kept), text, lambda acc, k: F.replace(acc, k["token"], k["value"]))
