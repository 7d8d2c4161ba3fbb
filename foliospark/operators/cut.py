"""Lossless chunks of whole documents: masked, cut by lines, packed, and put back, in one Arrow pass without a shuffle.

`before + text` of all parts of a document, in order, give the document back
byte for byte.  Bounds come from the masked text (no bound falls inside what is
masked), texts from the document itself.  A document is one row; its parts are
the rows of one array.
"""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from ..functions import patterns as P
from .blocks import SINGLE, pack
from .mask import TOKEN, mask_text, python_pattern, unmask

PART = StructType([
    StructField("block_id", IntegerType()), StructField("part", IntegerType()), StructField("kind", StringType()), StructField("rewritable", BooleanType()),
    StructField("before", StringType()), StructField("text", StringType()),
])
_HEADING, _LINK_DEF, _LIST, _TABLE_RULE, _CAPTION = (python_pattern(p) for p in (P.HEADING, P.LINK_DEF_LINE, P.LIST_LINE, P.TABLE_RULE, P.CAPTION))
_PLACEHOLDER = re.compile(rf"(?:\s*(?:\*+\s*)?{TOKEN}(?:\s*(?:{TOKEN}|\*+))*\s*)+")
_END = re.compile(r"[。！？!?；;]")
_CJK, _WORD, _LETTER = python_pattern(P.CJK), re.compile(P.ENGLISH_WORD), re.compile("[A-Za-z]")


def line_kind(line: str) -> str:
    t = line.strip()
    if not t:
        return "blank"
    if _PLACEHOLDER.fullmatch(t):
        return "placeholder"
    if _HEADING.match(t):
        return "heading"
    if _LINK_DEF.match(t):
        return "link_def"
    if _LIST.match(t):
        return "list"
    if t[0] == ">":
        return "quote"
    if t[0] == "|" and t.count("|") >= 2 or "|" in t and _TABLE_RULE.match(t):
        return "table"
    return "paragraph"


def frozen(text: str) -> bool:
    """A paragraph that stays: tokens only, an introduction that ends with a colon, captions, or English."""
    t = text.strip()
    if not t:
        return False
    if _PLACEHOLDER.fullmatch(t) or t[-1] in "：:" and not _END.search(t):
        return True
    if all(_CAPTION.fullmatch(x) for x in map(str.strip, t.splitlines()) if x):
        return True
    return not _CJK.search(t) and len(_WORD.findall(t)) >= 4 and len(_LETTER.findall(t)) >= 0.45 * len("".join(t.split()))


def islands(lines: list[str], markdown: bool) -> list[tuple[str, list[str]]]:
    """Runs of lines of one kind; headings, placeholders and link definitions stand alone, indented lines go on with a list."""
    out: list[tuple[str, list[str]]] = []
    for line in lines:
        kind = line_kind(line) if markdown else "paragraph" if line.strip() else "blank"
        if kind != "blank" and line[0] in " \t" and out and out[-1][0] == "list":
            kind = "list"
        if out and out[-1][0] == kind and kind not in SINGLE:
            out[-1][1].append(line)
        else:
            out.append((kind, [line]))
    return out


def cut_text(text: str | None, suffix: str = ".md") -> list[tuple]:
    """Parts of one document. Markdown is cut by kinds of lines, plain text by blank lines."""
    if suffix.lower() not in (".md", ".txt"):
        raise ValueError(f"no way to cut {suffix}")
    markdown = suffix.lower() == ".md"
    m = mask_text(text, markdown=markdown)
    kept = {k["token"]: k for k in m["kept"]}
    out = []
    for i, (kind, lines) in enumerate(islands(m["text"].split("\n"), markdown), 1):
        block = "\n".join(lines)
        rewritable = kind == "paragraph" and not (markdown and frozen(block))
        for part, piece in enumerate((pack(block) if rewritable else [block]) or [""]):
            out.append((i, part, kind, rewritable, "\n" if i > 1 and not part else "", unmask(piece, kept)))
    return out


@F.pandas_udf(ArrayType(PART))
def cut(texts: pd.Series) -> pd.Series:
    return texts.map(cut_text)


@F.pandas_udf(ArrayType(PART))
def cut_by_suffix(texts: pd.Series, suffixes: pd.Series) -> pd.Series:
    return pd.Series(list(itertools.starmap(cut_text, zip(texts, suffixes, strict=True))), dtype=object)
