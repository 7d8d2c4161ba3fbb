"""Text expressions. All are JVM columns but the depth-aware split, which no column expression gives."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import patterns as P


def u(pattern: str) -> str:
    r"""The pattern with Unicode \s, \w and \b."""
    return "(?U)" + pattern


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(u(pattern)))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(u(pattern))


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(u(pattern)), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, u(r"^\s+|\s+$"), "")


def squeeze(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, u(r"\s+"), "")


def occurrences(text: Column, marker: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker)).cast("int")


def total(text: Column, markers: Iterable[str]) -> Column:
    out = F.lit(0)
    for m in markers:
        out = out + occurrences(text, m)
    return out


def contains_any(text: Column, markers: Iterable[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | text.contains(m)
    return out


def starts_with_any(text: Column, markers: Iterable[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | text.startswith(m)
    return out


def sentences(text: Column) -> Column:
    """Maximal runs without a terminator, each with one terminator if there is one; trimmed, not empty."""
    return F.filter(F.transform(find_all(text, P.SENTENCE), strip), lambda s: s != "")


def visible_sentences(text: Column) -> Column:
    """Those that hold a letter, a digit or a Chinese character."""
    return F.filter(sentences(text), lambda s: s.rlike(r"[A-Za-z0-9\x{4e00}-\x{9fff}]"))


def breaks(text: Column) -> Column:
    """Lossless pieces, cut after every sentence mark or semicolon."""
    return F.filter(F.split(text, r"(?<=[。！？!?；;])"), lambda s: s != "")


def each_sentence(text: Column, change: Callable[[Column], Column]) -> Column:
    """The text with every sentence changed, and all that stands around sentences kept."""
    def one(piece: Column) -> Column:
        lead, tail = F.regexp_extract(piece, u(r"^\s*"), 0), F.regexp_extract(piece, u(r"\s*$"), 0)
        return F.when(strip(piece) == "", piece).otherwise(F.concat(lead, change(strip(piece)), tail))

    return F.array_join(F.transform(F.split(text, "(?<=[。！？?!])"), one), "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, u(r"\n\s*\n")), strip), lambda s: s != "")


_PLAIN = re.compile(r"[^。！？?!]*[。！？?!]|[^。！？?!]+")
_OPEN, _CLOSE = {"（": 0, "(": 0, "[": 1, "{": 2}, {"）": 0, ")": 0, "]": 1, "}": 2}


def split_outside_brackets(text: str | None) -> list[str]:
    """Sentences whose terminators stand outside round, square and curly brackets; the tail is kept."""
    if not text:
        return []
    if not any(c in text for c in "（([{"):
        return [s for s in map(str.strip, _PLAIN.findall(text)) if s]
    out, start, depth = [], 0, [0, 0, 0]
    for i, c in enumerate(text):
        if c in _OPEN:
            depth[_OPEN[c]] += 1
        elif c in _CLOSE:
            depth[_CLOSE[c]] = max(0, depth[_CLOSE[c]] - 1)
        elif c in "。！？?!" and not any(depth):
            out.append(text[start : i + 1].strip())
            start = i + 1
    return [s for s in (*out, text[start:].strip()) if s]


@F.pandas_udf(ArrayType(StringType()))
def bracket_sentences(texts: pd.Series) -> pd.Series:
    return texts.map(split_outside_brackets)


def english(text: Column, least_letters: int | None = None, share: float = 0.45) -> Column:
    """No Chinese, four English words (or so many letters), and a share of letters among the visible characters."""
    t = strip(text)
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    enough = F.regexp_count(t, F.lit(P.ENGLISH_WORD)) >= 4
    if least_letters is not None:
        enough = enough | (letters >= least_letters)
    return (t != "") & ~t.rlike(P.CJK) & enough & (letters >= share * F.length(squeeze(t)))


def numbers(text: Column) -> Column:
    """Numbers as text, without zeros that only format them."""
    def plain(x: Column) -> Column:
        core = F.regexp_replace(x, "%$", "")
        core = F.when(core.contains("."), F.regexp_replace(F.regexp_replace(core, "0+$", ""), r"\.$", "")).otherwise(core)
        return F.concat(core, F.when(x.endswith("%"), "%").otherwise(""))

    return F.transform(F.regexp_extract_all(text, F.lit(P.NUMBER), F.lit(0)), plain)


def term(x: Column) -> Column:
    return F.lower(F.replace(squeeze(x), F.lit("\\"), F.lit("/")))


def terms(text: Column) -> Column:
    """Technical terms, first occurrences in the order of the patterns."""
    found = F.flatten(F.array(*[find_all(text, p) for p in P.TERMS]))
    return F.array_distinct(F.filter(F.transform(found, term), lambda x: x != ""))


def preview(text: Column, limit: int = 90) -> Column:
    t = strip(F.regexp_replace(text, u(r"\s+"), " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(t.substr(1, limit - 1), F.lit("…")))


def excerpt(text: Column, limit: int = 70) -> Column:
    t = strip(F.regexp_replace(text, u(r"\s+"), " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(t.substr(1, limit)), F.lit("...")))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once: expressions that use it several times stay small."""
    return F.element_at(F.transform(F.array(value), lambda v: f(v)), 1)


def ensure_end(text: Column) -> Column:
    def close(t: Column) -> Column:
        end = F.when(t.rlike(P.CJK), "。").otherwise(".")
        return F.when((t == "") | t.endswith("]]") | t.rlike(r"[。！？?!.:：;；]$"), t).otherwise(F.concat(t, end))

    return let(strip(text), close)


def mean(values: Column) -> Column:
    n = F.size(values)
    return F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.greatest(n, F.lit(1))).otherwise(0.0)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
