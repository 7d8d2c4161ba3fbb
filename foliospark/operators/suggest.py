"""Suggestions for a paragraph: what facts it could name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import contains_any, has


def suggestions(paragraph: Column) -> Column:
    low = F.lower(paragraph)
    vague, year, number = contains_any(low, P.VAGUE), has(paragraph, P.SUGGEST_YEAR), paragraph.rlike("[0-9]")
    s = P.SUGGESTIONS
    items = F.array_compact(F.array(
        F.when(contains_any(low, P.RESEARCH_HINTS) & ~has(paragraph, P.SUGGEST_CITATION), s[0]),
        F.when(~year & (contains_any(paragraph, ("近年来", "目前", "当前")) | vague), s[1]),
        F.when(contains_any(low, P.CASE_HINTS) & ~number, s[2]),
        F.when(contains_any(low, P.SAMPLE_HINTS) & ~number, s[3]),
    ))
    items = F.when(vague & (F.size(items) == 0), F.array(F.lit(s[4]))).otherwise(items)
    return F.when(F.length(paragraph) < 50, F.array().cast("array<string>")).otherwise(items)
