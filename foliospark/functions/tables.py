"""Table functions for SQL: sentences and protected spans of a text, one row each."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.mask import CORE, MARKDOWN, python_pattern
from .text import split_outside_brackets


@udtf(returnType="sent_idx int, sentence string")
class SplitSentences:
    """split_sentences(text): sentences whose ends stand outside brackets, numbered from 1."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(split_outside_brackets(text), 1)


_PATTERNS: list[tuple[str, re.Pattern]] = [(label, python_pattern(p)) for label, p in (*MARKDOWN, *CORE)]


@udtf(returnType="kind string, start int, end int, value string")
class ExtractSpans:
    """extract_spans(text): protected spans of each kind, by start; end exclusive."""

    def eval(self, text: str) -> Iterator[tuple[str, int, int, str]]:
        found = {(m.start(), m.end(), label, m[0]) for label, p in _PATTERNS for m in p.finditer(text or "") if m[0]}
        for a, b, label, value in sorted(found):
            yield label, a, b, value


def register(spark: SparkSession) -> None:
    """Makes split_sentences and extract_spans known to SQL."""
    spark.udtf.register("split_sentences", SplitSentences)
    spark.udtf.register("extract_spans", ExtractSpans)
