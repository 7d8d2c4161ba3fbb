"""The guide plan: documents -> chunks -> blocks with chapters and policies -> a report per document.

Chunks come from one Arrow pass over whole documents; everything else is JVM
expressions.  Two exchanges: the chapter window by document, and the final
aggregation.  Documents are told apart by a row number, so rows that share an
id stay apart; a document's blocks are sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bracket_sentences
from ..operators import blocks as B
from ..operators import chapters, cut, integrity


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **extra: Column) -> DataFrame:
    """(_row, id, extra columns, block_id, part, kind, rewritable, before, text): before + text in order give the document back."""
    pieces = cut.cut_by_suffix(F.col(text_col), F.col("suffix")) if "suffix" in docs.columns else cut.cut(F.col(text_col))
    found = docs.select(F.monotonically_increasing_id().alias("_row"), id_col, *(c.alias(k) for k, c in extra.items()), pieces.alias("_parts"))
    keys = ["_row", id_col, *extra]
    return found.select(*keys, F.explode("_parts").alias("_p")).select(*keys, "_p.*")


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **extra: Column) -> DataFrame:
    """(_row, id, extra columns, block_id, part, before, text, policy columns, chapter columns). Bounds come from masked text, policies from the text itself."""
    out = B.policy(parts(docs, id_col, text_col, **extra).drop("kind"), rewritable=F.col("rewritable"))
    out = chapters.fill(out, "_row", "block_id", "part")
    out = out.withColumn("n_sentences", F.size(bracket_sentences(F.col("text"))))
    out = out.withColumn("chapter_type", chapters.chapter_type(F.col("chapter_title"), F.col("text")))
    return out.withColumn("chapter_priority", chapters.priority(F.col("chapter_type"), chapters.technical_level(F.col("text"), F.col("n_sentences"))))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document (of rows that share an id, each): risk, scale, body counts, and what is protected."""
    found = blocks(docs, id_col, text_col, protected=integrity.protection(F.col(text_col)))
    return B.document_risk(found, "_row", id_col, "protected").drop("_row")
