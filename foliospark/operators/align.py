"""Alignment of blocks and sentences: body lines, the cascade that pairs blocks with their revisions, topic anchors, and joins by number."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import patterns as P
from ..functions.text import find_all, has, let, squeeze, strip
from . import repairs
from .cut import cut

# Fixed values
NON_BODY = (
    r"^\s{0,3}#{1,6}\s+", r"^\s*!\[[^\]]*\]\([^)]+\)\s*$", r"^\s*(?:图|表)\s*\d+", r"^\s*\[[^\]]+\]:\s+\S+", r"^\s*\[\d+\]", r"^\s*(?:[-*+]\s+|\d+\.\s+)", r"^>", r"^\s*\|.*\|\s*$|^\s*[:\-\|\s]+\s*$",
    r"^\s*(?:\$\$|\\\[|\\\(|\\begin\{|\\end\{)", r"^[-*_]{3,}$",
)
STRUCTURAL = (r"^\s{0,3}#{1,6}\s+", r"^\s*!\[[^\]]*\]\([^)]+\)\s*$", r"^\s*(?:[-*+]\s+|\d+\.\s+)", r"^\s*\|.*\|\s*$", r"^\s*(?:\$\$|\\\[|\\\(|\\begin\{|\\end\{)")
ANCHORS = r"(?i)AIGC|Deepfake|ViT|CNN|本研究|系统|模型|方法|实验|检测|研究|生成式?图像|语义分支|频域分支|困难真实样本"
SECTION_LABEL = r"(?i)^\s*(?:摘\s*要|关键词|目\s*录|Abstract|Keywords)\s*$"
CODE_FENCE = r"(?ms)^(```|~~~)[^\n]*\n.*?^\1[ \t]*$"


def any_rlike(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns (without flags of their own) is found, in one search."""
    return has(text, "|".join(f"(?:{p})" for p in patterns))


def body_line(line: Column) -> Column:
    return let(strip(line), lambda t: (t != "") & ~any_rlike(t, NON_BODY) & ~(has(t, P.PATH) & (F.regexp_count(t, F.lit(P.CJK)) < 12)))


def structural(text: Column) -> Column:
    return let(strip(text), lambda t: any_rlike(t, STRUCTURAL))


def body_text(text: Column) -> Column:
    """Without headings, images, captions, link definitions, references, lists, quotes, tables, formulas, rules, paths and blank lines."""
    return F.array_join(F.filter(F.split(text, "\n"), body_line), "\n")


def plain_paragraphs(text: Column) -> Column:
    """Runs of lines that are neither blank nor structural."""
    marked = F.transform(F.split(text, "\n"), lambda x: F.when(~has(x, r"\S") | structural(x), "").otherwise(x))
    return F.filter(F.transform(F.split(F.array_join(marked, "\n"), "\n\n+"), lambda p: F.regexp_replace(p, "^\n+|\n+$", "")), lambda p: has(p, r"\S"))


def alignment_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, heading, text): code fences and section labels dropped, the last heading carried on, short front matter skipped."""
    blocks = F.filter(F.split(F.regexp_replace(F.replace(F.col(text_col), F.lit("\r\n"), F.lit("\n")), CODE_FENCE, "\n"), r"\n\s*\n+"), lambda b: strip(b) != "")
    df = docs.select(F.monotonically_increasing_id().alias("_row"), id_col, F.posexplode(F.transform(blocks, strip)).alias("paragraph", "text"))
    w = Window.partitionBy("_row").orderBy("paragraph").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(has(F.col("text"), r"^\s{0,3}#{1,6}\s+"), F.col("text"))
    df = df.withColumn("_own", own).withColumn("heading", F.coalesce(F.last("_own", ignorenulls=True).over(w), F.lit("")))
    front = (F.col("heading") == "") & ~F.col("text").contains("\n") & (F.length(squeeze(F.col("text"))) <= 40)
    return df.where(F.col("_own").isNull() & ~front & ~has(F.col("text"), SECTION_LABEL)).select(id_col, "paragraph", "heading", "text")


def pair_blocks(blocks: DataFrame, revised: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, block_id, original, revised, how): each body block with its revision.

    blocks: (id, block_id, text) of body blocks; revised: (id, text), whole
    documents.  By position where as many body chunks come back, else where as
    many paragraphs do, else by the chunk of the same number, else unchanged.
    Texts are dealt by id before they are cut, not their parts after it.
    """
    revised = revised.select(id_col, "text").repartition(id_col)
    chunks = F.transform(F.filter(cut(F.col("text")), lambda p: p["kind"] != "blank"), lambda p: p["text"])
    # what holds Chinese is no English block
    body = F.filter(F.col("_chunks"), lambda t: t.rlike(P.CJK) & ~structural(t))
    new = revised.select(id_col, F.col("text").alias("_r"), chunks.alias("_chunks")).select(id_col, "_chunks", body.alias("_body"), plain_paragraphs(F.col("_r")).alias("_plain"))
    w = Window.partitionBy(id_col)
    own = blocks.select(id_col, "block_id", F.col("text").alias("original"), F.row_number().over(w.orderBy("block_id")).alias("_i"), F.count(F.lit(1)).over(w).alias("_n"))
    # cut texts are never broadcast: before they are made Spark takes a text for 20 bytes, so that gigabytes would go to the driver
    df = own.join(new.hint("merge"), id_col, "left")
    how = F.when(F.size("_body") == F.col("_n"), "chunks").when(F.size("_plain") == F.col("_n"), "paragraphs").when(F.col("block_id") <= F.size("_chunks"), "number").otherwise("kept")
    picked = F.when(F.col("how") == "chunks", F.try_element_at("_body", F.col("_i"))).when(F.col("how") == "paragraphs", F.try_element_at("_plain", F.col("_i"))).when(F.col("how") == "number", F.try_element_at("_chunks", F.col("block_id").cast("int")))
    return df.withColumn("how", how).select(id_col, "block_id", "original", F.coalesce(picked, F.col("original")).alias("revised"), "how")


def by_number(chunks: DataFrame, guidance: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chunks with their block's guidance by number; a chunk without any keeps its text (keep is true)."""
    return chunks.join(guidance.withColumn("_known", F.lit(True)), [id_col, "block_id"], "left").withColumn("keep", F.col("_known").isNull()).drop("_known")


def anchors(opening: Column) -> Column:
    """Names in an opening sentence by which its topic is known."""
    t = squeeze(F.regexp_replace(strip(opening), "[。！？?!；;]+$", ""))
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(ANCHORS), F.lit(0)), find_all(t, P.TECH_TOKEN_OR_CITATION)))


def topic_kept(original: Column, revised: Column, similar: Column) -> Column:
    """Whether a new opening holds enough of the anchors (or, without any, is similar)."""
    found = anchors(original)
    held = F.size(F.filter(found, lambda a: squeeze(revised).contains(a)))
    return F.when(F.size(found) == 0, similar >= 0.38).otherwise(held >= F.when(F.size(found) <= 2, 1).otherwise(2))


@F.pandas_udf(StringType())
def best_source(sentence: pd.Series, source: pd.Series, index: pd.Series) -> pd.Series:
    return pd.Series([repairs.best_source(s, list(o), int(i)) for s, o, i in zip(sentence, source, index, strict=True)])
