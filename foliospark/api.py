"""What a program calls: guide, revise, review and write over tables or folders of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions.text import each_sentence
from .operators import paragraph, rewrite, suggest
from .plans import guidance
from .plans import guide as guide_plan
from .plans import review as review_plan
from .sources import convert, files
from .sources.convert import read_inputs as convert_inputs


def load(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), suffix and Markdown text of the good files below a folder."""
    good = files.normalised(files.read_corpus(spark, path)).where("problem is null")
    return good.select(F.col("path").alias("doc_id"), "suffix", "text")


def load_inputs(spark: SparkSession, path: str, convert=convert.by_command) -> DataFrame:
    """doc_id (the path), text and report of all inputs below a folder, .docx and .doc too; text is null where a report says why."""
    return convert_inputs(spark, path, convert).select(F.col("path").alias("doc_id"), "text", "report")


def guide_documents(docs: DataFrame) -> DataFrame:
    return guide_plan.report(docs)


def review_candidates(pairs: DataFrame) -> DataFrame:
    """pairs: doc_id, ordinal, original, revised."""
    return review_plan.review(pairs)


def revise(docs: DataFrame, preset: str = "academic_natural") -> DataFrame:
    """Rewritten documents with review and gate: body blocks are rewritten sentence by sentence, everything else is kept, byte for byte.

    doc_id, ordinal, original, revised and the review's columns.
    """
    mode, _, _ = config.preset(preset)
    body = F.col("edit_policy").isin("rewritable", "light_edit") if mode != "conservative" else F.col("edit_policy") == "rewritable"
    change = rewrite.l2_variant if preset == "zh_academic_l2_mild" else rewrite.naturalise
    cut = guide_plan.blocks(docs).withColumn("_new", F.when(body, each_sentence(F.col("text"), change)).otherwise(F.col("text")))
    part = F.struct("block_id", "part", F.concat("before", "text").alias("o"), F.concat("before", "_new").alias("r"))
    ordered = cut.groupBy("_row", "doc_id").agg(F.array_sort(F.collect_list(part)).alias("_b"))  # a document's own parts
    whole = [F.array_join(F.col(f"_b.{k}"), "").alias(n) for k, n in (("o", "original"), ("r", "revised"))]
    return review_plan.review(ordered.select("doc_id", F.lit(1).alias("ordinal"), *whole))


def rewrite_documents(docs: DataFrame, preset: str = "academic_natural", backend=paragraph.rewrite_paragraph) -> DataFrame:
    """Documents rewritten by the paragraph rules, with the memory of each document; the best of the preset's passes that may be written.

    Body paragraphs go through the backend in order (any function with the
    arguments of paragraph.rewrite_paragraph); everything else is kept byte for
    byte.  Each further pass is made only of documents whose passes so far may
    not be written.  doc_id, ordinal (the pass), original, revised and the
    review's columns.
    """
    mode, passes, _ = config.preset(preset)
    kept = guide_plan.blocks(docs)
    body = F.col("edit_policy").isin("rewritable", "light_edit") if mode != "conservative" else F.col("edit_policy") == "rewritable"
    part = F.struct("block_id", "part", "before", "text", body.alias("body"))
    whole = kept.groupBy("_row", "doc_id").agg(F.array_sort(F.collect_list(part)).alias("_b"))  # a document's own parts
    original = F.array_join(F.transform("_b", lambda b: F.concat(b["before"], b["text"])), "").alias("original")
    source = F.transform(F.filter("_b", lambda b: b["body"]), lambda b: b["text"])
    tried, left = None, whole
    for number in range(1, passes + 1):
        new = paragraph.rewriter(mode, number, "developmental_rewrite", "high" if mode == "strong" else "medium", backend)(source)
        done = left.select("_row", "doc_id", "_b", original, new.alias("_new")).withColumn("_place", F.transform("_b", lambda b, i: F.size(F.filter(F.slice("_b", 1, i + 1), lambda x: x["body"]))))
        text = F.zip_with("_b", "_place", lambda b, i: F.concat(b["before"], F.when(b["body"], F.try_element_at(F.col("_new"), i)["text"]).otherwise(b["text"])))
        reviewed = review_plan.review(done.select("_row", "doc_id", F.lit(number).alias("ordinal"), "original", F.array_join(text, "").alias("revised")))
        tried = reviewed if tried is None else tried.unionByName(reviewed)
        left = left.join(reviewed.where("not gate.write_allowed").select("_row"), "_row", "left_semi")
    best = review_plan.choose(tried, "_row")
    return best.drop("_row")


def doctrine(style: str = "academic_natural") -> tuple[str, ...]:
    """The principles that a style's revisions follow."""
    return guidance.doctrine(style)


def write(reviewed: DataFrame, path: str) -> None:
    out = reviewed.select("*", F.col("gate.write_allowed").alias("write_allowed")).drop("checks")
    files.write_allowed(out, path)


def suggestions(docs: DataFrame) -> DataFrame:
    """doc_id, block_id, excerpt and suggestions of the paragraphs that have any."""
    from .functions.text import excerpt

    b = guide_plan.blocks(docs).where("edit_policy <> 'do_not_touch'")
    return b.select("doc_id", "block_id", excerpt(F.col("text")).alias("excerpt"), suggest.suggestions(F.col("text")).alias("suggestions")).where("size(suggestions) > 0")
