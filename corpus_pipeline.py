"""The corpus pipeline: five stages, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read back as the next one's docs.  All but the last
return the columns of documents; the last returns doc_id, n_tokens, ids and the
digest of the decoded text.  Documents go when the language model finds no
letter in them or no language likelier than even, when a copy with a larger id
is kept (exact), when they are near copies of one with a smaller id, or when a
twentieth of their words is hit by benchmark windows.

A document is told by its id and its text: rows that repeat both stay or go
together, and dropping one text leaves others that share its id.  Rows without
an id are judged by their texts like others; as copies they go where an equal
text, or one of the same fingerprint, has an id, and else stay.  Near copies
are linked by ids: see simhash.drop_near_duplicates for shared ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import decontaminate, exact_dedup, language_id, sentencepieces, simhash
from foliospark.llm.common import crc_fold, materialise

#: a document whose language is no likelier than this goes
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the known languages; those of folds 1 to 4 are learned from."""
    langs, p = language_id.train(docs.where(crc_fold(F.col("doc_id"), 5) != 0))
    found = language_id.predict(docs.select(exact_dedup.row_key().alias("key"), "text"), langs, p, "key")
    rejected = found.where((F.col("lang_pred") == "und") | (F.col("score") <= LEAST_SCORE))
    return exact_dedup.without_rows(docs, rejected.select("key.*"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = sentencepieces.encode(docs, decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("sentencepiece", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: language ID, SimHash components and piece ids have no SQL form; tests/llm hold the rows against brute force
ORACLE_SQL = None
