"""Reading and writing corpora: files of Markdown and plain text, Parquet tables, reports."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import config
from ..functions.text import strip

_READ = StructType([StructField("encoding", StringType()), StructField("text", StringType())])


@F.pandas_udf(_READ)
def decoded(content: pd.Series) -> pd.DataFrame:
    """The first of the known encodings that decodes the bytes; null where none does."""
    def one(raw) -> tuple:
        raw = bytes(raw)
        for e in config.ENCODINGS:
            if e == "utf-8-sig" and not raw.startswith(b"\xef\xbb\xbf"):
                continue
            try:
                return e, raw.decode(e)
            except UnicodeDecodeError:
                continue
        return None, None

    return pd.DataFrame([one(x) for x in content], columns=["encoding", "text"])


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def validated(files: DataFrame) -> DataFrame:
    """binaryFile rows -> path, suffix, size, encoding, text, problem (null for a good file). Nothing is dropped."""
    df = files.select("path", suffix(F.col("path")).alias("suffix"), F.col("length").alias("size"), "content")
    early = (
        F.when(~F.col("suffix").isin(*config.SUFFIXES), "unsupported_suffix").when(F.col("size") > config.MAX_FILE_BYTES, "file_too_large")
    )
    df = df.withColumn("problem", early)
    # files that fail already are not decoded
    df = df.withColumn("r", decoded(F.when(F.col("problem").isNull(), F.col("content")).otherwise(F.lit(b"").cast("binary"))))
    problem = F.coalesce("problem", F.when(F.col("r.encoding").isNull(), "undecodable"))
    return df.select("path", "suffix", "size", "r.encoding", F.when(problem.isNull(), F.col("r.text")).alias("text"), problem.alias("problem"))


def read_corpus(spark: SparkSession, path: str, glob: str = "*.{md,txt}") -> DataFrame:
    """Markdown and text files below a folder, one row each; rows with a problem are for the quarantine."""
    return validated(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))


def normalised(df: DataFrame) -> DataFrame:
    """Text as Markdown: .md as it is, .txt trimmed with one line break at its end. Other formats need a converter and get a status."""
    text = F.when(F.col("suffix") == ".txt", F.concat(strip(F.col("text")), F.lit("\n"))).otherwise(F.col("text"))
    status = F.when(F.col("problem").isNotNull(), "failed").when(F.col("suffix") == ".txt", "normalized").otherwise("passthrough")
    error = F.when(F.col("suffix").isin(".docx", ".doc"), "a document converter is needed for this format").otherwise(F.col("problem"))
    return df.withColumns({"text": text, "status": status, "error": error})


def output_path(path: Column, kind: str = "revised") -> Column:
    """stem.revised.suffix, or stem.report.json."""
    return F.regexp_replace(path, r"\.[^./]+$", ".report.json") if kind == "report" else F.regexp_replace(path, r"(\.[^./]+)$", f".{kind}$1")


@F.pandas_udf(StringType())
def unified_diff(original: pd.Series, revised: pd.Series) -> pd.Series:
    return pd.Series(["".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), "original", "revised")) for a, b in zip(original, revised, strict=True)])


def write_allowed(df: DataFrame, path: str) -> None:
    """Revisions that the gate allows, as Parquet by decision."""
    df.where("write_allowed").write.mode("overwrite").partitionBy("decision").parquet(path)


def write_reports(df: DataFrame, path: str) -> None:
    """One JSON object per document."""
    df.write.mode("overwrite").json(path)


def human_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text lines `name: value`, yes and no for flags."""
    kinds = dict(df.dtypes)
    line = [F.concat(F.lit(f"{c}: "), F.when(F.col(c), "yes").otherwise("no") if kinds[c] == "boolean" else F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in columns]
    return df.withColumn("report", F.array_join(F.array(*line), "\n"))


__all__ = ["human_report", "normalised", "output_path", "read_corpus", "suffix", "unified_diff", "validated", "write_allowed", "write_reports"]
