"""Exact dedup by progressive refinement: byte length, then a hash of the first characters, then the full hash.

Texts are equal when identical after no change; null counts as empty.  Of
equal texts the row with the largest id stays.  Rows that repeat an id and a
text stay or go together (they are one document).  Empty texts form one group,
an empty table gives an empty result; other columns are never looked at.

Counts are shuffled by key, one row per task and key (partial aggregation).  Up
to BROADCAST_KEYS surviving keys texts never are; beyond, they meet the keys in
a semi join, before which Spark can sieve them.  Rows meet their group in a join
that can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Keys (of 16 bytes) up to which the surviving keys are broadcast; beyond it they meet the rows in shuffles.
BROADCAST_KEYS = 500_000
PREFIX_CHARS = 64


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with their keys, groups of two and more).

    rows: _id, _len, _prefix, _full (null where the first two keys already set the text apart) and the extra columns.
    groups: _len, _prefix, _full, keep_id, group_size.
    """
    extra = extra or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(
        F.col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).alias("_len"),
        F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("_prefix"), *(c.alias(k) for k, c in extra.items()),
    )
    by_length = keys.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_len")
    by_prefix = (
        keys.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        .join(by_length, "_len", "left_semi").select("_len", "_prefix")
    )
    left = materialise(by_prefix, "dedup-keys")
    full = F.unhex(F.sha2(F.col("_text").cast("binary"), 256))
    if left.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        rows = keys.join(F.broadcast(left.withColumn("_hit", F.lit(True))), ["_len", "_prefix"], "left")
        rows = rows.select("_id", "_len", "_prefix", F.when(F.col("_hit"), full).alias("_full"), *extra)
    else:
        # texts of survivors alone are hashed; rows that are set apart go without their text
        same = ["_len", "_prefix"]
        rows = keys.join(left, same, "left_semi").select("_id", *same, full.alias("_full"), *extra)
        rows = rows.unionByName(keys.drop("_text").join(left, same, "left_anti").select("_id", *same, F.lit(None).cast("binary").alias("_full"), *extra))
    groups = (
        rows.where("_full is not null").groupBy("_len", "_prefix", "_full")
        .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    )
    return rows, materialise(groups, "dedup-groups")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, and the extra columns (of the input's columns)."""
    rows, groups = refine(docs, id_col, text_col, extra)
    rows = rows.join(groups, ["_len", "_prefix", "_full"], "left").withColumn("keep_id", F.coalesce("keep_id", "_id"))
    return rows.select(
        F.col("_id").alias(id_col), "keep_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("keep_id").eqNullSafe(F.col("_id")).alias("kept"), *(extra or {}),
    )


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What a document is told by: its id (or none) and 128 bits of its text, as struct<id,h0,h1>. Verdicts on texts carry it as their id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.struct(F.col(id_col).alias("id"), *(F.xxhash64(F.lit(i), text).alias(f"h{i}") for i in range(2)))


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose key is in gone (id, h0, h1). Null ids are equal; a text under the id of a dropped one stays.

    Keys go to the rows if they are few, else both meet in a shuffle.
    """
    gone = materialise(gone.select(*(F.col(c).alias(f"_gone_{c}") for c in ("id", "h0", "h1"))).distinct(), "dropped-rows")
    if gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    text = F.coalesce(docs[text_col], F.lit(""))
    same = docs[id_col].eqNullSafe(F.col("_gone_id"))
    for i in range(2):
        same &= F.xxhash64(F.lit(i), text) == F.col(f"_gone_h{i}")
    return docs.join(gone, same, "left_anti")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, whole: those that exact_duplicates marks as kept. A row without an id goes if an equal text has one."""
    rows, groups = refine(docs, id_col, text_col, {"_key": row_key(id_col, text_col)})
    gone = rows.join(groups, ["_len", "_prefix", "_full"]).where("keep_id is not null and not (_id <=> keep_id)").select("_key.*")
    return without_rows(docs, gone, id_col, text_col)
