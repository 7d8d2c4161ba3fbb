"""Chapters: forward fill over blocks, type, priority, and grouped quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import contains_any, count, has, squeeze, strip


def clean_title(text: Column) -> Column:
    joined = F.array_join(F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != ""), " ")
    return strip(F.regexp_replace(joined, r"^\s{0,3}#{1,6}\s*", ""))


def fill(blocks: DataFrame, id_col: str = "doc_id", *order: str, text_col: str = "text") -> DataFrame:
    """Adds chapter_id and chapter_title: how many headings came so far (by order, block_id by default), and the last one's title."""
    w = Window.partitionBy(id_col).orderBy(*(order or ("block_id",))).rowsBetween(Window.unboundedPreceding, 0)
    first_line = F.split(strip(F.col(text_col)), "\n")[0]
    df = blocks.withColumn("_head", has(first_line, P.CHAPTER_HEADING))
    return df.withColumns({
        "chapter_id": F.sum(F.col("_head").cast("int")).over(w).cast("int"),
        "chapter_title": F.coalesce(F.last(F.when(F.col("_head"), clean_title(F.col(text_col))), ignorenulls=True).over(w), F.lit("Inferred section")),
    }).withColumnRenamed("_head", "is_heading")


def chapter_type(title: Column, text: Column) -> Column:
    """The first list of title words with a hit, else of content words, else background (no title) or method_design."""
    t, x = F.lower(squeeze(title)), F.lower(squeeze(text))
    out = None
    for over, lists in ((t, P.TITLE_WORDS), (x, P.CONTENT_WORDS)):
        for name, words in lists:
            hit = contains_any(over, words)
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.when(t == "", "background").otherwise("method_design"))


def technical_level(text: Column, n_sentences: Column) -> Column:
    cites, nums, tokens = count(text, P.CITATION), F.regexp_count(text, F.lit(P.NUMBER)), count(text, P.TECH_TOKEN)
    high = has(text, P.CHAPTER_PATH) | has(text, P.CHAPTER_FORMULA) | ((cites >= 2) & (nums >= 2)) | (nums >= 4) | (tokens >= 6) | (cites >= 3)
    medium = (nums >= 2) | (tokens >= 3) | (cites >= 1) | ((n_sentences <= 1) & ((nums > 0) | (tokens > 0)))
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def priority(kind: Column, level: Column) -> Column:
    return (
        F.when((kind == "error_analysis") & (level == "high"), "medium")
        .when((kind == "deployment_description") & (level != "low"), "conservative")
        .when(kind.isin(*P.CONSERVATIVE_TYPES), "conservative")
        .when(kind.isin(*P.HIGH_TYPES), "high")
        .when(level == "high", "conservative")
        .otherwise("medium")
    )


def intensity(priority_: Column) -> Column:
    return F.when(priority_ == "high", "high").when(priority_ == "conservative", "light").otherwise("medium")


def quota(priority_: Column, i: int) -> Column:
    return F.when(priority_ == "high", P.QUOTAS["high"][i]).when(priority_ == "medium", P.QUOTAS["medium"][i]).otherwise(P.QUOTAS["conservative"][i])


def summary(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per chapter: what its first block says."""
    w = Window.partitionBy(id_col, "chapter_id", "chapter_title").orderBy("block_id")
    first = blocks.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return first.select(id_col, "chapter_id", "chapter_title", "chapter_type", "chapter_priority", intensity(F.col("chapter_priority")).alias("chapter_intensity"))


def metrics(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per chapter from body blocks joined with their rewrite statistics.

    Reads block_id, chapter_id, chapter_title, chapter_type, chapter_priority, text,
    n_sentences, sensitive, changed, sentence_changes, cluster_changes,
    discourse_score, coverage, heavy.  Sums are combined before the shuffle.
    """
    high, conservative = F.col("chapter_priority") == "high", F.col("chapter_priority") == "conservative"
    total = F.greatest(F.col("n_sentences"), F.lit(1))
    units = F.greatest("sentence_changes", "cluster_changes")
    units = F.when((units <= 0) & (F.col("coverage") > 0), F.bround(F.col("coverage") * total).cast("int")).otherwise(units)
    cluster = F.when(high & (F.col("cluster_changes") <= 0) & (F.col("sentence_changes") >= 2) & (F.col("discourse_score") >= 2), 1).otherwise(F.col("cluster_changes"))
    on = F.col("changed")
    by = [*keys, "chapter_id", "chapter_title"]
    got = blocks.groupBy(*by).agg(
        F.min_by("chapter_type", "block_id").alias("chapter_type"), F.min_by("chapter_priority", "block_id").alias("chapter_priority"),
        F.count(F.lit(1)).alias("blocks"), F.sum(total).alias("sentences"), F.count_if(on).alias("changed_blocks"),
        F.sum(F.when(on, F.least(total, F.greatest(F.lit(1), units))).otherwise(0)).alias("changed_sentences"),
        F.sum(F.when(on, F.col("discourse_score")).otherwise(0)).alias("discourse"), F.sum(F.when(on, cluster).otherwise(0)).alias("cluster"),
        F.max(on & conservative & F.col("heavy")).alias("over_rewritten"), F.count_if(F.col("sensitive")).alias("sensitive_blocks"),
        F.count_if(has(F.col("text"), P.MIXED_MARKER)).alias("technical_blocks"),
    )
    got = got.withColumns({
        "chapter_coverage": F.col("changed_sentences") / F.greatest(F.col("sentences"), F.lit(1)),
        "changed_ratio": F.col("changed_blocks") / F.col("blocks"),
        **{n: quota(F.col("chapter_priority"), i).alias(n) for i, n in enumerate(("need_coverage", "need_ratio", "need_discourse", "need_cluster"))},
    })
    return _reasons(_relaxed(got)).drop("sensitive_blocks", "technical_blocks")


def _relaxed(m: DataFrame) -> DataFrame:
    """Quotas of short, small, sensitive, mixed or technical chapters; the first case that fits."""
    high, medium = F.col("chapter_priority") == "high", F.col("chapter_priority") == "medium"
    b, s = F.col("blocks"), F.col("sentences")
    mixed = (b <= 2) | (F.col("technical_blocks") / b >= 0.5)
    case = (
        F.when(high & (s < 2), "short").when(high & (b <= 4) & (s <= 12), "small").when(high & (F.col("sensitive_blocks") / b >= 0.5), "sensitive")
        .when(medium & mixed & ((b <= 1) | (s <= 2)), "tiny").when(medium & mixed & (b <= 2) & (F.col("changed_blocks") >= 1), "pair")
        .when(medium & mixed & (s <= 5) & (F.col("changed_sentences") >= 1), "few").when(medium & mixed, "mixed")
        .when(medium & F.col("chapter_type").isin(*P.TECHNICAL_MEDIUM_TYPES), "technical").otherwise("usual")
    )
    # What each case leaves of (coverage, ratio, discourse, cluster); None keeps it, a ratio is an upper bound.
    left = {
        "short": (None, None, None, 0), "small": (0.30, 0.25, None, None), "sensitive": (0.50, None, None, None), "tiny": (0.0, 0.0, 0, 0),
        "pair": (0.25, 0.25, 0, 0), "few": (0.20, 0.20, 0, 0), "technical": (0.30, None, None, None),
    }
    m = m.withColumn("quota_case", case)
    new = {}
    for i, name in enumerate(("need_coverage", "need_ratio", "need_discourse", "need_cluster")):
        out = F.col(name)
        for k, v in left.items():
            if v[i] is not None:
                out = F.when(F.col("quota_case") == k, F.least(F.col(name), F.lit(v[i]))).otherwise(out)
        new[name] = out
    return m.withColumns(new)


def _reasons(m: DataFrame) -> DataFrame:
    p = F.col("chapter_priority")
    low = {
        "coverage": F.col("chapter_coverage") < F.col("need_coverage"), "blocks": F.col("changed_ratio") < F.col("need_ratio"),
        "discourse": F.col("discourse") < F.col("need_discourse"), "cluster": F.col("cluster") < F.col("need_cluster"),
    }
    codes = F.array_compact(F.array(
        F.when((p == "high") & low["coverage"], "high_priority_chapter_coverage_below_quota"),
        F.when((p == "high") & low["blocks"], "high_priority_chapter_changed_blocks_below_quota"),
        F.when((p == "high") & low["discourse"], "high_priority_chapter_discourse_below_quota"),
        F.when((p == "high") & low["cluster"], "high_priority_chapter_cluster_below_quota"),
        F.when((p == "medium") & low["coverage"], "medium_priority_chapter_coverage_below_quota"),
        F.when((p == "medium") & low["blocks"], "medium_priority_chapter_changed_blocks_below_quota"),
        F.when((p == "medium") & low["discourse"] & (F.col("cluster") <= 0), "medium_priority_chapter_sentence_or_cluster_change_missing"),
        F.when((p == "conservative") & F.col("over_rewritten"), "conservative_chapter_over_rewritten"),
    ))
    return m.withColumns({"reasons": codes, "quota_met": F.size(codes) == 0})


def reason_codes(m: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, codes): all reasons of a document's chapters, each with its chapter's number."""
    own = F.transform("reasons", lambda r: F.concat(F.lit("chapter_"), F.col("chapter_id").cast("string"), F.lit("_"), r))
    return m.groupBy(id_col).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chapter_id", own.alias("codes")))), lambda x: x["codes"])).alias("codes"))
