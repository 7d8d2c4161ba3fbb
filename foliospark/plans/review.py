"""The review plan: (original, revised) pairs -> checks -> decision -> gate -> the chosen candidate. No shuffle before the choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences
from ..operators import changes, integrity, ranking


def review(pairs: DataFrame, original: str = "original", revised: str = "revised") -> DataFrame:
    """Adds checks (map), problems, warnings, decision, change counts and gate."""
    o, r = F.col(original), F.col(revised)
    checks = integrity.checks(o, r)
    own = integrity.review_counts(o, r)
    df = pairs.withColumn("_c", F.struct(*[c.alias(k) for k, c in {**checks, **own}.items()]))
    named = {k: F.col(f"_c.{k}") for k in checks}
    df = df.withColumns({
        "problems": ranking.failed(named),
        "warnings": F.array_compact(F.array(*[F.when(~F.col(f"_c.{k}"), k) for k in own])),
        "changed": changes.positional_changes(sentences(o), sentences(r)),
        "checks": F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*named.values())),
    })
    df = df.withColumn("decision", ranking.decision(F.col("problems"), F.col("warnings")))
    codes = F.array_compact(F.array(F.when(o == r, "no_change"), F.when(F.col("changed") == 0, "no_sentence_changed")))
    return df.withColumn("gate", ranking.gate(F.lit(True), F.col("decision"), codes)).drop("_c")


def choose(reviewed: DataFrame, id_col: str = "doc_id", ordinal: str = "ordinal") -> DataFrame:
    """The writable candidate with the most changed sentences and fewest warnings of each document, or the best attempt."""
    df = reviewed.withColumns({"write_allowed": F.col("gate.write_allowed"), "score": F.struct(F.col("changed").alias("a"), (-F.size("warnings")).alias("b"))})
    # maps have no order and stay out of the choice
    return ranking.select(df.drop("checks"), id_col, "score", ordinal)


def retry(first: DataFrame, second: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A later pass only for the documents whose first pass may not be written."""
    return second.join(first.where("not write_allowed").select(id_col), id_col, "left_semi")
