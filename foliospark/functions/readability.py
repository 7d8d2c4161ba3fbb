"""Sentence completeness and paragraph readability, as column expressions over arrays of sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import clamp, count, has, let, mean, squeeze, starts_with_any, strip, u


def technical(s: Column) -> Column:
    return count(s, P.TECH_MARKER) >= 3


def subject_like(s: Column) -> Column:
    def nominal(head: Column) -> Column:
        return let(F.length(squeeze(head)), lambda n: (n >= 2) & (n <= 18)) & head.rlike(P.NOMINAL_HEAD)

    def test(t: Column) -> Column:
        return t.rlike(P.SUBJECT) | has(t, P.TAXONOMY) | let(F.split(t, "[，,：:；;]", 2)[0], nominal)

    t = strip(F.regexp_replace(strip(s), u(P.IMPLICATION), ""))
    return let(F.regexp_replace(t, u(P.ORDINAL), ""), test)


def complete_clause(s: Column) -> Column:
    return let(F.regexp_replace(strip(s), u(P.ORDINAL), ""), lambda t: (t != "") & t.rlike(P.PREDICATE) & subject_like(t))


def facts(s: Column) -> Column:
    """What the rules ask of a trimmed sentence, each thing once."""
    base = F.struct(
        s.alias("s"), has(s, P.LIST_LEAD).alias("lead"), has(s, P.TAXONOMY).alias("taxonomy"), technical(s).alias("technical"), subject_like(s).alias("subject"),
        s.rlike(P.PREDICATE).alias("predicate"), F.length(squeeze(s)).alias("size"), has(s, P.COMPARISON).alias("comparison"), has(s, P.PREPOSITION).alias("preposition"),
        has(s, P.COLON_TAIL).alias("colon"), has(s, P.RESULT_LEAD).alias("result"), s.rlike(P.VERB_OPEN).alias("verb"), s.rlike(P.CAUSATIVE).alias("causative"),
        has(s, P.DANGLING).alias("marker"),
    )

    def more(f: Column) -> Column:
        fragment = f["comparison"] | f["preposition"] | f["colon"] | f["result"] | f["verb"] | (f["causative"] & ~f["subject"])
        exempt = starts_with_any(f["s"], P.DANGLING_EXEMPT) & complete_clause(strip(F.regexp_replace(f["s"], u(P.DANGLING), "")))
        hangs = F.when((f["s"] == "") | f["lead"] | f["taxonomy"], False).when(f["marker"], ~exempt).when(f["technical"], False).otherwise(fragment)
        return F.struct(f.alias("f"), hangs.alias("dangling"))

    return let(base, more)


def _score(v: Column, role: Column) -> Column:
    f = v["f"]
    s = f["s"]
    implied = has(s, P.IMPLICATION) & let(strip(F.regexp_replace(s, u(P.IMPLICATION), "")), lambda t: (t != "") & complete_clause(t))
    return (
        F.when(s == "", 0.0).when(implied, 0.82).when(f["lead"], 0.88).when(f["taxonomy"] | f["technical"], 0.84).when(v["dangling"], 0.36).when(f["comparison"], 0.34)
        .when(f["preposition"], 0.42).when(f["colon"], 0.46).when(f["result"], 0.44).when(f["verb"], 0.50).when(f["causative"] & ~f["subject"], 0.42).when(has(s, P.ESPECIALLY), 0.58)
        .when(~f["predicate"] & (f["size"] < 18), 0.48).when(~f["predicate"], 0.58)
        .when(~f["subject"] & role.isin("support_sentence", "conclusion_sentence") & (f["size"] < 22), 0.62)
        .when(starts_with_any(s, ("而", "并", "从而", "进而")) & ~f["subject"], 0.52).when(f["subject"], 0.90).otherwise(0.78)
    )


def _support(v: Column, role: Column) -> Column:
    f = v["f"]
    return F.when((role == "topic_sentence") | (f["s"] == "") | f["technical"] | f["lead"] | f["taxonomy"], False).otherwise(
        v["dangling"] | (_score(v, role) < 0.66) | (~f["subject"] & (f["size"] < 24)) | starts_with_any(f["s"], ("而是", "并进一步", "从而", "进而"))
    )


def _conclusion(v: Column, closing: Column) -> Column:
    f = v["f"]
    s, lead = f["s"], r"^(?:因此|由此|从而|进而)[，,\s]*"
    implied = has(s, lead + r"\S")
    weak = (implied & ~complete_clause(F.regexp_replace(s, u(lead), ""))) | (~implied & starts_with_any(s, ("是比", "而是"))) | (_score(v, F.lit("conclusion_sentence")) < 0.58)
    return F.when((s == "") | f["technical"] | f["lead"], False).when(f["comparison"], True).otherwise(closing & weak)


def dangling(s: Column) -> Column:
    """Depends on a clause that is missing. s is trimmed."""
    return facts(s)["dangling"]


def completeness(s: Column, role: Column) -> Column:
    """0 to 1: whether the sentence can stand alone. The first rule that fits decides."""
    return let(facts(s), lambda v: _score(v, role))


def incomplete_support(s: Column, role: Column) -> Column:
    return let(facts(s), lambda v: _support(v, role))


def fragment_conclusion(s: Column, closing: Column) -> Column:
    """closing: the sentence is the last or has that role."""
    return let(facts(s), lambda v: _conclusion(v, closing))


def role_at(i: Column, n: Column) -> Column:
    return F.when(i == 0, "topic_sentence").when(i == n - 1, "conclusion_sentence").otherwise("support_sentence")


def per_sentence(sentences: Column) -> Column:
    """array<struct<sentence,role,score,dangling,support,conclusion>> of trimmed sentences."""
    n = F.size(sentences)

    def one(s: Column, i: Column) -> Column:
        # role and place go along with the facts: a lambda within another that reads the other's variable can't be an argument of a Python function
        asked = F.struct(facts(s).alias("v"), role_at(i, n).alias("role"), (i == n - 1).alias("closing"))
        return let(asked, lambda x: F.struct(
            x["v"]["f"]["s"].alias("sentence"), x["role"].alias("role"), _score(x["v"], x["role"]).alias("score"), x["v"]["dangling"].alias("dangling"),
            _support(x["v"], x["role"]).alias("support"), _conclusion(x["v"], x["closing"]).alias("conclusion"),
        ))

    return F.transform(sentences, one)


def paragraph(rows: Column, sensitive: Column | bool = False) -> Column:
    """Signals of one paragraph from per_sentence: means and shares, rounded to 4 places."""
    sensitive = sensitive if isinstance(sensitive, Column) else F.lit(sensitive)
    n = F.size(rows)

    def share(name: str) -> Column:
        return F.size(F.filter(rows, lambda r: r[name])) / F.greatest(n, F.lit(1))

    whole = mean(F.transform(rows, lambda r: r["score"]))
    first, last = F.try_element_at(rows, F.lit(1)), F.try_element_at(rows, F.lit(-1))
    opening = F.when((first["score"] >= 0.72) & ~first["dangling"], 0.05).otherwise(-0.08)
    ending = F.when((last["score"] >= 0.72) & ~last["conclusion"], 0.04).otherwise(-0.08)
    issues = F.exists(rows, lambda r: r["dangling"] | r["support"])
    value = clamp(
        whole - share("dangling") * 0.24 - share("support") * 0.20 - share("conclusion") * 0.16 + opening + ending
        - F.when(sensitive & issues, 0.08).otherwise(0.0)
    )
    empty = n == 0
    return F.struct(
        F.when(empty, 1.0).otherwise(F.round(whole, 4)).alias("completeness"), F.round(share("dangling"), 4).alias("dangling"),
        F.when(empty, 1.0).otherwise(F.round(value, 4)).alias("readability"), F.round(share("support"), 4).alias("incomplete_support"),
        F.round(share("conclusion"), 4).alias("fragment_conclusion"), n.alias("sentences"),
    )
