"""Signal families over a paragraph's sentences: evidence, directness, second-language texture, distribution of style."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .readability import technical
from .text import clamp, count, has, squeeze, strip


def _sum(sentences: Column, one) -> Column:
    return F.aggregate(sentences, F.lit(0), lambda a, s: a + one(s))


def hits(sentences: Column, patterns: Iterable[str]) -> Column:
    """All matches of the patterns in the sentences."""
    def one(s: Column) -> Column:
        out = F.lit(0)
        for p in patterns:
            out = out + count(s, p)
        return out

    return _sum(sentences, one)


def holding(sentences: Column, *patterns: str) -> Column:
    """Sentences with a match of any pattern."""
    def any_(s: Column) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | has(s, p)
        return out

    return F.size(F.filter(sentences, any_))


def evidence(original: Column, revised: Column, sensitive: Column | bool = False) -> Column:
    """Whether a revision keeps to the source: shares of what it adds, and the scores made of them."""
    sensitive = sensitive if isinstance(sensitive, Column) else F.lit(sensitive)
    n = F.greatest(F.size(revised), F.lit(1))

    def added(patterns: Iterable[str]) -> Column:
        return F.greatest(F.lit(0), hits(revised, patterns) - hits(original, patterns))

    unsupported = F.round(clamp(added(P.UNSUPPORTED) / n), 4)
    metaphor = F.round(clamp((added(P.METAPHOR) + added(P.COMMENTARY) * 0.5) / n), 4)
    claim = F.round(clamp(added(P.AUTHORIAL) / n), 4)
    academic = holding(revised, *P.REGISTER)
    register = clamp(F.lit(0.78) + F.least(F.lit(0.16), academic / n * 0.18) + F.when(F.exists(revised, technical), 0.04).otherwise(0.0))
    register = F.round(clamp(register - unsupported * F.when(sensitive, 0.34).otherwise(0.24) - metaphor * 0.30 - claim * 0.22), 4)
    score = F.lit(0.94) - unsupported * F.when(sensitive, 0.58).otherwise(0.44) - metaphor * 0.24 - claim * 0.18
    score = F.round(clamp(score - F.when(F.size(original) == 0, 0.06).otherwise(0.0)), 4)
    empty = F.size(revised) == 0
    zero = F.lit(0.0)
    return F.struct(
        F.when(empty, zero).otherwise(score).alias("fidelity"), F.when(empty, zero).otherwise(unsupported).alias("unsupported"),
        F.when(empty, zero).otherwise(register).alias("register"), F.when(empty, zero).otherwise(metaphor).alias("metaphor"),
        F.when(empty, zero).otherwise(claim).alias("claim"), (empty | (score < F.when(sensitive, 0.78).otherwise(0.74))).alias("drift"),
    )


def subject_repeats(sentences: Column) -> Column:
    """Neighbours that open with the same explicit subject."""
    heads = F.transform(sentences, lambda s: F.regexp_extract(s, P.EXPLICIT_SUBJECT, 1))
    n = F.size(heads)
    left, right = F.slice(heads, 1, F.greatest(n - 1, F.lit(0))), F.slice(heads, 2, F.greatest(n - 1, F.lit(0)))
    return F.size(F.filter(F.zip_with(left, right, lambda a, b: (a != "") & (a == b)), lambda x: x))


def delayed(s: Column) -> Column:
    prefix = F.split(s, "[，,]", 2)[0]
    return has(s, P.DELAYED_MAIN) | (s.rlike("[，,]") & (F.length(prefix) >= 34) & prefix.rlike(P.DELAYED_PREFIX))


def overlong(s: Column) -> Column:
    t = squeeze(s)
    return (F.length(t) >= 86) & (count(t, P.LOGIC_MARK) >= 3)


def directness(sentences: Column) -> Column:
    """Densities of indirect syntax, and the score they leave."""
    n = F.greatest(F.size(sentences), F.lit(1))

    def share(x: Column, of: Column = n) -> Column:
        return F.round(F.least(F.lit(1.0), x / of), 4)

    late = share(F.size(F.filter(sentences, delayed)))
    connector = share(_sum(sentences, lambda s: count(s, P.CONNECTOR)), n * 2)
    nominal = share(_sum(sentences, lambda s: count(s, P.NOMINALIZATION)), n * 2)
    passive = share(_sum(sentences, lambda s: count(s, P.PASSIVE)))
    long_ = share(F.size(F.filter(sentences, overlong)))
    penalty = F.least(
        F.lit(1.0), holding(sentences, P.WRAPPER) / n * 0.28 + late * 0.22 + connector * 0.16 + nominal * 0.14 + passive * 0.10 + long_ * 0.10
    )
    return F.struct(
        share(holding(sentences, P.BUREAUCRATIC)).alias("bureaucratic"), share(subject_repeats(sentences), F.greatest(n - 1, F.lit(1))).alias("repeated_subject"),
        share(holding(sentences, P.OVERSTRUCTURED)).alias("overstructured"), late.alias("delayed"), share(holding(sentences, P.SLOGAN)).alias("slogan"),
        connector.alias("connector"), nominal.alias("nominalization"), passive.alias("passive"), long_.alias("overlong"),
        F.round(F.greatest(F.lit(0.0), 1.0 - penalty), 4).alias("directness"),
    )


def texture(sentences: Column) -> Column:
    """Mild second-language texture of a paragraph."""
    text = F.array_join(sentences, "")
    n = F.greatest(F.size(sentences), F.lit(1))
    chars = F.greatest(F.length(squeeze(text)), F.lit(1))
    one = F.lit(1.0)
    density = F.round(F.least(one, count(text, P.L2_FUNCTION) / F.greatest(one, chars / 18)), 4)
    explained = F.least(one, holding(sentences, P.L2_EXPLANATORY) / n)
    score = F.round(F.least(one, density * 0.45 + F.least(one, count(text, P.L2_TEXTURE) / n) * 0.35 + explained * 0.20), 4)
    return F.struct(
        score.alias("texture"), density.alias("function_words"), F.round(explained, 4).alias("explanatory"),
        F.round(F.least(one, count(text, P.L2_NATIVE) / (n * 2)), 4).alias("native"),
        F.round(F.least(one, count(text, P.L2_COLLOQUIAL) / n), 4).alias("colloquial"),
        F.round(F.least(one, count(text, P.L2_UNGRAMMATICAL) / n), 4).alias("ungrammatical"),
    )


def trimmed(sentences: Column) -> Column:
    return F.filter(F.transform(sentences, strip), lambda s: s != "")
