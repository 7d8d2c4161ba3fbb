"""Integrity of a revision: twelve comparisons of what must survive, each an expression over both texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import count, find_all, numbers, paragraphs, squeeze, strip, term

CHECKS = (
    "title", "formula", "citation", "terminology", "numeric", "path", "heading_format", "english_spacing", "placeholder", "caption_punctuation",
    "markdown_symbol", "linebreak_whitespace",
)


def captions(text: Column) -> Column:
    both = F.concat(find_all(text, P.CAPTION_LINE), find_all(text, P.CAPTION_FRAGMENT))
    return F.array_distinct(F.transform(both, squeeze))


def formulas(text: Column) -> Column:
    return F.concat(*[find_all(text, p) for p in (P.FORMULA_BLOCK, P.FORMULA_INLINE, P.FORMULA_LINE)])


def paths(text: Column) -> Column:
    return F.array_distinct(F.concat(find_all(text, P.CHECKPOINT), find_all(text, P.PATH)))


def placeholders(text: Column) -> Column:
    return F.concat(*[find_all(text, p) for p in (P.IMAGE, P.LINK, P.LINK_DEF, P.AUTOLINK, P.URL)])


def english_paragraphs(text: Column) -> Column:
    """Paragraphs without Chinese and with four English words."""
    return F.filter(paragraphs(text), lambda p: ~p.rlike(P.CJK) & (F.regexp_count(p, F.lit(P.ENGLISH_WORD)) >= 4))


def blank_runs(text: Column) -> Column:
    """Lengths of the runs of blank lines, in order."""
    marks = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(strip(x) == "", "b").otherwise("x")), "")
    # a last line break ends a line, it does not begin one
    marks = F.when(text.endswith("\n"), F.regexp_replace(marks, ".$", "")).otherwise(marks)
    return F.transform(F.regexp_extract_all(marks, F.lit("b+"), F.lit(0)), lambda x: F.length(x))


def trailing(text: Column) -> Column:
    return count(text, r"(?m)[ \t]+$")


def symbols(text: Column) -> Column:
    return F.array(*[count(text, p) for p in (P.HEADING_LINE, P.IMAGE, P.LINK, P.LINK_DEF, P.AUTOLINK, P.URL, P.REFERENCE_LINE)])


def all_terms(text: Column) -> Column:
    return F.filter(F.transform(F.flatten(F.array(*[find_all(text, p) for p in P.TERMS])), term), lambda x: x != "")


def checks(original: Column, revised: Column) -> dict[str, Column]:
    """The twelve comparisons, true where the revision keeps what it must."""
    def same(f) -> Column:
        return f(original) == f(revised)

    def headings(t: Column) -> Column:
        return find_all(t, P.HEADING_LINE)

    caught = captions(revised)
    return {
        "title": same(headings),
        "formula": same(formulas),
        "citation": same(lambda t: find_all(t, P.CITATION)),
        # first occurrences only on both sides, so containment of bags is containment of sets
        "terminology": F.size(F.array_except(all_terms(original), all_terms(revised))) == 0,
        "numeric": F.size(F.array_except(numbers(original), numbers(revised))) == 0,
        "path": same(paths),
        "heading_format": same(headings),
        "english_spacing": same(english_paragraphs),
        "placeholder": same(placeholders),
        "caption_punctuation": same(captions) & ~F.exists(caught, lambda c: c.contains("：。")),
        "markdown_symbol": same(symbols),
        "linebreak_whitespace": same(blank_runs) & (trailing(revised) <= trailing(original)),
    }


def review_counts(original: Column, revised: Column) -> dict[str, Column]:
    """The reviewer's own: equal numbers of headings, fences and links, and no new Chinese semicolons."""
    def semicolons(t: Column) -> Column:
        return F.length(t) - F.length(F.replace(t, F.lit("；"), F.lit("")))

    return {
        "headings_kept": count(original, P.HEADING_LINE) == count(revised, P.HEADING_LINE),
        "fences_kept": count(original, P.FENCE) == count(revised, P.FENCE),
        "links_kept": count(original, P.LINK) + count(original, P.URL) == count(revised, P.LINK) + count(revised, P.URL),
        "no_new_semicolons": semicolons(revised) <= semicolons(original),
    }


def protection(text: Column) -> Column:
    """How many blocks of each protected kind a text has."""
    return F.struct(
        F.size(find_all(text, P.HEADING_LINE)).alias("headings"), F.size(formulas(text)).alias("formulas"), F.size(english_paragraphs(text)).alias("english"),
        F.size(placeholders(text)).alias("placeholders"), F.size(captions(text)).alias("captions"),
    )


def segments_of(kind: Column, text: Column) -> Column:
    """Protected segments of a block that must stay, by its kind."""
    def bare(values: Column) -> Column:
        return F.transform(values, squeeze)

    return (
        F.when(kind == "heading", bare(find_all(text, P.HEADING_LINE))).when(kind == "reference", bare(find_all(text, P.REFERENCE_LINE)))
        .when(kind == "english_block", F.array_distinct(F.concat(bare(english_paragraphs(text)), placeholders(text))))
        .when(kind == "caption", captions(text)).when(kind == "placeholder", placeholders(text)).otherwise(F.array().cast("array<string>"))
    )


def items_kept(items: Column, revised: Column) -> Column:
    return F.forall(items, lambda i: revised.contains(i))


def drift(original: Column, revised: Column) -> Column:
    """New percentages, years and claims, and terms lost."""
    percents = lambda t: find_all(t, r"[0-9]+(?:\.[0-9]+)?%")
    years = lambda t: find_all(t, r"20[0-9]{2}年")
    lost = F.array_except(all_terms(original), all_terms(revised))
    return F.struct(
        F.size(F.array_except(percents(revised), percents(original))).alias("new_percentages"),
        F.size(F.array_except(years(revised), years(original))).alias("new_years"), F.size(lost).alias("lost_terms"),
    )


