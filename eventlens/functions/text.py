"""Phrase matching and text clean-up."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_DESCRIPTION_LIMIT = 4900  # fixed value: stored description length
LANGUAGE_CODE_LIMIT = 16  # fixed value: stored language code length


def phrase_pattern(term: str) -> str:
    """Unicode word-boundary pattern of one literal phrase, lower-cased."""
    return r"(?U)\b\Q" + term.lower().replace(r"\E", r"\E\\E\Q") + r"\E\b"


def _lower(text: Column, lowered: bool) -> Column:
    return text if lowered else F.lower(F.coalesce(text, F.lit("")))


def _holds_any(low: Column, terms: Iterable[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(low, F.lit(t))
    return found


def mentions(text: Column, term: str, lowered: bool = False) -> Column:
    """TRUE when the lower-cased text holds the phrase between word boundaries.

    The plain substring test is many times cheaper than the pattern and settles most texts.
    Pass `lowered` for a non-NULL text that is lower-cased already.
    """
    low = _lower(text, lowered)
    return F.contains(low, F.lit(term.lower())) & low.rlike(phrase_pattern(term))


def mentions_any(text: Column, terms: Iterable[str], lowered: bool = False) -> Column:
    """TRUE when any phrase is mentioned; one alternation after the substring tests."""
    wanted = sorted({t.lower() for t in terms})
    if not wanted:
        return F.lit(False)
    low = _lower(text, lowered)
    alternation = "(?U)(?:" + "|".join(phrase_pattern(t)[4:] for t in wanted) + ")"
    return _holds_any(low, wanted) & low.rlike(alternation)


def matched_terms(text: Column, terms: Sequence[str], lowered: bool = False) -> Column:
    """Sorted array of the configured terms the text mentions."""
    ordered = sorted({t.lower() for t in terms})
    hits = [F.when(mentions(text, t, lowered), F.lit(t)) for t in ordered]
    return F.array_compact(F.array(*hits)).cast("array<string>") if hits else F.array().cast("array<string>")


def title_and_description(title: Column, description: Column) -> Column:
    """Relevance text; a phrase may span the join."""
    return F.concat(
        F.lower(F.coalesce(title, F.lit(""))), F.lit(" "), F.lower(F.coalesce(description, F.lit("")))
    )


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def canonical_terms(terms: Column) -> Column:
    """Stripped, lower-cased, NULL-free, sorted; duplicates and empty terms are kept."""
    return F.array_sort(F.transform(F.filter(terms, lambda t: t.isNotNull()), lambda t: F.lower(stripped(t))))


def language_code(audio: Column, default: Column) -> Column:
    """Audio language, else default language, trimmed and cut; UNKNOWN when neither is given."""
    chosen = F.coalesce(F.when(audio != "", audio), F.when(default != "", default))
    return F.coalesce(F.substring(F.lower(stripped(chosen)), 1, LANGUAGE_CODE_LIMIT), F.lit("UNKNOWN"))


def stored_description(description: Column) -> Column:
    return F.substring(F.coalesce(description, F.lit("")), 1, TITLE_DESCRIPTION_LIMIT)


def exclusion_reason(text: Column, min_links: int) -> Column:
    """Non-substantive or promotional text; NULL means the comment stays.

    `min_links` is the number of links from which a text counts as link solicitation.
    Exact duplicates are kept on purpose.
    """
    links = F.regexp_count(F.lower(text), F.lit(r"https?://|www\."))
    return (
        F.when(text.isNull() | (stripped(text) == ""), F.lit("EMPTY_TEXT"))
        .when(links >= min_links, F.lit("LINK_SOLICITATION"))
    )


def valence_band(valence: Column, negative_below: float, positive_above: float) -> Column:
    return (
        F.when(valence < negative_below, F.lit("NEGATIVE"))
        .when(valence > positive_above, F.lit("POSITIVE"))
        .when(valence.isNotNull(), F.lit("NEUTRAL"))
    )


def span_is_inside(start: Column, end: Column, text: Column) -> Column:
    return (start >= 0) & (end <= F.char_length(text)) & (start < end)
