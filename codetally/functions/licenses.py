"""Licence text expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from codetally.sources.dimensions import (
    LICENSE_ANCHORS,
    LICENSE_DELETED_CHARS,
    WHITESPACE,
)

# A hit's weight and the score a licence must exceed. Both are
# doubles: one phrase of five scores 0.30000000000000004, which passes.
MATCH_WEIGHT = 1.5
MIN_SCORE = 0.3

_DELETED_CLASS = "[" + "".join("\\" + char for char in LICENSE_DELETED_CHARS) + "]"


def folded(text: Column) -> Column:
    """Punctuation deleted, lower case; whitespace runs and newlines are kept."""
    return F.lower(F.regexp_replace(text, _DELETED_CLASS, ""))


def trimmed_candidate(folded_text: Column) -> Column:
    """The normalised text, or NULL when it cannot contain any phrase."""
    has_anchor = reduce(or_, [folded_text.contains(anchor) for anchor in LICENSE_ANCHORS])
    return F.when(has_anchor, F.trim(folded_text, F.lit(WHITESPACE)))


def match_count(normalised: str, phrases: list[str]) -> Column:
    """How many phrases occur in the named column; 0 where it is NULL. A phrase
    that can match has no quotes, which normalisation deletes."""
    hits = " + ".join(f"int(contains({normalised}, '{phrase}'))" for phrase in phrases)
    return F.expr(f"coalesce({hits}, 0)")


def score(matches: Column, total: int) -> Column:
    share = matches.cast("double") / F.lit(float(total))
    return F.least(F.lit(1.0), share * F.lit(MATCH_WEIGHT))


def score_of(matches: str, total: str) -> Column:
    """:func:`score` of two columns."""
    share = F.col(matches).cast("double") / F.col(total).cast("double")
    return F.least(F.lit(1.0), share * F.lit(MATCH_WEIGHT))
