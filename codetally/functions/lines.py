"""Line expressions: decode, split, trim, classify."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from codetally.sources.dimensions import LANGUAGES, WHITESPACE

MAX_SINGLE_MARKERS = max(len(single) for _, _, single, *_ in LANGUAGES)


def decoded(content: Column) -> Column:
    """The content as text, or NULL when any byte is not valid UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def without_final_empty(pieces: Column) -> Column:
    """Drop the empty piece that splitting leaves behind a final newline; it is
    also the only piece of an empty text, which has no lines."""
    ends_empty = F.element_at(pieces, -1) == ""
    return F.when(ends_empty, F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def _starts_visible(line: Column) -> Column:
    return (line >= "!") & (line < "\x7f")


# Left-trimming in two steps: the usual indentation of spaces and tabs, then any
# Unicode whitespace, whose costlier search is left to the few lines that do not
# start with a visible ASCII character by then. Apply the second step to the
# finished result of the first (its own projection or array), since it mentions
# its input more than once.
#
# Trailing whitespace decides neither blankness nor any marker test (no marker
# ends in whitespace) and stays.
LEFT_TRIM_STEPS: list[Callable[[Column], Column]] = [
    lambda line: F.ltrim(F.ltrim(F.ltrim(line), F.lit("\t"))),
    lambda line: F.when(_starts_visible(line), line).otherwise(
        F.ltrim(line, F.lit(WHITESPACE))
    ),
]


def marker_columns(markers: Column) -> list[Column]:
    """The single-line marker array as separate columns, NULL when absent."""
    return [F.get(markers, F.lit(i)) for i in range(MAX_SINGLE_MARKERS)]


def line_kind(trimmed: Column, single: list[Column], multi_start: Column) -> Column:
    """blank, then single, then multi, then code.

    Only the start of the line counts: block interiors are code, and an empty
    block opener is a prefix of every line. NULL markers (other languages)
    never match, which leaves blank and code.
    """
    is_single = reduce(or_, [F.startswith(trimmed, marker) for marker in single])
    return (
        F.when(trimmed == "", "blank")
        .when(is_single, "single")
        .when(F.startswith(trimmed, multi_start), "multi")
        .when(trimmed.isNotNull(), "code")
    )
