"""The two reports: the language summary and the licence list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetally.functions import lines
from codetally.functions.paths import basename
from codetally.operators.licenses import classify_license, license_files
from codetally.operators.stats import COUNTS
from codetally.sources.dimensions import LICENSE_FILENAMES
from codetally.sources.source_tree import list_source_trees, read_listed_files

KNOWN_SECTION, OTHER_SECTION, TOTAL_SECTION = 0, 1, 2
NAME_WIDTH = 12


def summary_rows(language_stats: DataFrame, by=()) -> DataFrame:
    """The summary, unordered: ``by..., section, ordinal, language, files, blank,
    comment, code``.

    Known languages keep their row, all others are pooled into "Other", and
    "Total" covers both; one pass over the grouping sets computes the three.
    "Other" and "Total" report one file more than they hold: that is the
    reference result, and it is added to the raw sums so that it does not add up.
    """
    bucketed = language_stats.select(
        *by,
        F.when(F.col("is_other"), OTHER_SECTION).otherwise(KNOWN_SECTION).alias("bucket"),
        "ordinal",
        F.when(F.col("is_other"), "Other")
        .otherwise(F.substring("language", 1, NAME_WIDTH))
        .alias("name"),
        *COUNTS,
    )
    keys = [F.col(name) for name in by]
    entry = [F.col("bucket"), F.col("ordinal"), F.col("name")]
    is_total = F.col("is_total") == 1
    section = F.when(is_total, TOTAL_SECTION).otherwise(F.col("bucket"))
    return (
        bucketed.groupingSets([keys + entry, keys], *keys, *entry)
        .agg(
            F.grouping("name").alias("is_total"),
            *[F.sum(name).alias(name) for name in COUNTS],
        )
        .select(
            *by,
            section.alias("section"),
            "ordinal",
            F.when(is_total, "Total").otherwise(F.col("name")).alias("language"),
            (F.col("files") + F.when(section == KNOWN_SECTION, 0).otherwise(1)).alias("files"),
            "blank",
            (F.col("single") + F.col("multi")).alias("comment"),
            "code",
        )
    )


def summary_report(language_stats: DataFrame, by=()) -> DataFrame:
    """The summary in report order: known languages in table order, Other, Total.
    Empty statistics give an empty report."""
    return (
        summary_rows(language_stats, by)
        .orderBy(*by, "section", "ordinal")
        .select(*by, "language", "files", "blank", "comment", "code")
    )


def summary_lines(language_stats: DataFrame, by=()) -> DataFrame:
    """The summary as fixed-width text lines, in report order."""
    return summary_report(language_stats, by).select(
        *by,
        F.format_string(
            "%-12s %7d %8d %9d %8d", "language", "files", "blank", "comment", "code"
        ).alias("line"),
    )


def percent(confidence: Column) -> Column:
    return F.format_string("%.0f%%", confidence * 100)


def license_report(files: DataFrame, root: str | Column = "", by=()) -> DataFrame:
    """One row per licence file in the root directory, classified.

    Content that is not valid UTF-8 is reported as unknown.
    """
    return _license_rows(license_files(files, root).select(*by, "file", "content"), by)


def tree_license_report(roots: DataFrame, on_error: str = "fail") -> DataFrame:
    """:func:`license_report` of checkouts, given as a table ``(repo, root)``, by ``repo``.

    One directory a root is listed and nothing but its licence files is opened.
    """
    listing = list_source_trees(roots, on_error=on_error, max_depth=1, names=LICENSE_FILENAMES)
    files = read_listed_files(license_files(listing, F.col("place.root")), on_error)
    return _license_rows(files.select("repo", basename(F.col("path")).alias("file"), "content"), ["repo"])


def _license_rows(files: DataFrame, by) -> DataFrame:
    texts = files.select(*by, "file", lines.decoded(F.col("content")).alias("text"))
    return classify_license(texts).select(
        *by,
        "file",
        "license",
        "confidence",
        "score",
        percent(F.col("confidence")).alias("confidence_pct"),
        F.format_string(
            "%-12s (%.0f%% confidence) in %s", "license", F.col("confidence") * 100, "file"
        ).alias("line"),
    )
