"""Line classification and statistics per file, language and directory.

Filters are the keyword arguments of :func:`eligible_files`; ``by`` lists extra
grouping columns of the files table, usually ``repo``.

A files table may have a ``first_line`` column: a large file is then several rows
cut after line ends, each with the number of its first line (see
:func:`read_source_trees`). Everything here counts such a file once. ``repo`` and
``path`` are then the key of a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetally.functions import lines, paths
from codetally.operators.languages import eligible_files
from codetally.sources import dimensions as dims
from codetally.sources.files_table import FIRST_LINE, first_rows, is_text_row, rows_to_count

SINGLE_MARKERS = [f"single_{i}" for i in range(lines.MAX_SINGLE_MARKERS)]
KINDS = ["blank", "code", "single", "multi"]
COUNTS = ["files", *KINDS]
FILE_KEY = ["repo", "path", "language", "is_other"]
LANGUAGE_KEY = ["language", "ordinal", "is_other"]


def _file_lines(files: DataFrame, keep: list[str], filters: dict) -> DataFrame:
    """One row per eligible file: ``keep``, its comment markers, and ``pieces``,
    its lines (NULL when the file is not valid UTF-8)."""
    # The markers are joined per file, before any line exists. The dimension has
    # 54 rows; other languages find no row and keep NULL markers.
    markers = F.broadcast(
        dims.languages(files.sparkSession).select("ordinal", "single", "multi_start")
    )
    single = [
        marker.alias(name)
        for marker, name in zip(lines.marker_columns(F.col("single")), SINGLE_MARKERS)
    ]
    split = F.split(lines.decoded(F.col("content")), "\n", -1)
    if FIRST_LINE in files.columns:
        files = rows_to_count(files)
        split = F.when(is_text_row(), split)
    return (
        eligible_files(files, **filters)
        .join(markers, "ordinal", "left")
        .select(*keep, *single, "multi_start", split.alias("pieces"))
        .withColumn("pieces", lines.without_final_empty(F.col("pieces")))
    )


def _kind(line: Column) -> Column:
    return lines.line_kind(line, list(map(F.col, SINGLE_MARKERS)), F.col("multi_start"))


def _line_rows(files: DataFrame, keep: list[str], filters: dict) -> DataFrame:
    """``keep, pos, kind`` per line; a file without lines keeps one row whose
    ``pos`` and ``kind`` are NULL. A cut file may have more lines than an INT counts."""
    offset = [FIRST_LINE] if FIRST_LINE in files.columns else []
    rows = _file_lines(files, [*keep, *offset], filters).select(
        "*", F.posexplode_outer("pieces").alias("pos", "line")
    )
    for step in lines.LEFT_TRIM_STEPS:
        rows = rows.withColumn("line", step(F.col("line")))
    pos = F.col("pos").cast("long")
    if offset:
        rows = rows.where(pos.isNotNull() | first_rows())
        pos = F.coalesce(FIRST_LINE, F.lit(0)) + pos
    return rows.select(*keep, pos.alias("pos"), _kind(F.col("line")).alias("kind"))


def classified_lines(files: DataFrame, **filters) -> DataFrame:
    """One row per line: ``repo, path, language, is_other, pos, kind``."""
    return _line_rows(files, FILE_KEY, filters).where(F.col("pos").isNotNull())


def file_stats(files: DataFrame, **filters) -> DataFrame:
    """Line counts per file.

    Counted inside the row, over the array of its lines: there is no shuffle on
    ``path`` however many files there are. A table with ``first_line`` is read once
    too; its count rows, without content, are then summed by file.
    """
    if FIRST_LINE not in files.columns:
        return _row_stats(files, FILE_KEY, F.lit(1), filters)
    is_first = first_rows().cast("int")
    return _sum_counts(_row_stats(files, FILE_KEY, is_first, filters), FILE_KEY)


def _row_stats(files: DataFrame, keys: list[str], counted: Column, filters: dict) -> DataFrame:
    offset = [FIRST_LINE] if FIRST_LINE in files.columns else []
    trimmed = reduce(F.transform, lines.LEFT_TRIM_STEPS, F.col("pieces"))
    kinds = F.transform(trimmed, _kind)

    def tally(kind: str) -> Column:
        others = F.size(F.array_remove("kinds", kind))
        return F.coalesce(F.size("kinds") - others, F.lit(0)).cast("long").alias(kind)

    return (
        _file_lines(files, [*keys, *offset], filters)
        .select(*keys, *offset, kinds.alias("kinds"))
        .select(*keys, counted.cast("long").alias("files"), *map(tally, KINDS))
    )


def _tally_lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    first_or_only = F.col("pos").isNull() | (F.col("pos") == 0)
    return rows.groupBy(*keys).agg(
        F.count_if(first_or_only).alias("files"),
        *[F.count_if(F.col("kind") == kind).alias(kind) for kind in KINDS],
    )


def language_stats(files: DataFrame, by=(), **filters) -> DataFrame:
    """Files and line counts per language (and ``by`` columns).

    Each task pre-aggregates its own lines, so the one shuffle carries at most a
    row per task and group, and a dominant language or repository costs nothing
    extra.
    """
    keys = [*by, *LANGUAGE_KEY]
    return _tally_lines(_line_rows(files, keys, filters), keys)


def subtree_stats(files: DataFrame, by=(), **filters) -> DataFrame:
    """``language_stats`` of every directory, subdirectories included.

    Lines are first reduced to one row per directory and language; only those
    rows are repeated for the parent directories and merged.
    """
    located = files.withColumn("directory", paths.dirname(F.col("path")))
    own = language_stats(located, [*by, "directory"], **filters)
    per_ancestor = own.withColumn(
        "directory", F.explode_outer(paths.ancestors(F.col("directory")))
    )
    return _sum_counts(per_ancestor, [*by, "directory", *LANGUAGE_KEY])


def combine_stats(*stats: DataFrame, by=()) -> DataFrame:
    """Merge statistics relations; ``by`` columns not listed are summed away."""
    keys = [*by, *LANGUAGE_KEY]
    parts = [relation.select(*keys, *COUNTS) for relation in stats]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return _sum_counts(merged, keys)


def _sum_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in COUNTS])
