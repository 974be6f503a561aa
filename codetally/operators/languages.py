"""Language detection and file selection; none of it reads file content."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetally.functions import matching, paths
from codetally.functions.matching import containing
from codetally.sources import dimensions as dims
from codetally.sources.files_table import FIRST_LINE, first_rows

def detect_language(files: DataFrame) -> DataFrame:
    """Add ``ext, language, ordinal, is_other`` to a table with a ``path``.

    Known extensions are looked up in the broadcast dimension (105 rows, fixed);
    any other extension is its own language, flagged ``is_other``. A file
    without an extension gets NULLs.
    """
    known = F.broadcast(dims.extensions(files.sparkSession))
    has_ext = F.col("ext") != ""
    return (
        files.withColumn("ext", paths.extension(F.col("path")))
        .join(known, "ext", "left")
        .withColumns({
            "language": F.coalesce(
                "known_language", F.when(has_ext, F.substring("ext", 2, 2**31 - 1))
            ),
            "ordinal": F.coalesce(
                "known_ordinal", F.when(has_ext, F.lit(dims.OTHER_ORDINAL))
            ),
            "is_other": F.when(has_ext, F.col("known_ordinal").isNull()),
        })
        .select(*files.columns, "ext", "language", "ordinal", "is_other")
    )


def ignored_language(aliases: list[str]) -> Column:
    """True for the languages named by the aliases.

    A name outside the alias table means the *other* language of that name, so
    ``kt`` or ``js,py`` ignore no known language.
    """
    other, language = F.col("is_other"), F.col("language")

    def named(alias: str) -> Column:
        if alias in dims.LANGUAGE_ALIASES:
            return ~other & (language == dims.LANGUAGE_ALIASES[alias])
        return other & (language == alias)

    return reduce(or_, map(named, aliases), F.lit(False))


def ignored_languages(spark: SparkSession, aliases: list[str] | DataFrame) -> DataFrame:
    """``language, is_other`` of the languages that a list or table of aliases names."""
    if not isinstance(aliases, DataFrame):
        aliases = spark.createDataFrame(pa.table({"alias": pa.array(aliases, pa.string())}))
    given = aliases.select(F.col(aliases.columns[0]).alias("alias")).where("alias IS NOT NULL").distinct()
    known = spark.createDataFrame(pa.table({
        "alias": list(dims.LANGUAGE_ALIASES), "known": list(dims.LANGUAGE_ALIASES.values()),
    }))
    return given.join(F.broadcast(known), "alias", "left").select(
        F.coalesce("known", "alias").alias("language"), F.col("known").isNull().alias("is_other")
    )


def without_ignored_paths(
    files: DataFrame, fragments: DataFrame, whole_components: bool = False
) -> DataFrame:
    """``files`` whose normalised path has none of the fragments of a table (first column).

    Candidates meet by an equi-join on pieces of paths; the paths found are anti-joined.
    """
    column = fragments.columns[0]
    name = "path__normalised"
    clean = paths.normalised(F.col("path"))
    if whole_components:
        clean, given = paths.in_slashes(clean), paths.in_slashes(paths.normalised(F.col(column)))
        fragments = fragments.select(given.alias(column)).where(F.col(column) != "//")
    marked = files.withColumn(name, clean)
    hits = containing(marked, name, fragments, column).select(F.col("text").alias(name)).distinct()
    nothing = fragments.where(F.col(column) == "").limit(1).count() > 0
    kept = marked.where(F.col(name).isNull()) if nothing else marked.join(hits, name, "left_anti")
    return kept.select(*files.columns)


def ignore_fragments(ignore_dirs=(), ignore_hidden: bool = False) -> list[str]:
    hidden = dims.HIDDEN_IGNORE_DIRS if ignore_hidden else []
    return [*dims.DEFAULT_IGNORE_DIRS, *ignore_dirs, *hidden]


def eligible_files(
    files: DataFrame,
    ignore_dirs=(),
    ignore_langs=(),
    ignore_hidden: bool = False,
    single_file: bool = False,
    whole_components: bool = False,
) -> DataFrame:
    """The files that are counted, with their language.

    ``single_file`` is for input that names files rather than directories: the
    path filter is skipped, the language filter is not. ``ignore_dirs`` and
    ``ignore_langs`` are lists of any length, or tables with one column. With
    ``whole_components`` ignored directories, the default ones too, are matched by
    whole path components (see :func:`paths.is_ignored`) instead of as substrings.
    """
    if not single_file:
        table = ignore_dirs if isinstance(ignore_dirs, DataFrame) else None
        fragments = ignore_fragments(() if table is not None else ignore_dirs, ignore_hidden)
        if not matching.fits_automaton(fragments):
            table = files.sparkSession.createDataFrame(pa.table({"fragment": list(dict.fromkeys(ignore_dirs))}))
            fragments = ignore_fragments((), ignore_hidden)
        files = files.where(~paths.is_ignored(F.col("path"), fragments, whole_components))
        if table is not None:
            files = without_ignored_paths(files, table, whole_components)
    located = detect_language(files).where(F.col("language").isNotNull())
    if not isinstance(ignore_langs, DataFrame) and len(ignore_langs) <= paths.MAX_LITERALS:
        return located.where(~ignored_language(list(ignore_langs)))
    # Spark broadcasts the names if they are few bytes and shuffles by name otherwise.
    names = ignored_languages(files.sparkSession, ignore_langs)
    return located.join(names, ["language", "is_other"], "left_anti").select(*located.columns)


def count_source_files(
    files: DataFrame, by=(), ignore_dirs=(), ignore_langs=(), ignore_hidden: bool = False
) -> DataFrame:
    """Number of eligible files, overall or per ``by`` columns. Unlike the line
    statistics, the count applies the path filter to single files too."""
    if FIRST_LINE in files.columns:
        files = files.where(first_rows())
    eligible = eligible_files(files, ignore_dirs, ignore_langs, ignore_hidden)
    return eligible.groupBy(*by).agg(F.count(F.lit(1)).alias("files"))
