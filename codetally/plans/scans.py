"""Scans of source trees that open only the files that are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame

from codetally.operators.languages import eligible_files, ignore_fragments
from codetally.sources.source_tree import list_source_trees, read_listed_files


def list_eligible_trees(
    roots: DataFrame,
    ignore_dirs=(),
    ignore_langs=(),
    ignore_hidden: bool = False,
    on_error: str = "fail",
) -> DataFrame:
    """The counted files of checkouts, ``(repo, root)``, with their language and size.

    Ignored directories are not listed, and no file is opened: counting the result
    reads directories only.
    """
    listing = list_source_trees(roots, ignore_fragments(ignore_dirs, ignore_hidden), on_error)
    return eligible_files(listing, ignore_dirs, ignore_langs, ignore_hidden)


def read_eligible_trees(
    roots: DataFrame,
    ignore_dirs=(),
    ignore_langs=(),
    ignore_hidden: bool = False,
    on_error: str = "fail",
) -> DataFrame:
    """``repo, path, content, first_line`` of the counted files; no other file is opened.

    Give the statistics the same filters, or none beyond the path filter of their
    defaults: what they would leave out is not there.
    """
    listing = list_eligible_trees(roots, ignore_dirs, ignore_langs, ignore_hidden, on_error)
    return read_listed_files(listing, on_error)
