"""Line statistics per language and licence detection over tables of files."""

from codetally.operators.blocks import lines_with_blocks, stats_with_blocks
from codetally.operators.languages import (
    count_source_files,
    detect_language,
    eligible_files,
    ignore_fragments,
)
from codetally.operators.large_rows import cut_large_rows
from codetally.operators.licenses import (
    classify_license,
    license_files,
    license_scores,
    license_scores_of,
)
from codetally.operators.stats import (
    classified_lines,
    combine_stats,
    file_stats,
    language_stats,
    subtree_stats,
)
from codetally.plans.reports import (
    license_report,
    summary_lines,
    summary_report,
    tree_license_report,
)
from codetally.plans.scans import list_eligible_trees, read_eligible_trees
from codetally.sources.files_table import read_files_table, write_files_table
from codetally.sources.source_tree import (
    list_source_tree,
    list_source_trees,
    read_listed_files,
    read_source_tree,
    read_source_trees,
)

__all__ = [
    "classified_lines",
    "classify_license",
    "combine_stats",
    "count_source_files",
    "cut_large_rows",
    "detect_language",
    "eligible_files",
    "file_stats",
    "ignore_fragments",
    "language_stats",
    "license_files",
    "license_report",
    "license_scores",
    "license_scores_of",
    "lines_with_blocks",
    "list_eligible_trees",
    "list_source_tree",
    "list_source_trees",
    "read_eligible_trees",
    "read_files_table",
    "read_listed_files",
    "read_source_tree",
    "read_source_trees",
    "stats_with_blocks",
    "subtree_stats",
    "summary_lines",
    "summary_report",
    "tree_license_report",
    "write_files_table",
]
