"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import codetally as ct
from codetally.sources.dimensions import LANGUAGE_ALIASES, fingerprints
from workload import tables as t

Query = Callable[[SparkSession, str], DataFrame]

# Parameters shared with the SQL side.
IGNORE_LANGS = ["py", "md", "kt", "bash", "js,py"]
IGNORE_DIRS = ["a/b", "src1/"]
ALL_ALIASES = list(LANGUAGE_ALIASES)
MANY_FRAGMENTS = [f"/f{i}7." for i in range(1_000)]

LOCATED = ["repo", "path", "ext", "language", "ordinal", "is_other"]


def language_detect(spark, sf_dir):
    return ct.detect_language(t.source_paths(spark, sf_dir)).select(*LOCATED)


def eligible_files(spark, sf_dir):
    return ct.eligible_files(t.source_paths(spark, sf_dir)).select(*LOCATED)


def eligible_files_hidden(spark, sf_dir):
    return ct.eligible_files(
        t.source_paths(spark, sf_dir), ignore_dirs=IGNORE_DIRS, ignore_hidden=True
    ).select(*LOCATED)


def ignore_lang_alias(spark, sf_dir):
    return ct.eligible_files(
        t.source_paths(spark, sf_dir), ignore_langs=IGNORE_LANGS
    ).select(*LOCATED)


def ignore_lang_all_aliases(spark, sf_dir):
    return ct.eligible_files(
        t.source_paths(spark, sf_dir), ignore_langs=ALL_ALIASES
    ).select(*LOCATED)


def eligible_files_components(spark, sf_dir):
    """Ignored directories by whole path components."""
    return ct.eligible_files(
        t.source_paths(spark, sf_dir), ignore_dirs=[*IGNORE_DIRS, "src"], ignore_hidden=True, whole_components=True
    ).select(*LOCATED)


def eligible_files_many_fragments(spark, sf_dir):
    return ct.eligible_files(
        t.source_paths(spark, sf_dir), ignore_dirs=[*IGNORE_DIRS, *MANY_FRAGMENTS]
    ).select(*LOCATED)


def eligible_files_fragment_table(spark, sf_dir):
    """Fragments are a table: a Python file of each document."""
    ids = t.table(spark, sf_dir, "documents")
    fragments = ids.select(F.concat(F.lit("/f"), "doc_id", F.lit(".py")).alias("fragment"))
    return ct.eligible_files(t.source_paths(spark, sf_dir), ignore_dirs=fragments).select(*LOCATED)


def ignore_lang_table(spark, sf_dir):
    """Ignored languages are a table: aliases beside words of all documents."""
    words = t.table(spark, sf_dir, "documents").select(F.split_part("text", F.lit(" "), F.lit(1)).alias("alias"))
    aliases = spark.createDataFrame([(name,) for name in IGNORE_LANGS], "alias string")
    return ct.eligible_files(
        t.source_paths(spark, sf_dir), ignore_langs=words.unionByName(aliases)
    ).select(*LOCATED)


def count_source_files_none(spark, sf_dir):
    """An empty fragment ignores every file."""
    return ct.count_source_files(t.source_paths(spark, sf_dir), ignore_dirs=[""])


def count_source_files(spark, sf_dir):
    return ct.count_source_files(t.source_paths(spark, sf_dir))


def classified_lines(spark, sf_dir):
    return ct.classified_lines(t.source_files(spark, sf_dir))


def lines_with_blocks(spark, sf_dir):
    """Line kinds with block comments followed from line to line."""
    return ct.lines_with_blocks(t.source_files(spark, sf_dir))


def lines_with_blocks_cut(spark, sf_dir):
    """The same for files in rows of about a thousand bytes."""
    return ct.lines_with_blocks(ct.cut_large_rows(t.source_files(spark, sf_dir), row_bytes=1_000))


def file_stats(spark, sf_dir):
    return ct.file_stats(t.source_files(spark, sf_dir))


def language_stats(spark, sf_dir):
    return ct.language_stats(t.source_files(spark, sf_dir))


def language_stats_by_repo(spark, sf_dir):
    return ct.language_stats(t.source_files(spark, sf_dir), by=["repo"])


def language_stats_single_file(spark, sf_dir):
    return ct.language_stats(t.source_files(spark, sf_dir), single_file=True)


def language_stats_pages(spark, sf_dir):
    return ct.language_stats(t.page_files(spark, sf_dir))


def subtree_stats(spark, sf_dir):
    return ct.subtree_stats(t.source_files(spark, sf_dir))


def combine_stats(spark, sf_dir):
    return ct.combine_stats(
        ct.language_stats(t.source_files(spark, sf_dir), by=["repo"]),
        ct.language_stats(t.page_files(spark, sf_dir)),
    )


def summary_report(spark, sf_dir):
    return ct.summary_report(language_stats(spark, sf_dir))


def summary_report_by_repo(spark, sf_dir):
    return ct.summary_report(language_stats_by_repo(spark, sf_dir), by=["repo"])


def summary_report_positions(spark, sf_dir):
    """The report with the place of each row; one partition numbers from zero."""
    report = summary_report(spark, sf_dir).coalesce(1)
    return report.withColumn("position", F.monotonically_increasing_id())


def summary_lines(spark, sf_dir):
    return ct.summary_lines(language_stats(spark, sf_dir))


def license_files(spark, sf_dir):
    files = t.license_repos(spark, sf_dir)
    return ct.license_files(files, root=F.col("repo")).select("repo", "path", "file")


def license_scores(spark, sf_dir):
    return ct.license_scores(t.license_texts(spark, sf_dir))


def license_scores_documents(spark, sf_dir):
    documents = t.table(spark, sf_dir, "documents").select("doc_id", "text")
    return ct.license_scores(t.spread(documents))


def license_scores_table(spark, sf_dir):
    """Scores for a table of fingerprints, where they match."""
    return ct.license_scores_of(t.license_texts(spark, sf_dir), fingerprints(spark))


def classify_license(spark, sf_dir):
    return ct.classify_license(t.license_texts(spark, sf_dir))


def classify_license_documents(spark, sf_dir):
    documents = t.table(spark, sf_dir, "documents").select("doc_id", "text")
    return ct.classify_license(t.spread(documents))


def license_report(spark, sf_dir):
    return ct.license_report(t.license_repos(spark, sf_dir), root=F.col("repo"), by=["repo"])


def _inside(files, root):
    return files.withColumn("path", F.substring("path", len(root) + 2, 2**31 - 1))


def source_tree_stats(spark, sf_dir):
    """The source files written out as a real tree and scanned from there."""
    root = t.write_tree(t.source_files(spark, sf_dir))
    return ct.language_stats(_inside(ct.read_source_tree(spark, root), root))


def source_tree_pruned(spark, sf_dir):
    """Ignored directories are not even listed."""
    root = t.write_tree(t.source_files(spark, sf_dir))
    fragments = ct.ignore_fragments(IGNORE_DIRS, ignore_hidden=True)
    files = _inside(ct.read_source_tree(spark, root, prune=fragments), root)
    return ct.language_stats(files, ignore_dirs=IGNORE_DIRS, ignore_hidden=True)


def source_tree_single_file(spark, sf_dir):
    """Every file is the root of a scan of its own."""
    root = t.write_tree(t.source_files(spark, sf_dir))
    roots = t.source_paths(spark, sf_dir).select(
        "repo", F.concat(F.lit(f"{root}/"), "path").alias("root")
    )
    return ct.language_stats(ct.read_source_trees(roots), single_file=True)


def source_tree_large(spark, sf_dir):
    """Files that are cut when read, some of them not text."""
    root = t.write_tree(t.large_files(spark, sf_dir))
    return ct.file_stats(_inside(ct.read_source_tree(spark, root, repo="large"), root))


def source_tree_count(spark, sf_dir):
    """Files counted by language from the directories alone."""
    root = t.write_tree(t.source_files(spark, sf_dir))
    listing = _inside(ct.list_source_tree(spark, root, prune=ct.ignore_fragments()), root)
    counted = listing.withColumn("repo", F.split_part("path", F.lit("/"), F.lit(2)))
    return ct.count_source_files(counted, by=["repo"])


def source_tree_eligible(spark, sf_dir):
    """Statistics of a tree of which only counted files are opened."""
    root = t.write_tree(t.source_files(spark, sf_dir))
    roots = t.source_paths(spark, sf_dir).select("repo").distinct().select(
        "repo", F.concat(F.lit(f"{root}/r/"), "repo").alias("root")
    )
    files = ct.read_eligible_trees(roots, IGNORE_DIRS, IGNORE_LANGS, ignore_hidden=True)
    return ct.language_stats(
        files, by=["repo"], ignore_dirs=IGNORE_DIRS, ignore_langs=IGNORE_LANGS, ignore_hidden=True
    )


def source_tree_root_licenses(spark, sf_dir):
    """Licences of repositories, each listed one level deep."""
    root = t.write_tree(t.license_repos(spark, sf_dir))
    roots = t.license_repos(spark, sf_dir).select("repo").distinct().select(
        "repo", F.concat(F.lit(f"{root}/"), "repo").alias("root")
    )
    return ct.tree_license_report(roots)


def summary_report_empty(spark, sf_dir):
    """A report of nothing, beside the number of files that were looked at."""
    files = t.source_files(spark, sf_dir)
    report = ct.summary_report(ct.language_stats(files, by=["repo"], ignore_dirs=[""]), by=["repo"])
    looked_at = files.groupBy("repo").agg(F.count("*").alias("looked_at"))
    return looked_at.join(report, "repo", "left")


def source_tree_license_report(spark, sf_dir):
    """Licences of scanned repositories, some with a directory named ``license``."""
    root = t.write_tree(t.license_repos(spark, sf_dir))
    files = _inside(ct.read_source_tree(spark, root), root)
    located = files.withColumn("repo", F.regexp_extract("path", "^(p/[^/]*)/", 1))
    return ct.license_report(located, root=F.col("repo"), by=["repo"])


def large_rows_file_stats(spark, sf_dir):
    """Statistics of files whose contents are cut into rows of about a thousand bytes."""
    return ct.file_stats(ct.cut_large_rows(t.source_files(spark, sf_dir), row_bytes=1_000))


def large_rows_lines(spark, sf_dir):
    return ct.classified_lines(ct.cut_large_rows(t.source_files(spark, sf_dir), row_bytes=1_000))


def files_table_file_stats(spark, sf_dir):
    location = t.new_folder(spark, "table")
    ct.write_files_table(t.source_files(spark, sf_dir), location)
    return ct.file_stats(ct.read_files_table(spark, location))


def files_table_stats(spark, sf_dir):
    """The source files stored as a files table and read back."""
    location = t.new_folder(spark, "table")
    ct.write_files_table(t.source_files(spark, sf_dir), location)
    return ct.language_stats(ct.read_files_table(spark, location), by=["repo"])


def files_table_license_report(spark, sf_dir):
    location = t.new_folder(spark, "table")
    ct.write_files_table(t.license_repos(spark, sf_dir), location)
    files = ct.read_files_table(spark, location)
    return ct.license_report(files, root=F.col("repo"), by=["repo"])


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in [
        language_detect,
        eligible_files,
        eligible_files_hidden,
        ignore_lang_alias,
        ignore_lang_all_aliases,
        eligible_files_components,
        eligible_files_many_fragments,
        eligible_files_fragment_table,
        ignore_lang_table,
        count_source_files,
        count_source_files_none,
        classified_lines,
        lines_with_blocks,
        lines_with_blocks_cut,
        file_stats,
        language_stats,
        language_stats_by_repo,
        language_stats_single_file,
        language_stats_pages,
        subtree_stats,
        combine_stats,
        summary_report,
        summary_report_by_repo,
        summary_report_positions,
        summary_lines,
        summary_report_empty,
        license_files,
        license_scores,
        license_scores_documents,
        license_scores_table,
        classify_license,
        classify_license_documents,
        license_report,
        source_tree_stats,
        source_tree_pruned,
        source_tree_single_file,
        source_tree_large,
        source_tree_license_report,
        source_tree_count,
        source_tree_eligible,
        source_tree_root_licenses,
        large_rows_file_stats,
        large_rows_lines,
        files_table_stats,
        files_table_file_stats,
        files_table_license_report,
    ]
}
