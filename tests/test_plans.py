"""The physical plans: what is read, joined and shuffled."""

import contextlib
import glob
import io
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import codetally as ct
from workload import tables
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan(frame):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


def operators(frame):
    """Operator names in the plan tree."""
    tree = plan(frame).split("\n\n")[0]
    return re.findall(r"(\w[\w ]*?) \(\d+\)", tree)


def read_columns(frame):
    return [set(re.findall(r"(\w+):", found)) for found in re.findall(r"ReadSchema: struct<(.*)>", plan(frame))]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    location = str(tmp_path_factory.mktemp("files") / "table")
    ct.write_files_table(tables.source_files(spark, SF_DIR), location)
    return ct.read_files_table(spark, location)


def test_table_keeps_the_rows(spark, table):
    source = tables.source_files(spark, SF_DIR)
    assert sorted(table.select("repo", "path", "content").collect()) == sorted(source.collect())


def test_language_stats_shuffles_only_aggregates(table):
    names = operators(ct.language_stats(table))
    assert names.count("Exchange") == 1
    assert names.count("HashAggregate") == 2
    assert names.count("BroadcastHashJoin LeftOuter BuildRight") == 2
    assert names.index("Exchange") < names.index("Generate")
    assert read_columns(ct.language_stats(table)) == [{"path", "content", "first_line"}]
    assert read_columns(ct.language_stats(table.drop("first_line"))) == [{"path", "content"}]


def test_grouping_by_repo_is_the_same_single_shuffle(table):
    assert operators(ct.language_stats(table, by=["repo"])).count("Exchange") == 1


@pytest.mark.parametrize("make", [ct.file_stats, ct.classified_lines, ct.eligible_files, ct.detect_language])
def test_per_row_operators_do_not_shuffle(table, make):
    assert "Exchange" not in operators(make(table.drop("first_line")))


def test_file_stats_read_once_and_shuffle_counts(spark, table, tmp_path):
    frame = ct.file_stats(table)
    names = operators(frame)
    assert names.count("Exchange") == 1
    assert len(read_columns(frame)) == 1
    assert names.count("HashAggregate") == 2
    (tmp_path / "a.py").write_text("x\n")
    tree = ct.file_stats(ct.read_source_tree(spark, str(tmp_path)))
    assert operators(tree).count("MapInArrow") == 1


def test_storing_sorts_nothing_and_bounds_row_groups(spark, tmp_path):
    location = str(tmp_path / "table")
    rows = spark.range(1000).selectExpr(
        "'r' AS repo", "if(id % 7 = 0, 'LICENSE', 'a.py') AS path", "cast('x' AS binary) AS content"
    ).coalesce(1)
    execution = spark._jsparkSession.sharedState().statusStore()
    before = execution.executionsCount()
    ct.write_files_table(rows, location)
    written = execution.executionsList().apply(before).physicalPlanDescription()
    assert "Sort" not in written.split("\n\n")[0]
    groups = [
        pq.ParquetFile(file).metadata.row_group(i).num_rows
        for file in glob.glob(f"{location}/*/*.parquet")
        for i in range(pq.ParquetFile(file).metadata.num_row_groups)
    ]
    assert sum(groups) == 1000 and max(groups) <= 256


def test_licence_scoring_stays_in_the_row(spark):
    texts = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for frame in (ct.classify_license(texts.select("doc_id", "text")), ct.license_scores(texts.select("doc_id", "text"))):
        names = operators(frame)
        assert not [name for name in names if "Exchange" in name or "Join" in name]
        assert read_columns(frame) == [{"doc_id", "text"}]
        # The text is normalised in one place only.
        assert plan(frame).count("regexp_replace") == 1


def test_counting_and_detecting_read_no_content(table):
    assert read_columns(ct.count_source_files(table)) == [{"path", "first_line"}]
    bare = table.drop("first_line")
    assert read_columns(ct.count_source_files(bare, by=["repo"])) == [{"repo", "path"}]
    assert read_columns(ct.eligible_files(table).select("path", "language")) == [{"path"}]


def test_licence_reports_read_one_partition(table):
    for frame in (ct.license_files(table, "r"), ct.license_report(table, F.col("repo"), by=["repo"])):
        assert re.search(r"PartitionFilters: \[.*license_name", plan(frame))


# Long lists of strings are matched by an automaton in Python, tables joined by key.
MATCHED = {"eligible_files_many_fragments", "license_scores_table"}
KEYED = {"eligible_files_fragment_table", "ignore_lang_table", "lines_with_blocks_cut", "summary_report_empty"}


# The tree scan is Python by nature; everything else is built-in expressions.
@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("source_tree")])
def test_no_query_leaves_the_engine(spark, name):
    names = " ".join(operators(QUERIES[name](spark, SF_DIR)))
    avoided = {"Python", "ArrowEval", "InArrow", "CartesianProduct", "NestedLoop", "SortMergeJoin"}
    avoided -= {"Python", "ArrowEval"} if name in MATCHED else {"SortMergeJoin"} if name in KEYED else set()
    assert not [operator for operator in avoided if operator in names]
