"""Listings of source trees: what is looked at, what is opened, and how reads are packed."""

import contextlib
import io
import os
import re

import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

import codetally as ct
from codetally.sources import source_tree
from codetally.sources.dimensions import LICENSE_FILENAMES


def make(root, contents):
    for name, content in contents.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    make(root, {
        "a.py": b"x\n" * 10, "b.js": b"y\n" * 20, "noext": b"z" * 100, "dist/c.py": b"w" * 50,
        "src/d.py": b"# c\n", "License": b"MIT License", "src/LICENSE": b"ISC License", "deep/er/still/e.py": b"",
    })
    return str(root)


def roots_of(spark, *roots):
    return spark.createDataFrame([(f"r{i}", r) for i, r in enumerate(roots)], "repo string, root string")


def plan(frame):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


def test_listing_has_sizes_and_no_content(spark, tree):
    listing = ct.list_source_tree(spark, tree)
    assert listing.columns == ["repo", "path", "size", "place"]
    sizes = {r["path"][len(tree) + 1:]: r["size"] for r in listing.collect()}
    assert sizes == {
        "a.py": 20, "b.js": 40, "noext": 100, "dist/c.py": 50, "src/d.py": 4, "License": 11, "src/LICENSE": 11,
        "deep/er/still/e.py": 0,
    }
    assert ct.list_source_tree(spark, tree, prune=["dist"]).where("path like '%/dist/%'").count() == 0


def test_counting_opens_no_file(spark, tree):
    counted = ct.count_source_files(ct.list_source_tree(spark, tree))
    assert "MapInArrow" not in plan(counted) and "PythonMapInArrow" not in plan(counted)
    for directory, _, files in os.walk(tree):  # counting goes by the listing alone
        for name in files:
            os.remove(f"{directory}/{name}")
    assert counted.first()["files"] == 4


def test_only_counted_files_are_opened(spark, tree):
    listing = ct.list_eligible_trees(roots_of(spark, tree), ignore_langs=["js"])
    eligible = {r["path"]: r["size"] for r in listing.collect()}
    assert {os.path.basename(p) for p in eligible} == {"a.py", "d.py", "e.py"}
    files = ct.read_eligible_trees(roots_of(spark, tree), ignore_langs=["js"])
    for name in ("b.js", "noext", "dist/c.py", "License"):
        os.remove(f"{tree}/{name}")  # would fail the job if it were opened
    assert {r["path"]: len(r["content"]) for r in files.collect()} == eligible
    os.remove(f"{tree}/a.py")
    with pytest.raises(PythonException):
        files.collect()


def test_paths_may_be_changed_before_reading(spark, tree):
    listing = ct.list_source_tree(spark, tree).withColumn("path", F.substring("path", len(tree) + 2, 1000))
    read = {r["path"]: bytes(r["content"]) for r in ct.read_listed_files(listing.where("path like 'src/%'")).collect()}
    assert read == {"src/d.py": b"# c\n", "src/LICENSE": b"ISC License"}
    assert ct.read_listed_files(listing.where("false")).count() == 0


def walked(monkeypatch, root, rules):
    """Names found, and the directories that were listed."""
    listed, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda path: listed.append(os.fsdecode(path)) or scandir(path))
    given = pa.RecordBatch.from_pylist(
        [{"repo": "r", "root": root, "name": "", "raw": b"", "pending": True, "size": 0, "link": None}],
        source_tree.ENTRY_FIELDS,
    )
    found = [r for batch in source_tree._walk(iter([given]), rules) for r in batch.to_pylist()]
    monkeypatch.setattr(os, "scandir", scandir)
    return sorted(r["name"] for r in found), listed


def test_a_bounded_walk_lists_one_directory_a_level(monkeypatch, tree):
    names = set(LICENSE_FILENAMES)
    rules = source_tree.ListingRules([], "fail", 1, names, "new")
    assert walked(monkeypatch, tree, rules) == (["License"], [tree])
    found, listed = walked(monkeypatch, tree, rules._replace(max_depth=2))
    assert found == ["License", "src/LICENSE"]
    assert sorted(listed) == sorted([tree, f"{tree}/src", f"{tree}/dist", f"{tree}/deep"])
    found, listed = walked(monkeypatch, tree, rules._replace(max_depth=None, names=None))
    assert len(found) == 8 and len(listed) == 6


def test_bounded_listing_of_a_remote_root_and_of_a_file(spark, tree):
    paths = ct.list_source_trees(roots_of(spark, f"file://{tree}", f"{tree}/License"), max_depth=1, names=["LICENSE"])
    assert sorted(r["path"] for r in paths.collect()) == [f"{tree}/License", f"file://{tree}/License"]


def test_license_report_of_roots(spark, tree, tmp_path):
    make(tmp_path / "other", {"COPYING": b"ISC License", "sub/LICENSE": b"MIT License", "license/x": b""})
    (tmp_path / "bare").mkdir()
    roots = roots_of(spark, tree, str(tmp_path / "other") + "/", str(tmp_path / "bare"))
    report = ct.tree_license_report(roots)
    assert sorted((r["repo"], r["file"], r["license"]) for r in report.collect()) == [
        ("r0", "License", "MIT"), ("r1", "COPYING", "ISC"),
    ]
    whole = ct.read_source_trees(roots_of(spark, tree))
    columns = ["repo", "file", "license", "score", "line"]
    assert report.where("repo = 'r0'").select(columns).collect() == ct.license_report(whole, tree, ["repo"]).select(columns).collect()


def test_reads_are_packed_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(source_tree, "BYTES_PER_READ", 1 << 20)
    monkeypatch.setattr(source_tree, "FILES_PER_READ", 1 << 10)
    sizes = [900_000] * 12 + [10] * 20_000 + [500_000] * 6 + [3_000] * 2_000 + [900_000] * 12
    rows = spark.createDataFrame(
        [("r", f"f{i}", "/root", f"f{i}", None, size, None, None, None) for i, size in enumerate(sizes)],
        "repo string, path string, root string, name string, raw binary, size long, start long, "
        "first_line long, is_text boolean",
    ).repartition(5)
    packed, tasks = source_tree.packed_reads(rows)
    assert packed.count() == len(sizes)
    work = {r["split"]: r["n"] for r in packed.groupBy("split").agg(F.sum(F.col("size") + 1024).alias("n")).collect()}
    assert set(work) <= set(range(tasks)) and len(work) >= tasks - 1
    ordered = sorted(work.values())
    assert ordered[-1] <= 2 * ordered[len(ordered) // 2]
    read = packed.repartitionById(tasks, F.col("split")).withColumn("task", F.spark_partition_id())
    assert read.where("task <> split").count() == 0


def linked(root, names):
    for name in names:
        os.makedirs(f"{root}/{name}")
        with open(f"{root}/{name}/{name}.py", "w") as handle:
            handle.write("x\n")
    for name in names:
        for other in names:
            if other != name:
                os.symlink(f"{root}/{other}", f"{root}/{name}/to_{other}")


def test_many_directories_that_link_to_each_other(spark, tmp_path):
    root = str(tmp_path / "twelve")
    linked(root, "abcdefghijkl")
    paths = [r["path"] for r in ct.list_source_tree(spark, root).collect()]
    # Each in its place and by one link from every other one.
    assert len(paths) == len(set(paths)) == 12 + 12 * 11
    plain = [r["path"] for r in ct.list_source_tree(spark, root, links="none").collect()]
    assert sorted(plain) == [f"{root}/{c}/{c}.py" for c in "abcdefghijkl"]


def test_links_that_are_no_circles_are_all_followed(spark, tmp_path):
    make(tmp_path / "proj", {"real/x.py": b"x\n", "a/y.py": b"", "b/z.py": b""})
    make(tmp_path / "outside", {"o.py": b"", "sub/p.py": b""})
    for link in ("a/one", "b/two", "three"):
        os.symlink(tmp_path / "outside", tmp_path / "proj" / link)
    os.symlink(tmp_path / "proj" / "real", tmp_path / "outside" / "back")
    listing = ct.list_source_tree(spark, str(tmp_path / "proj"))
    found = sorted(re.sub(".*/proj/", "", r["path"]) for r in listing.collect())
    every = ct.list_source_tree(spark, str(tmp_path / "proj"), links="every")
    assert found == sorted(re.sub(".*/proj/", "", r["path"]) for r in every.collect())
    assert len(found) == 3 + 3 * 3


def test_wrong_options(spark, tree):
    with pytest.raises(ValueError, match="on_error"):
        ct.list_source_tree(spark, tree, on_error="never")
    with pytest.raises(ValueError, match="links"):
        ct.list_source_tree(spark, tree, links="some")
