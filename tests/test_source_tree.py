"""The file system scan."""

import io
import os

import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

import codetally as ct
from codetally.sources import source_tree


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    contents = {
        "__init__.py": b"",
        ".gitignore": b"a\n",
        "src/deep/er/x.py": b"# c\nx\n",
        "src/bad.py": b"\xed\xa0\x80\n",
        "src/with space é.js": b"// c\n",
        "data.gz": b"\x1f\x8b\x00\x01",
        "dist/y.py": b"y\n",
        ".git/config": b"z\n",
        "Makefile": b"all:\n",
    }
    for name, content in contents.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    (root / "empty").mkdir()
    return str(root), contents


STATS = [ct.language_stats, ct.file_stats, ct.classified_lines, ct.count_source_files, ct.subtree_stats]


def as_dict(files, root):
    return {row["path"][len(root) + 1:]: bytes(row["content"]) for row in files.collect()}


def test_every_file_is_a_row(spark, tree):
    root, contents = tree
    files = ct.read_source_tree(spark, root, repo="proj")
    assert files.columns == ["repo", "path", "content", "first_line"]
    assert as_dict(files, root) == contents
    assert {row["repo"] for row in files.collect()} == {"proj"}


def test_pruning_changes_no_statistics(spark, tree):
    root, _ = tree
    pruned = ct.read_source_tree(spark, root, prune=ct.ignore_fragments(ignore_hidden=True))
    assert not {"dist/y.py", ".git/config"} & as_dict(pruned, root).keys()
    whole = ct.read_source_tree(spark, root)
    assert sorted(ct.language_stats(pruned, ignore_hidden=True).collect()) == sorted(
        ct.language_stats(whole, ignore_hidden=True).collect()
    )


def test_listing_in_many_rounds_finds_the_same(spark, tree, monkeypatch):
    root, contents = tree
    monkeypatch.setattr(source_tree, "ENTRIES_PER_WALK", 1)
    assert as_dict(ct.read_source_tree(spark, root), root) == contents


def test_small_batches_hold_the_same(spark, tree, monkeypatch):
    root, contents = tree
    monkeypatch.setattr(source_tree, "BYTES_PER_BATCH", 1)
    assert as_dict(ct.read_source_tree(spark, root), root) == contents


LARGE = b"# one\n\nx = 1\n  \"\"\" doc\n" * 9 + b"last"


@pytest.fixture
def large_tree(tree):
    root, contents = tree
    extra = {"large.py": LARGE, "large.bin": b"ok\n" * 20 + b"\xff", "LICENSE": b"MIT License, all of it"}
    for name, content in extra.items():
        with open(f"{root}/{name}", "wb") as handle:
            handle.write(content)
    return root, {**contents, **extra}


@pytest.mark.parametrize("part, span", [(5, 7), (5, 1 << 20), (16, 40), (40, 64)])
def test_large_files_are_cut_at_line_ends(spark, large_tree, monkeypatch, part, span):
    root, contents = large_tree
    whole = ct.read_source_tree(spark, root)
    assert whole.columns == ["repo", "path", "content", "first_line"]
    assert whole.where("first_line is not null").count() == 0
    expected = {make: sorted(make(whole).collect()) for make in STATS}

    monkeypatch.setattr(source_tree, "BYTES_PER_PART", part)
    monkeypatch.setattr(source_tree, "BYTES_PER_RANGE", span)
    cut = ct.read_source_tree(spark, root)
    rows = sorted(
        (row["first_line"], bytes(row["content"]))
        for row in cut.where("path like '%/large.py'").collect()
    )
    assert len(rows) > 1
    assert b"".join(content for _, content in rows) == LARGE
    for first_line, content in rows:
        before = b"".join(c for line, c in rows if line < first_line)
        assert first_line == before.count(b"\n")
        assert content.endswith(b"\n") or content.endswith(b"last")
    parts = cut.where("path like '%/large.bin'").orderBy(F.desc("first_line")).collect()
    assert b"".join(bytes(row["content"]) for row in parts) == contents["large.bin"]
    places = [-1 - row["first_line"] for row in parts]
    assert places == [sum(len(row["content"]) for row in parts[:i]) for i in range(len(parts))]
    for make in STATS:
        assert sorted(make(cut).collect()) == expected[make]
    assert ct.license_report(cut, root).first()["license"] == "MIT"


def test_cut_files_survive_the_stored_table(spark, large_tree, monkeypatch, tmp_path):
    root, _ = large_tree
    whole = ct.read_source_tree(spark, root)
    monkeypatch.setattr(source_tree, "BYTES_PER_PART", 16)
    ct.write_files_table(ct.read_source_tree(spark, root), str(tmp_path / "table"))
    stored = ct.read_files_table(spark, str(tmp_path / "table"))
    for make in STATS:
        assert sorted(make(stored).collect()) == sorted(make(whole).collect())


def test_a_line_longer_than_a_row_fails(spark, large_tree, monkeypatch):
    root, _ = large_tree
    with open(f"{root}/minified.js", "wb") as handle:
        handle.write(b"x" * 100)
    monkeypatch.setattr(source_tree, "BYTES_PER_PART", 16)
    monkeypatch.setattr(source_tree, "MAX_ROW_BYTES", 64)
    with pytest.raises(PythonException, match="minified.js: a line does not fit"):
        ct.read_source_tree(spark, root).collect()


def test_single_file(spark, tree):
    root, _ = tree
    files = ct.read_source_tree(spark, f"{root}/dist/y.py")
    assert [row["path"] for row in files.collect()] == [f"{root}/dist/y.py"]
    assert ct.language_stats(files, single_file=True).first()["code"] == 1
    assert ct.license_report(files, f"{root}/dist/y.py").count() == 0


def test_uri_root(spark, tree):
    root, contents = tree
    assert as_dict(ct.read_source_tree(spark, f"file://{root}"), f"file://{root}") == contents


def test_many_roots(spark, tree):
    root, _ = tree
    roots = spark.createDataFrame([("a", f"{root}/src"), ("b", f"{root}/dist")], "repo string, root string")
    files = ct.read_source_trees(roots)
    assert sorted((row["repo"], os.path.basename(row["path"])) for row in files.collect()) == [
        ("a", "bad.py"), ("a", "with space é.js"), ("a", "x.py"), ("b", "y.py"),
    ]


def test_links_are_followed_but_not_in_circles(spark, tree):
    root, contents = tree
    os.symlink(root, f"{root}/src/loop")
    os.symlink(f"{root}/nowhere", f"{root}/broken.py")
    os.symlink(f"{root}/dist/y.py", f"{root}/linked.py")
    os.symlink(f"{root}/src/deep", f"{root}/shortcut")
    expected = {**contents, "linked.py": b"y\n", "shortcut/er/x.py": b"# c\nx\n"}
    assert as_dict(ct.read_source_tree(spark, root), root) == expected


def linked(root, names):
    """Directories with a file each, every one with links to all others."""
    for name in names:
        os.makedirs(f"{root}/{name}")
        with open(f"{root}/{name}/{name}.py", "w") as handle:
            handle.write("x\n")
    for name in names:
        for other in names:
            if other != name:
                os.symlink(f"{root}/{other}", f"{root}/{name}/to_{other}")


def test_directories_that_link_to_each_other_end(spark, tmp_path):
    root = str(tmp_path / "two")
    linked(root, "ab")
    assert as_dict(ct.read_source_tree(spark, root), root).keys() == {
        "a/a.py", "a/to_b/b.py", "b/b.py", "b/to_a/a.py",
    }
    root = str(tmp_path / "three")
    linked(root, "abc")
    paths = [row["path"] for row in ct.list_source_tree(spark, root, links="every").collect()]
    # Every way of one, two or three different directories, once.
    assert len(paths) == len(set(paths)) == 3 + 6 + 6
    paths = [row["path"] for row in ct.read_source_tree(spark, root).collect()]
    # No directory is entered again that fewer links have led to.
    assert len(paths) == len(set(paths)) == 3 + 6


def test_rounds_follow_the_depth(spark, tmp_path, monkeypatch):
    for i in range(300):
        os.makedirs(tmp_path / f"d{i}" / "e")
        (tmp_path / f"d{i}" / "e" / "f.py").write_text("x\n")
    monkeypatch.setattr(source_tree, "ENTRIES_PER_WALK", 10)
    monkeypatch.setattr(source_tree, "DIRECTORIES_PER_TASK", 20)
    rounds = []
    original = type(spark.range(1)).checkpoint
    monkeypatch.setattr(
        type(spark.range(1)), "checkpoint", lambda self, *a: rounds.append(1) or original(self, *a)
    )
    listing = ct.list_source_tree(spark, str(tmp_path))
    assert len(rounds) <= 4
    files = ct.read_listed_files(listing)
    assert files.count() == 300
    assert files.rdd.getNumPartitions() <= source_tree.READS_PER_CORE * 8


def test_names_that_are_not_utf8(spark, tmp_path):
    root = os.fsencode(str(tmp_path))
    os.mkdir(root + b"/d\xff")
    with open(root + b"/d\xff/\xfe.py", "wb") as handle:
        handle.write(b"x\n")
    files = ct.read_source_tree(spark, str(tmp_path))
    assert as_dict(files, str(tmp_path)) == {r"d\xff/\xfe.py": b"x\n"}
    assert ct.language_stats(files).first()["code"] == 1


def test_a_root_uri_with_a_space(spark, tmp_path):
    root = tmp_path / "with space"
    root.mkdir()
    (root / "a.py").write_text("x\n")
    for uri in (f"file://{root}", f"file://{root}".replace(" ", "%20")):
        assert as_dict(ct.read_source_tree(spark, uri), uri) == {"a.py": b"x\n"}


def test_an_unreadable_directory(tree, monkeypatch):
    root, _ = tree
    scandir = os.scandir

    def refuse(path):
        if path.endswith(b"/src"):
            raise PermissionError(path)
        return scandir(path)

    monkeypatch.setattr(os, "scandir", refuse)

    def names(on_error):
        given = pa.RecordBatch.from_pylist(
            [{"repo": "r", "root": root, "name": "", "raw": b"", "pending": True, "size": 0, "link": None}],
            source_tree.ENTRY_FIELDS,
        )
        batches = source_tree._walk(iter([given]), source_tree.ListingRules([], on_error, None, None, "new"))
        return {name for batch in batches for name in batch["name"].to_pylist()}

    with pytest.raises(PermissionError):
        names("fail")
    assert "dist/y.py" in names("skip") and "src/bad.py" not in names("skip")
    assert names("skip") == names("null")


def test_missing_root_fails(spark, tmp_path):
    with pytest.raises(PythonException, match="path does not exist"):
        ct.read_source_tree(spark, str(tmp_path / "none")).collect()


def test_unreadable_file(spark, tree, monkeypatch):
    root, contents = tree
    roots = ct.read_source_tree(spark, root)
    os.remove(f"{root}/Makefile")  # gone between listing and reading
    with pytest.raises(PythonException):
        roots.collect()


def test_unreadable_file_can_be_skipped(spark, tree):
    root, contents = tree
    files = ct.read_source_tree(spark, root, on_error="skip")
    os.remove(f"{root}/Makefile")
    del contents["Makefile"]
    assert as_dict(files, root) == contents


def test_unreadable_file_can_be_a_row(spark, large_tree, monkeypatch):
    root, contents = large_tree
    monkeypatch.setattr(source_tree, "BYTES_PER_PART", 16)
    before = ct.read_source_tree(spark, root, on_error="null")
    os.remove(f"{root}/Makefile")
    os.remove(f"{root}/large.py")
    gone = before.where("content is null").select("path").distinct().collect()
    assert {row["path"] for row in gone} == {f"{root}/Makefile", f"{root}/large.py"}
    row = ct.file_stats(before).where("path like '%/large.py'").first()
    assert (row["files"], row["code"]) == (1, 0)
    skipped = ct.read_source_tree(spark, root, on_error="skip")
    assert skipped.where("content is null").count() == 0


def test_what_does_not_fit_in_a_row(spark, large_tree, monkeypatch):
    root, _ = large_tree
    with open(f"{root}/minified.js", "wb") as handle:
        handle.write(b"// a\n" + b"x" * 100 + b"\n// b\nc\n")
    with open(f"{root}/COPYING", "wb") as handle:
        handle.write(b"y" * 100)
    monkeypatch.setattr(source_tree, "BYTES_PER_PART", 16)
    monkeypatch.setattr(source_tree, "MAX_ROW_BYTES", 64)
    with pytest.raises(PythonException, match="COPYING: 100 bytes|minified.js: a line"):
        ct.read_source_tree(spark, root).collect()
    rows = ct.read_source_tree(spark, root, on_error="null")
    lost = rows.where("content is null").orderBy("path").collect()
    assert [(row["path"], row["first_line"]) for row in lost] == [
        (f"{root}/COPYING", None), (f"{root}/minified.js", 1),
    ]
    row = ct.file_stats(rows).where("path like '%/minified.js'").first()
    assert (row["files"], row["single"], row["code"]) == (1, 2, 1)
    found = ct.classified_lines(rows).where("path like '%/minified.js'").orderBy("pos").collect()
    assert [row["pos"] for row in found] == [0, 2, 3]
    skipped = ct.read_source_tree(spark, root, on_error="skip")
    assert ct.file_stats(skipped).where("path like '%/minified.js'").first()["code"] == 1
    assert skipped.where("path like '%/COPYING'").count() == 0


def test_lines_beyond_an_int(spark):
    files = spark.createDataFrame(
        [("r", "r/a.py", bytearray(b"# a\nb\n"), 2**31 - 1)],
        "repo string, path string, content binary, first_line long",
    )
    found = ct.classified_lines(files).orderBy("pos").collect()
    assert [(row["pos"], row["kind"]) for row in found] == [(2**31 - 1, "single"), (2**31, "code")]
    assert ct.language_stats(files).first()["code"] == 1


@pytest.mark.parametrize("text", ["aé€😀\n" * 9, "😀" * 20, "\n" * 9, "é\n\nx"])
def test_text_is_seen_whatever_the_ranges(text, monkeypatch):
    monkeypatch.setattr(source_tree, "BYTES_PER_PART", 3)
    content = text.encode()
    broken = [content[:i] + b"\x80" + content[i:] for i in range(len(content) + 1)]
    cut = [content[:i] + content[i + 1:] for i in range(len(content))]
    for data in [content, *broken, *cut]:
        for span in (4, 5, 7, 1000):
            monkeypatch.setattr(source_tree, "BYTES_PER_RANGE", span)
            measured = [
                source_tree._line_starts_and_text(io.BytesIO(data), start, len(data))
                for start in range(0, len(data), span)
            ]
            pieces = data.split(b"\n")
            assert sum(lines for lines, _ in measured) == len(pieces) - (pieces[-1] == b"")
            try:
                data.decode()
                expected = True
            except UnicodeDecodeError:
                expected = False
            assert all(is_text for _, is_text in measured) == expected
            parts = [
                part for start in range(0, len(data), span)
                for part, _ in source_tree._line_parts(
                    io.BytesIO(data), start, min(start + span, len(data)), 0)
            ]
            assert b"".join(parts) == data


def test_license_report_of_a_tree(spark, tree):
    root, _ = tree
    with open(f"{root}/COPYING", "w") as handle:
        handle.write("ISC License")
    os.mkdir(f"{root}/license")
    report = ct.license_report(ct.read_source_tree(spark, root), root)
    assert [(row["file"], row["license"]) for row in report.collect()] == [("COPYING", "ISC")]
