"""Path, language and single-file selection."""

import pytest

import codetally as ct
from codetally.functions import paths
from pyspark.sql import functions as F

FILES = "repo string, path string, content binary"


def kept(spark, names, **filters):
    files = spark.createDataFrame([("r", name, bytearray(b"x\n")) for name in names], FILES)
    return [row["path"] for row in ct.eligible_files(files, **filters).orderBy("path").collect()]


def test_default_ignores_are_substrings(spark):
    names = ["r/redistribute/a.py", "r/distance.py", "r/dist/a.py", "r/node_modules/x/a.js", "r/src/a.py"]
    assert kept(spark, names) == ["r/src/a.py"]


def test_root_is_part_of_the_path(spark):
    assert kept(spark, ["/data/dist-2/r/a.py", "/data/r/a.py"]) == ["/data/r/a.py"]


def test_hidden_switch(spark):
    hidden = ["r/.git/a.py", "r/.github/a.py", "r/.gitignore", "r/.vscode/a.json", "r/.hie/a.hs"]
    assert kept(spark, [*hidden, "r/.cache/a.py"], ignore_hidden=True) == ["r/.cache/a.py"]
    assert len(kept(spark, hidden)) == 5


@pytest.mark.parametrize(
    "aliases, expected",
    [
        (["py"], ["a.js", "a.kt", "a.md", "a.sh"]),
        (["kt", "haskell", "js,py", "bash"], ["a.js", "a.kt", "a.md", "a.py", "a.sh"]),
        (["md"], ["a.js", "a.kt", "a.py", "a.sh"]),
        (["py", "js"], ["a.kt", "a.md", "a.sh"]),
    ],
)
def test_ignored_languages(spark, aliases, expected):
    names = ["a.py", "a.js", "a.kt", "a.md", "a.sh"]
    assert kept(spark, names, ignore_langs=aliases) == expected


def test_alias_names_one_side_only(spark):
    # "py" is Python, not the other language called "py"; "Python" is the reverse.
    assert kept(spark, ["a.py", "a.Python"], ignore_langs=["py"]) == ["a.Python"]
    assert kept(spark, ["a.py", "a.Python"], ignore_langs=["Python"]) == ["a.py"]


def test_empty_fragment_ignores_everything(spark):
    assert kept(spark, ["a.py", "b/c.py"], ignore_dirs=[""]) == []


def test_fragment_matches_the_normalised_path(spark):
    names = ["./x//y/a.py", "x/./y/b.py", "x/../y/c.py"]
    assert kept(spark, names, ignore_dirs=["x/y"]) == ["x/../y/c.py"]
    assert kept(spark, names, ignore_dirs=["./"]) == ["./x//y/a.py", "x/./y/b.py"]


def test_single_file_skips_the_path_filter_only(spark):
    files = spark.createDataFrame([("r", "r/dist/a.py", bytearray(b"x\n"))], FILES)
    assert ct.language_stats(files).count() == 0
    assert ct.language_stats(files, single_file=True).count() == 1
    assert ct.language_stats(files, single_file=True, ignore_langs=["py"]).count() == 0
    assert ct.count_source_files(files).first()["files"] == 0


def test_count_source_files(spark):
    files = spark.createDataFrame([("p", "a.py"), ("p", "Makefile"), ("q", "b.md")], "repo string, path string")
    assert ct.count_source_files(files).first()["files"] == 2
    assert sorted(map(tuple, ct.count_source_files(files, by=["repo"]).collect())) == [("p", 1), ("q", 1)]


def test_more_ignores_never_add_files(spark):
    names = [f"{d}/{f}" for d in ("a", "a/b", "lib") for f in ("x.py", "y.md", "lib.c")]
    everything = set(kept(spark, names))
    for fragment in ("a", "b/", "lib", ".py", "zzz"):
        assert set(kept(spark, names, ignore_dirs=[fragment])) <= everything


def test_path_expressions(spark):
    cases = {
        # path: (extension, dirname, normalised)
        "a.py": (".py", "", "a.py"),
        "d.d/Makefile": ("", "d.d", "d.d/Makefile"),
        "x/.gitignore": (".gitignore", "x", "x/.gitignore"),
        "foo.": (".", "", "foo."),
        "/a.tar.gz": (".gz", "", "/a.tar.gz"),
        "//a/.//./b.c": (".c", "//a/.//.", "/a/b.c"),
        "./a/../b": ("", "./a/..", "a/../b"),
        "a/b\n.c\n": (".c\n", "a", "a/b\n.c\n"),
        "a./.b": (".b", "a.", "a./.b"),
    }
    rows = spark.createDataFrame([(path,) for path in cases], "path string").select(
        "path", paths.extension(F.col("path")), paths.dirname(F.col("path")), paths.normalised(F.col("path"))
    )
    assert {row[0]: tuple(row[1:]) for row in rows.collect()} == cases


COMPONENTS = [
    ("a/dist/b.py", ["x"], False), ("distance.py", [], True), ("redistribute/b.py", [], True), ("dist", [], None),
    ("x/a/b/c.py", ["a/b"], False), ("x/aa/b/c.py", ["a/b"], True), ("x/a/bb/c.py", ["a/b/"], True), ("a//./b/c.py", ["/a/b"], False),
    ("./src/x.py", ["src"], False), ("src.py", ["src"], True), ("a/src.py", ["src.py"], False), ("a/b.py", ["", "/", "."], True),
    ("/abs/lib/x.py", ["abs/lib"], False), ("/abs/lib/x.py", ["lib/abs"], True),
]


def test_whole_components(spark):
    for path, ignored, kept in COMPONENTS:
        if kept is None:
            continue
        files = spark.createDataFrame([(path,)], "path string")
        for given in (ignored, ignored + [f"none{i}/x" for i in range(80)], spark.createDataFrame([(f,) for f in ignored], "f string")):
            found = ct.eligible_files(files, ignore_dirs=given, whole_components=True).count()
            assert found == int(kept), (path, ignored)
