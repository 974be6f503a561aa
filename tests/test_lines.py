"""Hand-worked line counts, and the row-by-row brute force they agree with."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import codetally as ct
from codetally.sources import dimensions as dims

FILES = "repo string, path string, content binary"

# id, path, content, language, is_other, blank, code, single, multi
GOLDEN = [
    ("G1", "a.py", b'x=1\n\n# c\n"""doc\nbody\n"""\n', "Python", False, 1, 2, 1, 2),
    ("G2", "a.json", b"{\n\n}\n", "JSON", False, 1, 0, 0, 2),
    ("G3", "a.hs", b"{-# LANGUAGE X #-}\nmodule M where\n-- c\n{- a\n b\n-}\n", "Haskell", False, 0, 3, 1, 2),
    ("G4", "a.lua", b"--[[ b\nx\n]]\n", "Lua", False, 0, 2, 1, 0),
    ("G5", "a.m", b"% c\n// d\n/* e\nx\n", "ObjectiveC", False, 0, 2, 1, 1),
    ("G6", "a.mat", b"% c\n%{ d\nx\n", "MATLAB", False, 0, 1, 2, 0),
    ("G7", "a.sh", b"#!/bin/sh\n: 'x\n'\n", "Shell", False, 0, 1, 1, 1),
    ("G8", "a.pl", b"# perl\n% c\n=pod\n", "Prolog", False, 0, 2, 1, 0),
    ("G9", "a.vb", b"' c\nREM x\nDim a\n", "VB", False, 0, 0, 1, 2),
    ("G10", "a.bas", b"REMOVE x\nrem y\nPRINT\n", "Basic", False, 0, 0, 1, 2),
    ("G12", ".gitignore", b"a\n\n", "gitignore", True, 1, 1, 0, 0),
    ("G13", "a.PY", b"# c\n", "PY", True, 0, 1, 0, 0),
    ("G14", "foo.", b"x\n", "", True, 0, 1, 0, 0),
    ("G15", "img.png", b"\xff\xfe\n", "png", True, 0, 0, 0, 0),
    ("G16", "bad.py", b"# ok\n\xed\xa0\x80\n", "Python", False, 0, 0, 0, 0),
    ("G17", "e.py", b"", "Python", False, 0, 0, 0, 0),
    ("G18", "n.py", b"\n", "Python", False, 1, 0, 0, 0),
    ("G19", "m.py", b"a", "Python", False, 0, 1, 0, 0),
    ("G20", "o.py", b"a\n\n", "Python", False, 1, 1, 0, 0),
    ("G21", "crlf.py", b"# c\r\n\r\nx\r\n", "Python", False, 1, 1, 1, 0),
    ("G22", "cr.py", b"a\rb", "Python", False, 0, 1, 0, 0),
    ("G23", "nbsp.py", b"\xc2\xa0\n\xc2\x85\n", "Python", False, 1, 1, 0, 0),
    ("G24", "bom.py", b"\xef\xbb\xbf# c\n", "Python", False, 0, 1, 0, 0),
    ("G25", "a.tar.gz", b"x\n", "gz", True, 0, 1, 0, 0),
    ("G26", "a.css", b"// x\n/* y\n", "CSS", False, 0, 1, 0, 1),
    ("G27", "a.s", b"; x\n# y\n/* z\nmov\n", "Assembly", False, 0, 1, 2, 1),
    ("G28", "a.exs", b'@doc """\nx\n"""\n', "Elixir", False, 0, 2, 0, 1),
    ("G29", "a.rs", b"/* a /* b */\nc */ x\n", "Rust", False, 0, 1, 0, 1),
    ("NUL", "z.c", b"\x00// x\n\x00\n", "C", False, 0, 2, 0, 0),
    ("CTL", "u.c", b"\x1c\n\x0b\x0c// x\n\xe2\x80\xa8\n", "C", False, 0, 2, 1, 0),
    ("BAD", "o.c", b"\xc0\x80\n", "C", False, 0, 0, 0, 0),
]
DROPPED = [("Makefile", b"x\n"), ("d.d/Makefile", b"x\n")]


@pytest.fixture(scope="module")
def golden_files(spark):
    rows = [(case[0], case[1], bytearray(case[2])) for case in GOLDEN]
    rows += [("G11", path, bytearray(content)) for path, content in DROPPED]
    return spark.createDataFrame(rows, FILES)


def golden_counts():
    return {case[0]: (case[3], case[4], 1, *case[5:]) for case in GOLDEN}


COUNTS = ["language", "is_other", "files", "blank", "code", "single", "multi"]


def test_golden_file_stats(golden_files):
    rows = ct.file_stats(golden_files).collect()
    assert {row["repo"]: tuple(row[name] for name in COUNTS) for row in rows} == golden_counts()


def test_golden_language_stats(golden_files):
    rows = ct.language_stats(golden_files, by=["repo"]).collect()
    assert {row["repo"]: tuple(row[name] for name in COUNTS) for row in rows} == golden_counts()


def test_schemas(golden_files):
    assert [f.simpleString() for f in ct.classified_lines(golden_files).schema] == [
        "repo:string", "path:string", "language:string", "is_other:boolean", "pos:bigint", "kind:string",
    ]
    assert [f.simpleString() for f in ct.file_stats(golden_files).schema] == [
        "repo:string", "path:string", "language:string", "is_other:boolean",
        "files:bigint", "blank:bigint", "code:bigint", "single:bigint", "multi:bigint",
    ]
    assert [f.simpleString() for f in ct.language_stats(golden_files).schema] == [
        "language:string", "ordinal:int", "is_other:boolean",
        "files:bigint", "blank:bigint", "code:bigint", "single:bigint", "multi:bigint",
    ]


def test_extension_conflicts_go_to_the_later_language(spark):
    paths = ["a.sh", "a.bash", "a.zsh", "a.fish", "a.vb", "a.m", "a.pl", "a.S", "a.R", "x.Python"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    found = {row["path"]: row["language"] for row in ct.detect_language(files).collect()}
    assert found == {
        "a.sh": "Shell", "a.bash": "Shell", "a.zsh": "Shell", "a.fish": "Shell", "a.vb": "VB",
        "a.m": "ObjectiveC", "a.pl": "Prolog", "a.S": "Assembly", "a.R": "R", "x.Python": "Python",
    }
    others = ct.detect_language(files).where("is_other").collect()
    assert [(row["path"], row["ordinal"]) for row in others] == [("x.Python", 54)]


def test_other_language_with_a_known_name_has_no_markers(spark):
    files = spark.createDataFrame([("r", "x.Python", bytearray(b"# c\n"))], FILES)
    row = ct.file_stats(files).first()
    assert (row["language"], row["is_other"], row["code"], row["single"]) == ("Python", True, 1, 0)


# ------------------------------------------------------------- brute force

EXTENSIONS = sorted({ext for _, exts, *_ in dims.LANGUAGES for ext in exts}) + [".md", ".PY", ".", ""]
MARKERS = sorted({m for _, _, single, opener, *_ in dims.LANGUAGES for m in [*single, opener]})
FRAGMENTS = [*MARKERS, *dims.WHITESPACE, "\u0085", "﻿", "​", "x", "é", "REM", "\x00"]


def brute_force(path: str, content: bytes):
    """Counts of one file, one line at a time; None when the file is dropped."""
    name = path.rsplit("/", 1)[-1]
    if "." not in name:
        return None
    ext = name[name.rindex("."):]
    owner = [row for row in dims.LANGUAGES if ext in row[1]]
    counts = dict.fromkeys(["blank", "code", "single", "multi"], 0)
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = ""
    pieces = text.split("\n")
    if pieces[-1] == "":
        pieces.pop()
    for line in pieces:
        stripped = line.strip(dims.WHITESPACE)
        if not stripped:
            counts["blank"] += 1
        elif owner and any(stripped.startswith(m) for m in owner[-1][2]):
            counts["single"] += 1
        elif owner and stripped.startswith(owner[-1][3]):
            counts["multi"] += 1
        else:
            counts["code"] += 1
    return (owner[-1][0] if owner else ext[1:], not owner, 1, *counts.values())


line = st.lists(st.sampled_from(FRAGMENTS), max_size=5).map("".join)
content = st.one_of(
    st.builds(
        lambda lines, end: ("\n".join(lines) + end).encode(),
        st.lists(line, max_size=8), st.sampled_from(["", "\n", "\r\n", "\n\n"]),
    ),
    st.binary(max_size=12),
)
corpus = st.lists(st.tuples(st.sampled_from(EXTENSIONS), content), min_size=1, max_size=60)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(corpus)
def test_brute_force(spark, files):
    rows = [("r", f"d.x/f{i}{ext}", bytearray(data)) for i, (ext, data) in enumerate(files)]
    expected = {}
    for _, path, data in rows:
        counts = brute_force(path, bytes(data))
        if counts:
            expected[path] = counts
    table = spark.createDataFrame(rows, FILES)
    per_file = ct.file_stats(table).collect()
    assert {r["path"]: tuple(r[name] for name in COUNTS) for r in per_file} == expected
    grouped = ct.language_stats(table, by=["path"]).collect()
    assert {r["path"]: tuple(r[name] for name in COUNTS) for r in grouped} == expected
    lines = ct.classified_lines(table).groupBy("path").pivot("kind", list(COUNTS[3:])).count()
    seen = {r["path"]: tuple(r[name] or 0 for name in COUNTS[3:]) for r in lines.collect()}
    assert seen == {p: c[3:] for p, c in expected.items() if sum(c[3:])}


def test_sum_of_files_is_language_stats(golden_files):
    summed = (
        ct.file_stats(golden_files).groupBy("language", "is_other")
        .agg(*[F.sum(name).alias(name) for name in COUNTS[2:]])
    )
    direct = ct.language_stats(golden_files).select(*COUNTS)
    assert sorted(summed.select(*COUNTS).collect()) == sorted(direct.collect())


def test_combining_parts_is_the_whole(golden_files):
    whole = sorted(ct.language_stats(golden_files).collect())
    by_repo = ct.language_stats(golden_files, by=["repo"])
    assert sorted(ct.combine_stats(by_repo).collect()) == whole
    parts = [by_repo.where(F.col("repo") < "G2"), by_repo.where(F.col("repo") >= "G2")]
    assert sorted(ct.combine_stats(*parts).collect()) == whole
    assert sorted(ct.combine_stats(*parts, by=["repo"]).collect()) == sorted(by_repo.collect())
