"""Contents cut into several rows count like whole ones."""

import random

import pytest

import codetally as ct

FILES = "repo string, path string, content binary, size int"
STATS = [ct.language_stats, ct.file_stats, ct.classified_lines, ct.count_source_files, ct.subtree_stats]


def contents(rng):
    lines = [b"# c", b"", b"x = 1", b'"""doc', "é€😀 z".encode(), b" \t# d", b"y" * 40, b"\r"]
    for i in range(120):
        data = b"\n".join(rng.choice(lines) for _ in range(rng.randrange(30))) + rng.choice([b"", b"\n", b"\n\n"])
        if i % 9 == 0:
            at = rng.randrange(len(data) + 1)
            data = data[:at] + b"\xff" + data[at:]
        yield data


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    made = [("r", f"d/f{i}.py", bytearray(c), i) for i, c in enumerate(contents(rng))]
    return made + [("r", "d/null.py", None, 0), ("r", "d/empty.py", bytearray(), 0), ("r", "d/nl.py", bytearray(b"\n" * 99), 0)]


@pytest.mark.parametrize("row_bytes", [1, 2, 7, 50, 1_000_000])
def test_counts_are_those_of_whole_files(spark, rows, row_bytes):
    whole = spark.createDataFrame(rows, FILES).repartition(3)
    cut = ct.cut_large_rows(whole, row_bytes)
    assert cut.columns == ["repo", "path", "content", "size", "first_line"]
    for make in STATS:
        assert sorted(make(cut).collect()) == sorted(make(whole).collect())


@pytest.mark.parametrize("row_bytes", [1, 7, 50])
def test_parts_end_with_lines_and_make_the_whole(spark, rows, row_bytes):
    found = ct.cut_large_rows(spark.createDataFrame(rows, FILES), row_bytes).collect()
    for _, path, content, size in rows:
        parts = [r for r in found if r["path"] == path]
        assert {r["size"] for r in parts} == {size}
        if content is None or len(content) <= row_bytes:
            assert [(r["content"], r["first_line"]) for r in parts] == [(content, None)]
            continue
        parts.sort(key=lambda r: abs(r["first_line"] + 0.5))
        assert b"".join(bytes(r["content"]) for r in parts) == bytes(content)
        at = 0
        for r in parts:
            before = bytes(content[:at])
            if r["first_line"] >= 0:
                assert r["first_line"] == before.count(b"\n") and (not at or before.endswith(b"\n"))
                longest = max(len(x) + 1 for x in bytes(content).split(b"\n"))
                assert len(r["content"]) <= row_bytes + longest
            else:
                assert r["first_line"] == -1 - at and len(r["content"]) <= row_bytes
            at += len(r["content"])


def test_rows_that_are_parts_already(spark):
    rows = [("r", "a.py", bytearray(b"# a\nb\n" * 5), 100), ("r", "b.py", bytearray(b"\xff" * 20), -41)]
    files = spark.createDataFrame(rows, "repo string, path string, content binary, first_line long")
    found = {(r["path"], r["first_line"]): len(r["content"]) for r in ct.cut_large_rows(files, 12).collect()}
    assert found == {("a.py", 100): 12, ("a.py", 104): 12, ("a.py", 108): 6, ("b.py", -41): 12, ("b.py", -53): 8}


def test_plan_has_no_shuffle_and_no_python(spark, rows):
    cut = ct.cut_large_rows(spark.createDataFrame(rows, FILES), 10)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        ct.cut_large_rows(cut, 0)
