"""The summary report."""

import codetally as ct

FILES = "repo string, path string, content binary"
STATS = (
    "language string, ordinal int, is_other boolean, "
    "files long, blank long, code long, single long, multi long"
)
GR1 = [
    ("p", "a.py", bytearray(b'x=1\n\n# c\n"""doc\nbody\n"""\n')),
    ("p", "a.json", bytearray(b"{\n\n}\n")),
    ("q", ".gitignore", bytearray(b"a\n\n")),
    ("q", "a.PY", bytearray(b"# c\n")),
]


def rows(report):
    return [tuple(row) for row in report.collect()]


def test_other_and_total_count_one_file_more(spark):
    stats = ct.language_stats(spark.createDataFrame(GR1, FILES))
    assert rows(ct.summary_report(stats)) == [
        ("JSON", 1, 1, 2, 0),
        ("Python", 1, 1, 3, 2),
        ("Other", 3, 1, 0, 2),
        ("Total", 5, 3, 5, 4),
    ]


def test_report_per_repository(spark):
    stats = ct.language_stats(spark.createDataFrame(GR1, FILES), by=["repo"])
    assert rows(ct.summary_report(stats, by=["repo"])) == [
        ("p", "JSON", 1, 1, 2, 0),
        ("p", "Python", 1, 1, 3, 2),
        ("p", "Total", 3, 2, 5, 2),
        ("q", "Other", 3, 1, 0, 2),
        ("q", "Total", 3, 1, 0, 2),
    ]


def test_no_files_no_rows(spark):
    stats = ct.language_stats(spark.createDataFrame([], FILES))
    assert rows(ct.summary_report(stats)) == []
    assert rows(ct.summary_report(ct.language_stats(spark.createDataFrame([], FILES), by=["repo"]), by=["repo"])) == []


def test_known_languages_come_in_table_order(spark):
    stats = spark.createDataFrame(
        [
            ("Python", 37, False, 5, 80, 300, 100, 20),
            ("JavaScript", 22, False, 3, 40, 200, 60, 0),
            ("Haskell", 19, False, 2, 150, 500, 150, 50),
        ],
        STATS,
    )
    assert rows(ct.summary_report(stats)) == [
        ("Haskell", 2, 150, 200, 500),
        ("JavaScript", 3, 40, 60, 200),
        ("Python", 5, 80, 120, 300),
        ("Total", 11, 270, 380, 1000),
    ]
    assert rows(ct.summary_lines(stats)) == [
        ("Haskell            2      150       200      500",),
        ("JavaScript         3       40        60      200",),
        ("Python             5       80       120      300",),
        ("Total             11      270       380     1000",),
    ]


def test_an_extension_called_other_is_pooled_like_the_rest(spark):
    files = [("r", "a.Other", bytearray(b"x\n")), ("r", "a.Total", bytearray(b"x\ny\n"))]
    stats = ct.language_stats(spark.createDataFrame(files, FILES))
    assert rows(ct.summary_report(stats)) == [("Other", 3, 0, 0, 3), ("Total", 3, 0, 0, 3)]


def test_subtrees(spark):
    files = [
        ("r", "r/a.py", bytearray(b"x\n")),
        ("r", "r/s/b.py", bytearray(b"x\n\n")),
        ("r", "r/s/t/c.py", bytearray(b"# c\n")),
    ]
    found = ct.subtree_stats(spark.createDataFrame(files, FILES))
    assert {r["directory"]: (r["files"], r["blank"], r["code"], r["single"]) for r in found.collect()} == {
        "r": (3, 1, 2, 1),
        "r/s": (2, 1, 1, 1),
        "r/s/t": (1, 0, 0, 1),
    }
