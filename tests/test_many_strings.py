"""Long lists and tables of fragments, languages and phrases."""

import random
import time

import pytest
from pyspark.sql import functions as F

import codetally as ct
from codetally.functions import matching
from codetally.sources import dimensions as dims


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(2)
    parts = ["src", "lib", "a", "é", "dist2", "x.y", "node", ".", "", "test"]
    rows = [("/".join(rng.choices(parts, k=rng.randrange(1, 6))) + f"/f{i}.{rng.choice(['py', 'js', 'zz', 'q9'])}",) for i in range(3000)]
    return spark.createDataFrame(rows, "path string").repartition(3)


def fragments(n):
    rng = random.Random(3)
    some = ["/f1", "lib/a", "é/", "x.y/test", "f2999", "src/src", "q", "no such", "dist2/f"]
    return some + ["".join(rng.choices("abcdefgh/", k=rng.randrange(5, 30))) for _ in range(n)]


def kept(frame):
    return sorted(r["path"] for r in frame.collect())


def brute(spark, files, wanted):
    def normal(path):
        out = "/".join(p for p in path.split("/") if p not in ("", "."))
        return "/" + out if path.startswith("/") else out

    ignored = [*dims.DEFAULT_IGNORE_DIRS, *wanted]
    return sorted(r["path"] for r in files.collect() if not any(f in normal(r["path"]) for f in ignored))


def test_ten_thousand_fragments(spark, files):
    wanted = fragments(10_000)
    expected = brute(spark, files, wanted)
    assert 0 < len(expected) < 2500
    start = time.time()
    assert kept(ct.eligible_files(files, ignore_dirs=wanted)) == expected
    assert time.time() - start < 60
    assert kept(ct.eligible_files(files, ignore_dirs=wanted[:70])) == brute(spark, files, wanted[:70])
    assert kept(ct.eligible_files(files, ignore_dirs=wanted + [""])) == []


def test_a_table_of_fragments(spark, files, monkeypatch):
    wanted = fragments(3_000)
    table = spark.createDataFrame([(f,) for f in wanted + [None, wanted[0]]], "fragment string")
    found = ct.eligible_files(files, ignore_dirs=table)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert kept(found) == brute(spark, files, wanted)
    monkeypatch.setattr(matching, "AUTOMATON_BYTES", 1000)
    assert kept(ct.eligible_files(files, ignore_dirs=wanted)) == brute(spark, files, wanted)
    none = ct.eligible_files(files, ignore_dirs=table.limit(0))
    assert kept(none) == brute(spark, files, [])
    assert kept(ct.eligible_files(files, ignore_dirs=spark.createDataFrame([("",)], "f string"))) == []


def test_a_hundred_thousand_languages(spark, files):
    names = ["py", "zz", *(f"lang{i}" for i in range(100_000))]
    found = ct.eligible_files(files, ignore_langs=names)
    assert "NestedLoop" not in plan(found)
    expected = kept(ct.eligible_files(files, ignore_langs=["py", "zz"]))
    assert kept(found) == expected and expected
    table = spark.createDataFrame([("py",), ("zz",), (None,), ("py",)], "name string")
    assert kept(ct.eligible_files(files, ignore_langs=table)) == expected
    assert found.columns == ct.eligible_files(files).columns


def test_phrases_of_a_table(spark):
    rows = [(n, o, p) for o, n, _, p in dims.fingerprint_rows()]
    table = spark.createDataFrame(rows, "license string, ordinal int, phrase string")
    texts = [" ".join(p.upper() for _, _, p in rows[i : i + 3]) for i in range(len(rows))] + ["", None, "nothing", "MIT\tLicense"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    whole = ct.license_scores(frame).where("matches > 0").drop("total")
    found = ct.license_scores_of(frame, table).drop("total")
    order = ["doc_id", "license", "ordinal", "matches"]
    assert sorted(found.select(order).collect()) == sorted(whole.select(order).collect()) != []
    totals = ct.license_scores_of(frame, table)
    bad = totals.where(F.abs(F.col("score") - F.least(F.lit(1.0), 1.5 * F.col("matches") / F.col("total"))) > 1e-12)
    assert bad.count() == 0


def test_ten_thousand_phrases(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    phrases = [(f"l{i % 900}", i % 900, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 4)))) for i in range(10_000)]
    texts = [" ".join(rng.choices(vocabulary, k=200)) for _ in range(60)]
    found = ct.license_scores_of(
        spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2),
        spark.createDataFrame(phrases, "license string, ordinal int, phrase string"),
    )
    expected = {}
    for i, text in enumerate(texts):
        for name, _, phrase in phrases:
            if phrase in text:
                expected[i, name] = expected.get((i, name), 0) + 1
    assert {(r["doc_id"], r["license"]): r["matches"] for r in found.collect()} == expected
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    nothing = spark.createDataFrame([], "license string, ordinal int, phrase string")
    assert ct.license_scores_of(spark.createDataFrame([(1, "x")], "doc_id int, text string"), nothing).count() == 0
