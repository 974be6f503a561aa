"""Alignments and counts of links against whole-text encoding and plain loops."""

import collections
import hashlib
import io
import random

import numpy as np
import pytest

from codetally.llm import token_alignment as alignment

SCHEMA = "doc_id long, text string, file int, part int, pair int, n int, best int, id int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def sides():
    return alignment.SideA(alignment.SIDE_A), alignment.SideB(alignment.SIDE_B)


def brute_force(rows, sides):
    side_a, side_b = sides
    counts, aligned = collections.Counter(), []
    for i, text in rows:
        a = side_a.tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = side_b.processor.encode(text) if text else []
        joined = {b"".join(s.bytes[x] for x in ids) for s, ids in ((side_a, a), (side_b, b))}
        if not text or joined != {(" " + text).encode()}:
            aligned.append((i, 0, 0, [], []))
            continue
        spans = []
        for side, ids in ((side_a, a), (side_b, b)):
            ends = np.cumsum([len(side.bytes[x]) for x in ids]).tolist()
            spans.append(list(zip([0, *ends], ends, ids)))
        links, groups, j = [], [], 0
        for start, end, x in spans[0]:
            while spans[1][j][1] <= start:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < end:
                links.append((x, spans[1][k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        for start, end in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(x) for s, e, x in side if start <= s and e <= end) for side in spans))
        aligned.append((i, len(a), len(b), groups, links))
        counts.update(set(links))
    highest = collections.Counter()
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    return sorted((
        (
            i, n_a, n_b, len(groups), len(links), sum(counts[p] == highest[p[0]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "",
        )
        for i, n_a, n_b, groups, links in aligned
    ), key=str)


def aligned(df, **options):
    return sorted(map(tuple, alignment.align_tokens(df, **options).collect()), key=str)


ODD = [
    None, "", " ", "  two  spaces ", "trailing ", "tab\there\r\n new line", "▁marker", "a ▁ b", "<s> x </s> <|endoftext|>",
    "<0x41> bytes", "\x00 zero \x85 \xa0 x", "ﬁ ligature Å é é ́ alone", "漢字 かな 한글", "🙂 🙂🙂 emoji", "don't we'll I'M",
    "1234567 3.14 -5", "　wide space　x", "a b   c", "​zero width ​", "x" * 3000, "word " * 3000, "\x1c \x1d x \x1f",
]


@pytest.mark.parametrize("options", [{}, {"merge_bytes": 500}])
def test_texts_of_all_kinds(spark, sides, options):
    rng = random.Random(3)
    letters = ["a", "é", " ", " ", " ", ".", "\n", "漢", "1", "'s", "the ", "ing", "\t", "🙂", "_", "\xa0"]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) + rng.choice(["", "", "▁"]) for _ in range(300)]
    rows = list(enumerate(texts)) + [(5, texts[5]), (5, texts[5]), (None, "null id"), (None, None), (7, "same id")]
    found = aligned(frame(spark, rows, 7), **options)
    assert found == brute_force(rows, sides)
    assert sum(r[1] > 0 for r in found) > 200


def test_real_texts(spark, sides):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert aligned(docs) == brute_force([(r.doc_id, r.text) for r in docs.collect()], sides)


def test_nothing(spark):
    assert aligned(frame(spark, []).limit(0)) == []
    assert aligned(frame(spark, [(1, None), (2, "")])) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_runs_are_merged_in_order(monkeypatch, block):
    rng = np.random.default_rng(block)
    monkeypatch.setattr(alignment, "BLOCK_RECORDS", block)
    runs, records = [], []
    for run, size in enumerate([0, 1, 40, 300, 5]):
        pair = np.sort(rng.integers(0, 9, size) << 32 | rng.integers(0, 3, size))
        doc, times = rng.integers(0, 1 << 31, size), rng.integers(1, 9, size)
        out = io.BytesIO()
        alignment.write_run(out, pair, doc, times)
        runs.append(out.getvalue())
        records += [(int(p), run, int(d), int(t)) for p, d, t in zip(pair, doc, times)]
    merged = [r for part in alignment.merge_runs(runs) for r in zip(*(c.tolist() for c in part))]
    assert [r[0] for r in merged] == sorted(r[0] for r in records)
    assert sorted(merged) == sorted(records)
    counts = collections.Counter()
    for pair, n in alignment.count_portions(runs):
        counts.update(dict(zip(pair.tolist(), n.tolist())))
    assert counts == collections.Counter(r[0] for r in records)


def test_best_of_side():
    pair = np.array([1 << 32, 1 << 32 | 5, 2 << 32 | 1, 3 << 32, 3 << 32 | 1, 3 << 32 | 2])
    assert alignment.best_of_side(pair, np.array([2, 7, 1, 4, 4, 3])).tolist() == [False, True, True, True, True, False]


def test_texts_are_not_cut_for_unknown_tokenizers(sides, monkeypatch):
    found = alignment.Aligner(alignment.SIDE_A, alignment.SIDE_B)
    assert found.cuts and len(found.units("three little words")) == 3
    found.cuts = False
    assert len(found.units("three little words")) == 1


def test_new_units_are_encoded_in_bounded_slices(sides, monkeypatch):
    texts = [f"word{i} w{i % 7} w{i % 7} don't 漢{i} 🙂" for i in range(300)] + ["x" * 500 + " y"]
    whole = alignment.Aligner(alignment.SIDE_A, alignment.SIDE_B)
    found = [whole.units(t) for t in texts]
    whole.settle()
    monkeypatch.setattr(alignment, "SLICE_UNITS", 50)
    monkeypatch.setattr(alignment, "SLICE_CHARS", 200)
    sliced, seen = alignment.Aligner(alignment.SIDE_A, alignment.SIDE_B), []
    encode = sliced.a.encode
    monkeypatch.setattr(sliced.a, "encode", lambda units: seen.append(units) or encode(units))
    again = [sliced.units(t) for t in texts]
    sliced.settle()
    assert len(seen) > 10 and max(map(len, seen)) <= 50
    assert all(len(u) == 1 or sum(map(len, u[:-1])) < 200 for u in seen)
    assert sliced.groups == whole.groups and (sliced.numbers == whole.numbers).all()
    for left, right in zip(whole.pair_records(found), sliced.pair_records(again)):
        assert left.tolist() == right.tolist()
    pair, doc, times = whole.pair_records(found)
    assert len(set(zip(pair.tolist(), doc.tolist()))) == len(pair) and times.sum() == sum(whole.numbers[u, 3].sum() for u in found)
