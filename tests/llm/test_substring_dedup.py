"""Repeated passages against brute force."""

import random

import numpy as np
import pytest

from codetally.llm import substring_dedup

SCHEMA = "doc_id long, text string, id int, salt int, payload string, bucket int, hits int, removed int, kept int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 5, 6) for r in rows], SCHEMA).repartition(parts)


def brute_force(rows, size):
    first = {}
    split = [(i, (text or "").encode().split()) for i, text in rows]
    for i, words in split:
        for p in range(len(words) - size + 1) if i is not None else ():
            window = tuple(words[p : p + size])
            first[window] = min(first.get(window, i), i)
    result = []
    for i, words in split:
        gone = np.zeros(len(words) + 1, bool)
        for p in range(len(words) - size + 1) if i is not None else ():
            if first[tuple(words[p : p + size])] < i:
                gone[p : p + size] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone]))
        kept = b" ".join(w for w, g in zip(words, gone) if not g).decode()
        result.append((i, len(words), edges.reshape(-1, 2).tolist(), kept))
    return sorted(result, key=str)


def results(df):
    return sorted(
        ((r.doc_id, r.n_words, [[s.start, s.stop] for s in r.removed], r.kept) for r in df.collect()), key=str
    )


@pytest.mark.parametrize("lot,bucket", [(1 << 22, 16 << 20), (40, 200)])
def test_random_texts(spark, monkeypatch, lot, bucket):
    rng = random.Random(7)
    words = ["a", "b", "c", "é", "x y", "word"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for i in range(150)]
    passage = " ".join(f"w{i}" for i in range(30))
    rows += [(200 + i, f"own{i} start\t{passage}\n end{i}") for i in range(60)]
    rows += [(300, "same " * 40), (301, "same " * 25 + "tail"), (302, passage + " " + passage)]
    rows += [(None, passage), (None, None), (400, None), (401, ""), (402, " \t\n"), (-5, passage[3:])]
    rows += [rows[155], rows[155], (202, "other text " * 9), (1 << 62, passage), (-(1 << 62), "a b c " * 9)]
    expected = brute_force(rows, 5)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(substring_dedup, "MIN_BUCKETS", 3)
    assert results(substring_dedup.remove_repeats(frame(spark, rows, 7), size=5, lot=lot)) == expected


def test_lots_of_a_task_are_bounded():
    passage = " ".join(f"w{i}" for i in range(40))
    lots = substring_dedup.Lots(2, 13)
    for i in range(1000):
        lots.add(i, passage.encode())
    rows = [r for b in lots.rows() for r in b.to_pylist()]
    packed = [substring_dedup.unpack_windows(r["payload"]) for r in rows if r["id"] is None]
    assert sum(len(h) for h, *_ in packed) == 28, "a window of all rows goes on once"
    assert {i for *_, ids, _ in packed for i in ids.tolist()} == {0}
    assert sorted(r["id"] for r in rows if r["id"] is not None) == list(range(1, 1000))


def test_long_text_and_nothing(spark):
    long = " ".join(f"t{i % 1700}" for i in range(300_000))
    rows = [(1, long), (2, "before " + long + " after"), (3, "nothing repeated here")]
    got = results(substring_dedup.remove_repeats(frame(spark, rows)))
    assert got == [(1, 300_000, [], long), (2, 300_002, [[1, 300_001]], "before after"), (3, 3, [], rows[2][1])]
    assert substring_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_packed_windows_come_back():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    check = rng.integers(0, 1 << 32, 500).astype(np.uint32)
    doc = rng.integers(0, 9, 500).astype(np.uint32)
    ids, salts = rng.integers(-(1 << 62), 1 << 62, 9), rng.integers(0, 1 << 16, 9)
    back = substring_dedup.unpack_windows(substring_dedup.pack_windows(h, check, doc, ids, salts))
    for a, b in zip(back, (h, check, ids[doc], salts[doc])):
        assert (a == b).all()
