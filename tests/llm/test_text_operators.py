"""Decontamination, quality, token ids and licence rules."""

import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from codetally.llm import decontaminate, license_rules, sentencepiece_codec, weak_label

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id string, shingle string, length int, h int, n_words string, row__ int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, "z", 3) for i, t in rows], DOCS)


def brute_contained(docs, items):
    def runs(text, n):
        w = WORDS.findall((text or "").lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    texts, found = {}, []
    for i, t in docs:
        if i is not None:
            texts.setdefault(i, []).append(t)
    for item, text in items:
        n = min(5, len(WORDS.findall(text or "")))
        wanted = runs(text, n) if n else set()
        for i, ts in texts.items():
            shared = len(wanted & set().union(*(runs(t, n) for t in ts))) if wanted else 0
            if item is not None and shared and shared >= 0.8 * len(wanted):
                found.append((i, item, len(wanted), shared))
    return sorted(found)


def test_contained_items_match_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([1, 3, 4, 5, 6, 9, 20, 40, 70])]
    items += [(90, None), (91, "..."), (None, items[6][1]), (92, "a a a a a a a a a a")]
    docs = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.choice([0, 3, 40, 400]))
        item = rng.choice(items[:9])[1].split()
        cut = item[: max(1, round(len(item) * rng.choice([0.5, 0.8, 0.85, 0.9, 1.0])))]
        at = rng.randrange(len(words) + 1)
        docs.append((i, (", ".join(words[:at] + cut + words[at:])).upper()))
    docs += [(100, None), (101, ""), docs[0], (None, items[7][1]), (102, items[8][1] + " x " * 50_000), (103, "A, a a a a a!")]
    found = decontaminate.contained_items(
        docs_frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    )
    rows = sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in found.collect())
    assert rows == brute_contained(docs, items) and len(rows) > 20


def test_contaminated_documents_go(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = docs_frame(spark, [(1, "x " + item), (2, "clean"), (None, item), (2, "clean"), (3, None)])
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, items)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "2", "3", "None"]
    assert kept.columns[0] == "doc_id" and set(kept.columns) == set(docs.columns)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(docs, none).count() == 5
    assert decontaminate.contained_items(docs.limit(0), items).count() == 0


def test_decontamination_is_native(spark):
    docs = docs_frame(spark, [(1, "a b c d e f")])
    items = spark.createDataFrame([(7, "a b c d e f")], "item_id long, text string")
    plan = decontaminate.contained_items(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian", plan)


def quality_rows(rng, n):
    rows = []
    for i in range(n):
        words = [rng.choice(["the", "river", "goes", "slowly", "past", "old", "mills", "and"]) + rng.choice(["", "", "", ",", "."])
                 + "" for _ in range(rng.randrange(20, 90))]
        words = [w for k, w in enumerate(words) if k == 0 or w != words[k - 1]]
        kind = i % 10
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 1:
            words = [x for w in words for x in (w, "|")]
        elif kind == 2:
            words = [w + rng.choice(["***", "$$$", "%%%"]) for w in words]
        elif kind == 3:
            words = [w for w in words[:6] for _ in range(10)]
        rows.append((i, " ".join(words), int(kind > 3)))
    return rows


def test_quality_on_planted_junk(spark):
    train, held = quality_rows(random.Random(1), 400), quality_rows(random.Random(2), 200)
    model = weak_label.fit_quality(docs_frame(spark, [r[:2] for r in train]))
    wrong = [r for r in held if (model.scorer.score(r[1]) >= weak_label.THRESHOLD) != r[2]]
    assert len(wrong) <= 4
    kept = weak_label.keep_quality(docs_frame(spark, [r[:2] for r in train] + [(None, None), (900, ""), (900, "")]))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    ids = {r.doc_id for r in kept.collect()}
    assert sum((r[0] in ids) != r[2] for r in train) <= 8


def repeated_and_keyword_junk(rng, vocabulary):
    keywords = "buy cheap pills casino bonus free win online".split()

    def sentences(n):
        words = [rng.choice(vocabulary) for _ in range(n)]
        return " ".join(w + "." * (k % 9 == 8) for k, w in enumerate(words))

    rows = [(sentences(rng.randrange(30, 300)), 1) for _ in range(240)]
    for i in range(60):
        kind = (
            (sentences(rng.randrange(10, 30)) + " ") * rng.randrange(10, 100),
            "\n".join([sentences(9), sentences(9), sentences(9)] * rng.randrange(10, 60)),
            " ".join(rng.choices(keywords, k=120)),
        )
        rows.append((kind[i % 3], 0))
    return rows + [(sentences(20_000), 1) for _ in range(3)]


def test_quality_on_repeated_and_keyword_junk(spark):
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    train, held = (repeated_and_keyword_junk(random.Random(i), vocabulary) for i in (1, 2))
    model = weak_label.fit_quality(docs_frame(spark, [(i, t) for i, (t, _) in enumerate(train)]))
    wrong = [(t[:60], good) for t, good in held if (model.scorer.score(t) >= weak_label.THRESHOLD) != good]
    assert len(wrong) <= 2


def test_labels_on_given_table(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    kept = {r.doc_id for r in weak_label.keep_quality(docs).select("doc_id").collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = sum((i in kept) == bool(q) for i, q in truth.items())
    assert right >= 0.98 * len(truth)
    assert all(i in kept for i, q in truth.items() if q) or right >= 0.99 * len(truth)


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(4000) < 0.8
    junk_votes = np.where(good[:, None], 0.02, 0.6) > rng.random((4000, 4))
    patterns = np.where(junk_votes, weak_label.JUNK, weak_label.GOOD)
    prior, table, posterior = weak_label.fit_labellers(patterns, np.ones(len(patterns)), unnoticed=0)
    assert abs(prior - 0.8) < 0.03
    assert np.abs(table[:, 0, weak_label.JUNK] - 0.6).max() < 0.1
    assert ((posterior > 0.5) == good).mean() > 0.95


def test_no_documents_give_a_model(spark):
    empty = docs_frame(spark, []) if False else spark.createDataFrame([], DOCS)
    assert weak_label.keep_quality(empty).count() == 0
    assert weak_label.fit_quality(empty).scorer.score("any") > 0.5


TEXTS = [None, "", " ", "Hello  world", "  two\n\nlines ", "日本語 and 😀", "a\u00a0b\x00", "<s> </s> <unk>", "▁x", "e\u0301é", "x" * 5000, "the " * 30_000]


def test_token_ids_are_those_of_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL_FILE)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "again"), (3, TEXTS[3])]
    encoded = sentencepiece_codec.encode(docs_frame(spark, rows))
    found = encoded.collect()
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(str(i) for i, _ in rows)
    texts = dict(rows)
    for r in found:
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode(text) and r.word_parity and r.n_tokens == len(r.ids)
        assert r.parity is (True if r.doc_id == 0 else None)
        assert r.round_trip == ("▁" not in text)
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(encoded).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in rows)
    assert sentencepiece_codec.encode(spark.createDataFrame([], DOCS)).count() == 0


def test_a_wrong_normaliser_fails_whole_texts(spark, monkeypatch):
    docs = docs_frame(spark, [(i, f"some  words {i}") for i in range(60)])
    good = {r.doc_id: r.parity for r in sentencepiece_codec.encode(docs).collect()}
    assert good == {i: (True if i % 20 == 0 else None) for i in range(60)}
    assert [sentencepiece_codec._audited(i) for i in (None, 0, 19, 40, "x")][:4] == [False, True, False, True]
    monkeypatch.setattr(sentencepiece_codec.Codec, "normalise", lambda self, text: "▁" + text.replace("  ", " ").replace(" ", "▁"))
    data = open(sentencepiece_codec.MODEL_FILE, "rb").read()
    codec = sentencepiece_codec.Codec(data, 1, True)
    ids, same = codec.encode_batch(["some  words"])
    assert ids[0] != codec.library.encode("some  words"), "whole texts tell what words cannot"


def test_words_kept_over_a_change_of_the_memo(monkeypatch):
    import sentencepiece

    data = open(sentencepiece_codec.MODEL_FILE, "rb").read()
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    monkeypatch.setattr(sentencepiece_codec, "MEMO_WORDS", 4)
    codec = sentencepiece_codec.Codec(data, 1, True)
    for batch in (["the cat sat on the mat"], ["the dog"], ["a cat", ""], ["one two three four five the cat"], ["sat"]):
        ids, same = codec.encode_batch(batch)
        assert ids == library.encode(batch)
        assert all(same)
    assert len(codec.memo) + len(codec.old) < 20


def test_whole_texts_give_the_same_ids_as_words():
    data = open(sentencepiece_codec.MODEL_FILE, "rb").read()
    words, whole = sentencepiece_codec.Codec(data, 1), sentencepiece_codec.Codec(data, 1)
    assert words.splits
    whole.splits = False
    texts = [t or "" for t in TEXTS[:-1]]
    assert words.encode_batch(texts) == whole.encode_batch(texts)


def brute_phrases(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    places = []
    for phrase, label in license_rules.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


def brute_hits(text):
    words = brute_words(text)
    spaced = "".join(f" {w} " for w in words)
    found = []
    for i, r in enumerate(license_rules.signature_rules()):
        if "".join(f" {w} " for w in r.keyword.split()) in spaced:
            for m in re.finditer(r.regex, spaced):
                a = spaced[: m.start()].count(" ") // 2
                found.append((a, a + m[0].count(" ") // 2, r.priority, i, r.label))
    return sorted(
        d for d in found
        if not any(
            e[0] <= d[0] and e[1] >= d[1]
            and (e[2] > d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[1] - e[0] == d[1] - d[0] and e[3] < d[3]))
            for e in found
        )
    )


def brute_words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


LICENSE_TEXTS = [
    None, "", "no mention at all", "Released under the MIT license. CC-BY-NC 4.0; CC BY-NC!",
    "under the mit license under the mit license", "Apache License, Version 2.0 apache license version 2",
    "licensed under the terms of the GNU General Public License version 3 or GPLv2, GPL-2.0, LGPL v2.1",
    "SPDX-License-Identifier: MPL-2.0", "BSD 3-Clause License, 2-clause BSD", "MIT", "UNDER THE M\u0130T LICENSE \u212a",
    "Creative Commons Attribution Non-Commercial Share Alike license 4.0", "x " * 20_000 + "cc by nc",
    ("under the MIT license and the GPL v3 " * 300),
]


def test_license_scan_matches_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(LICENSE_TEXTS)] + [(None, LICENSE_TEXTS[3]), (3, LICENSE_TEXTS[3])]
    scanned = license_rules.scan_licenses(docs_frame(spark, rows))
    assert not re.search("Python|Arrow|Exchange", scanned._jdf.queryExecution().executedPlan().toString())
    assert {"doc_id", "text", "row__", "base", "hits"} <= set(scanned.columns)
    texts = dict(rows)
    found = scanned.collect()
    assert len(found) == len(rows)
    for r in found:
        n, places = brute_phrases(texts[r.doc_id])
        assert r.n_words == n and sorted((b.start, b.label) for b in r.base) == places
        assert sorted(map(tuple, r.hits)) == brute_hits(texts[r.doc_id])
    assert license_rules.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_there_are_hundreds_of_rules():
    rules = license_rules.signature_rules()
    assert len(rules) > 300 and len({r.priority for r in rules}) == 4


def test_runs_of_words_have_the_ids_of_the_words_and_long_words_are_not_kept():
    data = Path(sentencepiece_codec.MODEL_FILE).read_bytes()
    runs, single = (sentencepiece_codec.Codec(data) for _ in range(2))
    single.in_runs = False
    draw = random.Random(5)
    signs = [" ", "  ", "a", "b", "▁", "é", "中", "\n", "\0", "😀", "<s>", "<unk>", "the", "　"]
    texts = ["".join(draw.choices(signs, k=draw.randrange(40))) for _ in range(3000)]
    texts += ["", " ", "a " * 600, "中" * 5000, "x" * 200 + " y"]
    ids, same = runs.encode_batch(texts)
    assert (ids, same) == single.encode_batch(texts)
    assert ids == runs.library.encode(texts) and all(same)
    assert max(map(len, runs.memo)) <= sentencepiece_codec.LONG_WORD


def test_every_whole_text_is_compared_with_the_library(spark, monkeypatch):
    rows = [(i, f"some  words {i}") for i in range(1, 20)] + [(None, "no id"), (7, None), (7, "")]
    found = sentencepiece_codec.encode(docs_frame(spark, rows)).collect()
    assert [r.text_parity for r in found] == [True] * len(rows)
    assert {r.text_parity for r in sentencepiece_codec.encode(docs_frame(spark, rows), verify=False).collect()} == {None}
    data = Path(sentencepiece_codec.MODEL_FILE).read_bytes()
    codec = sentencepiece_codec.Codec(data, 1, True)
    texts = [t or "" for t in TEXTS]
    ids, same = codec.encode_whole(texts)
    assert ids == codec.library.encode(texts) and all(same)
    monkeypatch.setattr(codec, "normalise", lambda text: "▁" + text.replace("  ", " ").replace(" ", "▁"))
    assert codec.encode_whole(["some  words", "some words"])[1] == [False, True]
    assert codec.encode_batch(["some  words"])[1] == [True], "words cannot tell"


def test_distinct_words_of_a_portion_are_encoded_once(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "RUN_WORDS", 7)
    monkeypatch.setattr(sentencepiece_codec, "RUNS", 3)
    monkeypatch.setattr(sentencepiece_codec, "PART_CHARS", 500)
    monkeypatch.setattr(sentencepiece_codec, "PORTION_BYTES", 6000)
    codec = sentencepiece_codec.Codec(Path(sentencepiece_codec.MODEL_FILE).read_bytes(), 1)
    draw = random.Random(6)
    signs = [" ", " ", "  ", "a", "b", "▁", "é", "中", "\n", "\0", "😀", "<s>", "<unk>", " the", "　"]
    texts = ["".join(draw.choices(signs, k=draw.randrange(40))) for _ in range(2000)]
    texts += ["", None, " ", "x ", " x", "x\n", "\n x", "a  b", "▁", "one", "中" * 5000, "a " * 600 + "b", None]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts) + 2)), pa.array(["cut", *texts, "cut"])], names=["id", "text"])
    portions = list(sentencepiece_codec._portions(rows.slice(1, len(texts))))
    assert len(portions) > 5 and [i for p in portions for i in p.column(0).to_pylist()] == list(range(1, len(texts) + 1))
    parts = [part for p in portions for part in codec.encode_portion(p.column(1))]
    assert [t for part, _, _ in parts for t in part] == [t or "" for t in texts]
    assert [i.tolist() for _, ids, _ in parts for i in ids] == codec.library.encode([t or "" for t in texts])
    assert all(same for _, _, agree in parts for same in agree)

    class Counted:
        chars = 0

        def encode_batch_fast(self, texts, **options):
            self.chars += sum(map(len, texts))
            return tokenizer.encode_batch_fast(texts, **options)

    monkeypatch.setattr(sentencepiece_codec, "PORTION_BYTES", 1 << 20)
    tokenizer, codec.tokenizer = codec.tokenizer, Counted()
    same_words = pa.array(["some words of a text that come again"] * 500)
    ids = [i for _, ids, _ in codec.encode_portion(same_words) for i in ids]
    assert len(ids) == 500 and {tuple(i) for i in ids} == {tuple(codec.library.encode(same_words[0].as_py()))}
    assert 0 < codec.tokenizer.chars < 100
    codec.library.encode = lambda texts, **options: [[0] for _ in texts]
    odd = [(i.tolist(), same) for _, ids, agree in codec.encode_portion(same_words[:3]) for i, same in zip(ids, agree)]
    assert odd == [(ids[0].tolist(), False)] * 3
