"""Block comments followed from line to line."""

import random

import pytest

import codetally as ct
from codetally.sources import dimensions as dims

FILES = "repo string, path string, content binary"
# path, content, kinds: blank, code, single, multi by their first letters
GOLDEN = [
    ("a.c", "/* a\nb\n\n*/ c\nd\n", "mmbmc"),
    ("b.c", "x /* a\nb */ y\nz\n", "cmc"),
    ("c.c", "// /* no\nx\n", "sc"),
    ("d.c", "/* // */\nx /* a */ /* b\n// */ y\nz\n", "mcmc"),
    ("e.c", "/* /* */ x\ny\n", "mc"),
    ("f.rs", "/* a /* b */\nc */ x\ny\n", "mmc"),
    ("g.hs", "{- a\n{- b\n-}\n-- c -}\nx\n", "mmmmc"),
    ("h.py", '"""doc\nbody\n"""\nx = 1\n# c\n', "mmmcs"),
    ("i.py", '"""doc"""\nx\n"""a\n', "mcm"),
    ("j.html", "<p>\n<!-- a\n b -->\n<p>\n", "cmmc"),
    ("k.json", "{\n\n}\n", "cbc"),
    ("l.zz", "/* a\nb\n", "cc"),
    ("m.c", "*/ x\n/* a", "cm"),
    ("n.c", "", ""),
    ("o.ml", "(* a (* b (* c\n*) *)\n*)\nlet x\n", "mmmc"),
    ("p.pas", "{ a\n b }\nx { c } y\n", "mmc"),
]
NAMES = {"b": "blank", "c": "code", "s": "single", "m": "multi"}


def kinds(frame):
    found = {}
    for r in sorted(frame.collect(), key=lambda r: (r["path"], r["pos"])):
        found.setdefault(r["path"], []).append(r["kind"])
    return found


def frame(spark, rows):
    return spark.createDataFrame([("r", p, bytearray(c if isinstance(c, bytes) else c.encode())) for p, c in rows], FILES)


def test_golden(spark):
    found = kinds(ct.lines_with_blocks(frame(spark, [(p, c) for p, c, _ in GOLDEN])))
    assert found == {p: [NAMES[k] for k in s] for p, _, s in GOLDEN if s}


def brute(path, text):
    ext = "." + path.rsplit(".", 1)[1]
    spec = next((x for x in reversed(dims.LANGUAGES) if ext in x[1]), None)
    depth, found = 0, []
    rows = text.split("\n")
    for line in rows[:-1] if rows[-1] == "" else rows:
        line = line.lstrip(" \t")
        _, _, single, opener, closer, nested = spec
        usual = "single" if any(map(line.startswith, single)) else "multi" if opener and line.startswith(opener) else "code"
        found.append("blank" if not line else "multi" if depth else usual)
        if opener and not (depth == 0 and usual == "single"):
            at = 0
            while at < len(line):
                hit = next((t for t in sorted({opener, closer}, key=len, reverse=True) if line.startswith(t, at)), None)
                if hit is None:
                    at += 1
                    continue
                at += len(hit)
                if opener == closer:
                    depth = 1 - depth
                elif hit == opener:
                    depth = min(depth + 1, 15) if nested else 1
                else:
                    depth = max(depth - 1, 0)
    return found


@pytest.fixture(scope="module")
def random_files():
    rng = random.Random(8)
    rows = []
    for i in range(150):
        ext = rng.choice([".c", ".rs", ".hs", ".py", ".html", ".rb", ".lua", ".json", ".ml"])
        spec = next(x for x in reversed(dims.LANGUAGES) if ext in x[1])
        tokens = [t for t in (*spec[2], spec[3], spec[4]) if t] + ["x", " ", "", "y y"]
        text = "\n".join(" ".join(rng.choices(tokens, k=rng.randrange(4))) for _ in range(rng.randrange(1, 400 if i < 5 else 25)))
        rows.append((f"f{i}{ext}", text + rng.choice(["", "\n"])))
    return rows


def test_random_texts(spark, random_files):
    found = kinds(ct.lines_with_blocks(frame(spark, random_files).repartition(3)))
    assert found == {p: brute(p, t) for p, t in random_files if brute(p, t)}


@pytest.mark.parametrize("row_bytes", [1, 13, 60])
def test_parts_are_as_the_whole(spark, random_files, row_bytes):
    files = frame(spark, [*random_files, ("bad.c", b"/*\n\xff\n" * 9)])
    cut = ct.cut_large_rows(files, row_bytes)
    assert kinds(ct.lines_with_blocks(cut)) == kinds(ct.lines_with_blocks(files))


def test_sums(spark):
    found = {r["language"]: r.asDict() for r in ct.stats_with_blocks(frame(spark, [(p, c) for p, c, _ in GOLDEN])).collect()}
    assert (found["C"]["multi"], found["C"]["blank"]) == ("".join(s for p, _, s in GOLDEN if p.endswith(".c")).count("m"), 1)
