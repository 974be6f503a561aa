"""URL verdicts, archives, HTML extraction, vectors and preference pairs."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codetally.llm import hnsw, html_content, preferences, url_filter, warc

PAGES = "page_id long, url string, html string, h int, block int, w0 int, maybe int, rule int, revisit int, key int"


def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows], PAGES)


def test_urls(spark):
    rules = [url_filter.Rule("net", "/", "block"), url_filter.Rule("example.net", "/en/", "allow")]
    urls = {
        1: ("https://WWW.Example.NET/en/1?q#f", "www.example.net", "/en/1", "example.net/en/", "allow"),
        2: ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        3: ("http://notnet/x", "notnet", "/x", None, "allow"),
        4: (None, "", "", None, "allow"),
        5: ("no scheme/x", "", "", None, "allow"),
        6: ("http://bad.example/a/?utm_source=x&b=2&a=1#t", "bad.example", "/a/", None, "block"),
        7: ("://h?x", "h", "", None, "allow"),
        8: ("a://b://c/d", "b:", "//c/d", None, "allow"),
        9: ("http://example.org/" + "long/" * 5000, "example.org", "/" + "long/" * 5000, None, "allow"),
    }
    rows = [(i, u[0], "x") for i, u in urls.items()]
    listed = spark.createDataFrame([("https://www.bad.example/a?a=1&b=2",), (None,), ("https://www.bad.example/a?a=1&b=2",)], "url string")
    judged = url_filter.judge_urls(pages_frame(spark, rows + [rows[5]]), listed, rules).collect()
    assert len(judged) == len(rows) + 1
    for r in judged:
        assert (r.url, r.host, r.path, r.rule, r.verdict) == urls[r.page_id]
        assert (r.h, r.block, r.w0, r.maybe, r.key) == (1, 2, 3, 4, 7)
    nothing = url_filter.judge_urls(pages_frame(spark, rows), listed.limit(0), []).collect()
    assert {r.verdict for r in nothing} == {"allow"}
    assert url_filter.judge_urls(spark.createDataFrame([], PAGES), listed, rules).count() == 0


def test_bloom_filter_has_no_false_negative(spark):
    listed = spark.range(3000).selectExpr("concat('http://h.example/', id) AS url")
    pages = spark.range(6000).selectExpr("id AS page_id", "concat('http://h.example/', id, '/') AS url")
    judged = url_filter.judge_urls(pages, listed, []).collect()
    assert {r.page_id for r in judged if r.verdict == "block"} == set(range(3000))
    blocks, n = url_filter.bloom_blocks(listed.select(url_filter.canonical_url("url").alias("canonical")))
    assert n == 256 and blocks.count() <= n


def test_archive_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 5}.example/{i % 30}", f"page {i % 40} " * rng.randrange(1, 3)) for i in range(120)]
    rows += [(200 + i, "http://hot.example/", "same") for i in range(90)]
    rows += [(400, None, None), (401, "odd url\r\n", ""), (402, "x://y", "ä" * 50_000), (403, None, None)]
    rows += [rows[5], (None, "http://null.example/", "same"), (None, "http://null.example/", "only here")]
    pages = pages_frame(spark, rows)
    archive = warc.write_archive(pages, lines_per_block=7)
    found = warc.read_back(spark, archive, warc.url_keys(pages)).collect()
    best = {}
    for i, _, html in rows:
        if i is not None:
            best[html or ""] = max(best.get(html or "", -1), i)
    expected = []
    for i, _, html in rows:
        data, winner = (html or "").encode(), best.get(html or "")
        response = winner is None or i == winner
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected.append((i, len(data), digest, "response" if response else "revisit", None if response else winner))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    some = warc.read_back(spark, archive, spark.createDataFrame([("example,hot)/",), ("zzz",), (None,)], "key string"))
    assert some.count() == 90
    one = warc.lookup(spark, archive, spark.createDataFrame([("example,h1)/1",)], "key string")).where("page_id = 91")
    assert warc.read_records(spark, archive, one).first().payload.decode().startswith("page 11 ")


def test_empty_archive(spark):
    pages = spark.createDataFrame([], PAGES)
    archive = warc.write_archive(pages)
    assert warc.read_back(spark, archive, warc.url_keys(pages)).count() == 0
    keys = spark.createDataFrame([("a",)], "key string")
    assert warc.lookup(spark, archive, keys).count() == 0


def test_small_payloads_are_never_revisits(spark):
    pages = pages_frame(spark, [(1, "a://b", "x"), (2, "a://b", "x"), (3, "a://c", "long enough"), (4, "a://c", "long enough")])
    kinds = {r.page_id: r.revisit for r in warc.with_revisits(pages.select("page_id", "url", "html"), 5).collect()}
    assert kinds == {1: False, 2: False, 3: True, 4: False}


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<nav>menu</nav>", ""),
        ("just text &amp; more", "just text & more"),
        (
            "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li>Home<li>About</ul></nav>"
            "<div class='ad'>Buy now, friends.</div><article><h1>Title</h1><p><b>One, two.<br><p>Three&nbsp;\n four &eacute;."
            "<p>Hm.</p><aside>side note, long.</aside><section id=comments><p>First! Nice, really.</p></section></article>"
            "<footer>&copy; me, you, all.</footer></body></html>",
            "Title\n\nOne, two.\n\nThree four é.\n\nHm.",
        ),
        (
            "<body><div class=header>Site, name.</div><div class=content><h2>Head</h2><p>" + "Long text, with points. " * 20
            + "</p><p>" + "More text, again. " * 20 + "</p></div><div id='sidebar'><a href=x>Links, links, links.</a></div></body>",
            "Head\n\n" + ("Long text, with points. " * 20).strip() + "\n\n" + ("More text, again. " * 20).strip(),
        ),
        ("<article><p>cut off, <b>in the mid", "cut off, in the mid"),
        ("<nav><ul><li>open menu<article><p>Body, here.</article>", "Body, here."),
    ],
)
def test_main_text(html, text):
    assert html_content.main_text(html) == text


@pytest.mark.parametrize(
    "before, after",
    [
        ('<article class="post has-sidebar">', "</article>"),
        ('<main class="with-sidebar" id="search">', "</main>"),
        ('<main><section class="related-work">', "</section></main>"),
        ('<div class="social"><div id="page_header">', "</div></div>"),
        ('<div class="widget"><article>', "</article></div>"),
    ],
)
def test_names_of_noise_on_main_parts(before, after):
    body = "Long text, with points. " * 20
    page = f'<body><div class="sidebar">Side, note.</div>{before}<div class="section-header"><h2>Head</h2></div><p>{body}</p>'
    page += f'<div class="share-buttons">Share, now.</div>{after}<div class="site-footer">Site, end.</div></body>'
    assert html_content.main_text(page) == "Head\n\n" + body.strip()


def test_long_comments_beside_an_article_are_noise():
    page = "<article><p>Short text, this.</p></article><div class='comments'>" + "<p>I say, more. And more.</p>" * 30 + "</div>"
    assert html_content.main_text(page) == "Short text, this."


@pytest.mark.parametrize(
    "first, last, end",
    [("<section>", "<section>", "</section>"), ("<div id=a>", "<div id=b>", "</div>"), ("<article>", "<article>", "</article>")],
)
def test_short_parts_beside_a_long_one(first, last, end):
    texts = [f"Part {i}, with long text. " * 8 for i in range(20)] + ["Last part, shorter, but text. " * 9]
    page = f"<body><nav>Home, About.</nav>{first}" + "".join(f"<p>{t}</p>" for t in texts[:-1]) + f"{end}{last}<p>{texts[-1]}</p>{end}</body>"
    assert html_content.main_text(page) == "\n\n".join(t.strip() for t in texts)
    page = page.replace("<body>", "<body><main>").replace("<nav>", "<p>Hm.</p><nav>")
    assert html_content.main_text(page) == "\n\n".join(["Hm.", *(t.strip() for t in texts)])


def test_deep_and_odd_pages():
    assert html_content.main_text("<div>" * 20_000 + "deep, text." + "</div>" * 20_000) == "deep, text."
    assert html_content.main_text("</p></x><<a < b, c. <p title='") is not None
    long = "<article>" + "<p>word, word.</p>" * 20_000 + "</article>"
    assert html_content.main_text(long).count("\n\n") == 19_999


def test_extract(spark):
    rows = [(1, "u", "<article><p>A, b.</p></article>"), (1, "u", None), (None, None, "x, y.")]
    found = html_content.extract_main_text(pages_frame(spark, rows), ["page_id", "url"])
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(1, "u", "A, b.", 5), (1, "u", "", 0), (None, None, "x, y.", 5)]))
    assert html_content.extract_main_text(spark.createDataFrame([], PAGES), ["page_id"]).count() == 0


def brute_vectors(rows):
    usable = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[k] = np.array(v, float) / np.linalg.norm(v)
    links = {k: [j for j in usable if j != k and len(usable[j]) == len(usable[k]) and usable[j] @ usable[k] >= 0.9 - 1e-12] for k in usable}
    result = []
    for k, (i, _) in enumerate(rows):
        reached, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in reached:
                    reached.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in reached if rows[j][0] is not None), default=None)
        result.append((i, None, None, None) if i is None else (i, len(links.get(k, ())), least, least == i))
    return sorted(map(str, result))


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    x = [centres[i % 60] + rng.normal(size=16) * rng.choice([0.02, 0.3, 2.0]) for i in range(500)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(600 + i, rows[0][1]) for i in range(5)] + [(700, [2 * c for c in rows[1][1]])]
    rows += [(800, None), (801, []), (802, [0.0] * 16), (803, [None] * 16), (804, [float("nan")] * 16), (805, [float("inf")] * 16)]
    rows += [(806, [1.0, 0.0]), (807, [0.99, 0.01]), (None, rows[0][1])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, shard int, node string")
    found = hnsw.similar_vectors(frame)
    assert sorted(map(str, map(tuple, found.collect()))) == brute_vectors(rows)
    assert hnsw.similar_vectors(frame.limit(0)).count() == 0


def test_recall_of_a_graph():
    rng = np.random.default_rng(2)
    x = hnsw.unit_vectors(np.repeat(rng.normal(size=(700, 32)), 4, axis=0) + 0.12 * rng.normal(size=(2800, 32)))
    graph = hnsw.Graph(x)
    rows, nodes = graph.links_of(x, graph.audited_width(0.9), 0.9)
    wanted = x @ x.T >= 0.9
    found = np.zeros_like(wanted)
    found[rows, nodes] = True
    assert not (found & ~wanted).any() and (found & wanted).sum() >= 0.98 * wanted.sum()


def test_audit_of_dense_groups(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    pairs = np.repeat(np.repeat(centres, 1000, axis=0) + 0.0525 * rng.normal(size=(4000, 64)), 2, axis=0)
    x = hnsw.unit_vectors(pairs + 0.025 * rng.normal(size=pairs.shape))[rng.permutation(8000)]
    n, sample = 2000, np.arange(0, 8000, 8)
    graph = hnsw.Graph(x[:n])
    own = np.where(np.arange(8000) < n, np.arange(8000), -1)
    wanted = x @ x[:n].T >= 0.9
    wanted[np.arange(n), np.arange(n)] = False
    assert np.median((x @ x[:n].T >= 0.8).sum(axis=1)) > 100 and 0.5 < wanted.sum(axis=1).mean() < 5

    def recall():
        rows, nodes = graph.links_of(x, graph.audited_width(0.9, x[sample], own[sample]), 0.9)
        found = np.zeros_like(wanted)
        found[rows, nodes] = True
        return (found & wanted).sum() / wanted.sum()

    assert recall() >= 0.998
    # A search that finds each vector itself and nothing else fails the audit at every width.
    monkeypatch.setattr(
        graph, "search",
        lambda q, width: (np.argmax(q @ x[:n].T, axis=1)[:, None], (q @ x[:n].T).max(axis=1, keepdims=True) * [[1.0]] - 0.5),
    )
    assert recall() == 1


def test_preferences(spark):
    schema = "pair_id long, turn long, role string, text string, part string, position int, chosen int"
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "good")]
    rejected = [*chosen[:3], (1, 3, "assistant", "bad"), (1, 4, "user", "so?"), (2, 5, "user", "only"), (None, 1, "user", "x")]
    chosen += [(3, 7, "user", "same"), (3, None, "system", None), (3, 7, "user", "same")]
    rejected += [(3, 9, "user", "same"), (3, 1, "system", "")]
    frames = [spark.createDataFrame([(*r, "p", 1, 2) for r in rows], schema) for rows in (chosen, rejected)]
    parts = preferences.format_preferences(*frames)
    texts = {r.pair_id: (r.prompt, r.chosen, r.rejected) for r in preferences.assemble(parts).collect()}
    turn = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    prompt = turn("user", "q") + turn("assistant", "a") + turn("user", "r")
    assert texts == {
        1: (prompt, turn("assistant", "good"), turn("assistant", "bad") + turn("user", "so?")),
        2: ("", "", turn("user", "only")),
        3: (turn("system", "") + turn("user", "same"), "", ""),
    }
    for r in parts.collect():
        whole = texts[r.pair_id][["prompt", "chosen", "rejected"].index(r.part)]
        assert whole[r.start : r.stop] == r.rendered
        assert r.trained == (r.part != "prompt" and r.role == "assistant")
    assert preferences.format_preferences(frames[0].limit(0), frames[1].limit(0)).count() == 0


def test_a_very_long_conversation(spark):
    turns = spark.range(3000).selectExpr("1L AS pair_id", "id AS turn", "'user' AS role", "cast(id AS string) AS text")
    other = turns.selectExpr("pair_id", "turn", "role", "if(turn = 2000, 'x', text) AS text")
    parts = preferences.format_preferences(turns, other)
    counts = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    assert counts == {"prompt": 2000, "chosen": 1000, "rejected": 1000}
    ends = {r.part: r.stop for r in parts.groupBy("part").agg({"stop": "max"}).withColumnRenamed("max(stop)", "stop").collect()}
    assert ends["prompt"] == sum(len(f"<|user|>\n{i}<|end|>\n") for i in range(2000))


def test_worse_versions_over_buckets(spark):
    said = {(c, i): ("assistant" if i % 3 == 1 else "user", f"{c} says {i}") for c, n in ((1, 700), (2, 257), (3, 1)) for i in range(n)}
    turns = spark.createDataFrame([(c, i, *t) for (c, i), t in said.items()], "conv_id long, turn long, role string, text string")
    replies = {c: sorted(i for (k, i), t in said.items() if k == c and t[0] == "assistant") for c in (1, 2, 3)}
    late = {(c, i) for c, at in replies.items() for n, i in enumerate(at, 1) if 2 * n > len(at)}
    worse = {k: (t[0], said[k[0], k[1] - 1][1] if k in late else t[1]) for k, t in said.items()}
    assert any(i % preferences.BUCKET == 0 for _, i in late)
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in preferences.echoing(turns.repartition(7)).collect()}
    assert got == worse


def test_turns_without_numbers_are_spread(spark):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows = [(1, None if i % 10 else i, rng.choice(["user", "assistant"]), " ".join(rng.choices(words, k=6)) + f" {i}") for i in range(5000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    turns = preferences.turns_in_order(frame, "conv_id", "turn", "role", "text").collect()
    expected = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3].encode()))
    assert [(r.role, r.text) for r in sorted(turns, key=lambda r: r.position)] == [(r[2], r[3]) for r in expected]
    assert sorted(r.position for r in turns) == list(range(5000))
    spread = preferences.running_sum(frame, ["conv_id"], ["turn", "role", "text"], F.lit(1), "n")
    plan = spread._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring(role") and plan.count("substring(text")
