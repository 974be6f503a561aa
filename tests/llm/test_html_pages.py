"""Generated pages whose article is known, and pages that are hard to scan."""

import random
import time

import pytest

from codetally.llm import html_content

COMMENTS = ["comments", "comments-section", "comment-thread", "post-comments", "userComments", "disqus_thread", "replies"]
OTHERS = [
    "cookie-bar", "ad-sidebar", "related-stories", "site-footer", "page-header", "top-notice", "shareBox",
    "newsletter-signup", "search-form", "main-menu", "sponsored_links", "sideBar sidebar", "breadcrumb-trail",
]


def words(rng, n):
    return " ".join(rng.choice(["river", "stone", "of", "the", "light", "moves", "under", "old", "bridges"]) for _ in range(n))


def sentence(rng, n):
    return words(rng, n).capitalize() + ", " + words(rng, n // 2 + 1) + "."


def article(rng):
    """Tags and their texts: long and short blocks of all kinds."""
    blocks = [("h1", words(rng, 4)), ('p class="lead"', sentence(rng, 4))]
    for _ in range(rng.randrange(5, 12)):
        blocks.append(("p", sentence(rng, rng.randrange(12, 60))))
        kind = rng.randrange(6)
        if kind == 0:
            blocks += [("li", words(rng, 3)), ("li", words(rng, 2))]
        elif kind < 5:
            blocks.append((["blockquote", "td", "pre", "h2"][kind - 1], words(rng, 4)))
    blocks.append(("p", sentence(rng, 30)))
    return blocks


def page(rng, wrapper, share):
    blocks = article(rng)
    size = sum(len(t) for _, t in blocks)
    inner = ""
    for i, (tag, text) in enumerate(blocks):
        name = tag.split()[0]
        made = f"<{tag}>{text}</{name}>"
        made = f"<table><tr>{made}</tr></table>" if name == "td" else f"<ul>{made}</ul>" if name == "li" else made
        inner += made
    comments, made = "", 0
    while made < size * share / (1 - share):
        text = sentence(rng, rng.randrange(5, 60))
        comments += f'<div class="comment-body"><p>{text}</p></div>'
        made += len(text)
    side = "".join(
        f'<div class="{name}"><p>{sentence(rng, 12)}</p><a href="/">{words(rng, 2)}</a></div>'
        for name in rng.sample(OTHERS, 6)
    )
    menu = "<ul>" + "".join(f'<li><a href="/{i}">{words(rng, 2)}</a></li>' for i in range(6)) + "</ul>"
    before, after = wrapper
    html = (
        f"<html><head><title>{words(rng, 3)}</title></head><body class='with-sidebar comments-open'>{menu}{side}"
        f"{before}{inner}{after}<div id='{rng.choice(COMMENTS)}'>{comments}</div><footer>{sentence(rng, 20)}</footer></body></html>"
    )
    return html, "\n\n".join(t for _, t in blocks)


WRAPPERS = [
    ("<article>", "</article>"), ("<main>", "</main>"), ('<article class="post has-comments">', "</article>"),
    ("<div>", "</div>"), ('<div class="content no-sidebar"><section>', "</section></div>"), ('<div id="header"><div>', "</div></div>"),
]


@pytest.mark.parametrize("share", [0.1, 0.3, 0.5, 0.7, 0.9])
@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_generated_pages(wrapper, share):
    rng = random.Random(f"{wrapper}{share}")
    for _ in range(12):
        html, text = page(rng, wrapper, share)
        assert html_content.main_text(html) == text


@pytest.mark.parametrize("n", [4, 20])
def test_comments_go_whatever_their_size(n):
    post = "<div class='post'>" + "<p>Some text of the post, with a point.</p>" * 3 + "</div>"
    comments = "<div class='comments'>" + "<p>Some text of a reader, with a point.</p>" * n + "</div>"
    assert html_content.main_text(post + comments) == "\n\n".join(["Some text of the post, with a point."] * 3)
    nested = f"<article>{post}<article class='comment'><p>Reader, here.</p></article></article>"
    assert html_content.main_text(nested) == "\n\n".join(["Some text of the post, with a point."] * 3)


def test_short_blocks_between_long_ones_stay_without_an_article():
    long = "<p>" + "A long paragraph, with points. " * 9 + "</p>"
    short = '<p class="lead">Lead</p><ul><li>One</li></ul><blockquote>Quote</blockquote><table><tr><td>Cell</td></tr></table><pre>code</pre>'
    found = html_content.main_text(f"<body><div>{long}{short}{long}</div></body>").split("\n\n")
    assert found[1:-1] == ["Lead", "One", "Quote", "Cell", "code"]


@pytest.mark.parametrize(
    "value, kind",
    [
        ("comments", "comment"), ("userComments", "comment"), ("post_comments", "comment"), ("comments-open", ""),
        ("has-comments", ""), ("cookie-bar", "sure"), ("ad", "sure"), ("ad-free", ""), ("headline lead", ""),
        ("shadow adroit", ""), ("site-header", "open"), ("section-header", ""), ("related-work", "related"),
        ("post search", "open"), ("no-sidebar content", ""), ("ADS", "sure"), ("", ""), ("menuitem", ""),
    ],
)
def test_names(value, kind):
    assert html_content.kind_of([value]) == kind


@pytest.mark.parametrize(
    "bad", ["<b", "<d", '<b "', "<b '", '<b "> "', "<b \"'> ", "</p ", "<!-- ", "<script", "</script  ", '<div class="a', "<", "<a href='x>"]
)
@pytest.mark.parametrize("end", ["", ">", "'>", '">'])
def test_a_megabyte_of_open_tags_takes_a_second(bad, end):
    page = "<p>Text, here.</p>" + bad * (1_000_000 // len(bad)) + end
    start = time.process_time()
    html_content.main_text(page)
    assert time.process_time() - start < 5


def test_ends_of_tags():
    text = html_content.main_text
    assert text('<article><p title="a > b">One, two.</p></article>') == "One, two."
    assert text('<article><p title="a>One, two.</p></article>') == "One, two."
    assert text("<article><p>1 < 2, 3 > 2.</p></article>") == "1 < 2, 3 > 2."
    assert text("<article><p>One, two.</p><b") == "One, two.\n\n<b"
    assert text("<article><p x='>' y=\">\">One, two.</p><!-- no, no. ") == "One, two."
    assert text("<article><p>One, two.</p><p 'x' \"y>Three, four.</p></article>") == "One, two.\n\nThree, four."
