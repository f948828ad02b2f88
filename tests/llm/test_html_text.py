import random
import time

from tracewell.llm import html_text as h

TREE = h.train(h.LABELLED)
WORDS = "and then some more words follow that make this a paragraph of the kind that articles have in them"


def test_tree_fits_its_table():
    assert all(h.decide(TREE, r[:-1]) == r[-1] for r in h.LABELLED)


def test_parts_that_are_not_the_article_go():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style><script>var a = "</p><p>{WORDS}";</script></head><body>
<header><h2>Site</h2><a href="/">Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies. {WORDS}</p></div><div class="ad">Buy {WORDS}</div>
<article><header><h1>Head&eacute;</h1></header><p>First&nbsp;&amp; <b>bold</b>\n  {WORDS}<br>more<p>Short.<!-- <p>hidden {WORDS}</p> -->
<aside><p>Side {WORDS}</p></aside><form><label>Mail {WORDS}</label><input></form><p class="notice">Note {WORDS}<p>Last {WORDS} &lt;p&gt;</p>
<section id="comments"><p>Reader says {WORDS}</p></section></article>
<div class="sidebar widget"><p>{WORDS}</p></div><footer><p>&copy; {WORDS}</p></footer></body></html>"""
    assert h.main_text(page, TREE) == f"Headé\n\nFirst & bold {WORDS} more\n\nShort.\n\nLast {WORDS} <p>"


def test_pages_without_article_go_by_words_links_and_neighbours():
    page = f"""<body><div><a>Home</a> <a>News</a> <a>About</a></div><div><h1>A heading</h1><p>{WORDS} {WORDS}</p><p>Between.</p><p>{WORDS} {WORDS}</p></div>
<ul><li><a>link one</a></li><li><a>link two</a></li><li><a>link three</a></li></ul><div>All rights reserved</div></body>"""
    assert h.main_text(page, TREE) == f"A heading\n\n{WORDS} {WORDS}\n\nBetween.\n\n{WORDS} {WORDS}"


def test_wrappers_named_as_something_else_keep_the_article():
    text, around = f"<h1>Headline</h1><p>{WORDS}</p><p>{WORDS} {WORDS}</p>", "<nav><a>One</a></nav>{}<footer><p>Imprint and more</p></footer>"
    want = f"Headline\n\n{WORDS}\n\n{WORDS} {WORDS}"
    side = f'<div class="sidebar"><p>{WORDS}</p></div><section id="comments"><article><p>{WORDS} {WORDS}</p></article></section>'
    for page in (
        f'<div class="content-sidebar-wrap"><main>{text}</main>{side}</div>',
        f'<div class="has-sidebar"><article>{text}</article>{side}</div>',
        f'<div class="no-sidebar">{text}</div>',
        f'<div class="sidebar-left"><article>{text}</article>{side}</div>',
        f'<div class="sidebar-left"><div>{text}</div></div>',
        f'<form id="aspnetForm"><div><article>{text}</article></div></form>',
        f'<form action="/"><div class="top"><div>{text}</div></div></form>',
        f'<article data-title="The hidden cost of rent">{text}</article>',
        f'<article data-style="display:none" title=\'x aria-hidden="true"\'>{text}</article>',
        f'<article class="md hidden lg">{text}</article>',
        f'<div data-note="class=advert">{text}</div>',
    ):
        assert h.main_text(f"<body>{around.format(page)}</body>", TREE) == want, page


def test_parts_that_hold_no_article_still_go():
    article = f"<article><h1>Headline</h1><p>{WORDS}</p></article>"
    for page in (
        f'<div hidden><main><p>{WORDS}</p></main></div>{article}',
        f"<div style='color:red; display: none'><article><p>{WORDS} {WORDS}</p></article></div>{article}",
        f'<div aria-hidden="true"><p>{WORDS} {WORDS}</p></div>{article}',
        f'{article}<section id="comments"><article><p>{WORDS} {WORDS} {WORDS}</p></article></section>',
        f'{article}<div class="related"><article><p>{WORDS}</p></article></div>',
        f'{article}<div class="sidebar"><p>{WORDS} {WORDS} {WORDS}</p></div>',
    ):
        assert h.main_text(f"<body>{page}</body>", TREE) == f"Headline\n\n{WORDS}", page


def test_broken_markup():
    for page in ("", "<", "<p", "a < b", "<p>x</div></p></article>", "<script>never closed", "<!-- never closed", "<p title='>", "<article>" * 50, "</" * 20):
        assert isinstance(h.main_text(page, TREE), str)
    assert h.main_text(None, TREE) == ""


def test_long_broken_markup_takes_linear_time():
    began = time.perf_counter()
    for page in ('<a b="' * 40_000, '<a b="x>"' * 40_000, "<" * 200_000, "<a" * 100_000, "<!" * 100_000, "<!--" * 50_000, "<a '" * 40_000 + ">", "</" * 100_000 + ">", "<script " * 40_000, "<div>" * 20_000 + "</p>" * 20_000, f'<p a="><p>{WORDS}</p>' * 2_000):
        assert isinstance(h.main_text(page, TREE), str)
    assert time.perf_counter() - began < 20


def plain(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(n))


def generated(rng):
    """A page whose parts have no telling names or tags, and its article."""
    link = lambda n: f"<a href='/x'>{plain(rng, n)}</a>"
    head, paragraphs = plain(rng, rng.randint(3, 9)), [plain(rng, rng.randint(22, 120)) for _ in range(rng.randint(3, 9))]
    menu = "".join(f"<div>{link(rng.randint(1, 3))}</div>" for _ in range(rng.randint(4, 9)))
    more = "".join(f"<li>{link(rng.randint(2, 6))}</li>" for _ in range(rng.randint(3, 6)))
    body = f"<h1>{head}</h1>" + "".join(f"<p>{x}</p>" for x in paragraphs)
    page = f"<div><div>{menu}</div><div class=x1>{body}</div><div><ul>{more}</ul></div><div>{plain(rng, 5)} {link(2)}</div></div>"
    return page, "\n\n".join([head, *paragraphs])


def test_pages_of_known_text_without_names():
    """Words, links and neighbours decide where containers tell nothing."""
    rng = random.Random(12)
    pages = [generated(rng) for _ in range(200)]
    assert all(b.hint == 0 for page, _ in pages for b in h.blocks(page))
    assert sum(h.main_text(page, TREE) == text for page, text in pages) >= 190


def test_pages_of_known_text_with_names():
    rng = random.Random(13)
    for _ in range(100):
        paragraphs = [plain(rng, rng.randint(1, 90)) for _ in range(rng.randint(1, 12))]
        aside = [f'<div class="{rng.choice(["ad", "cookie-notice", "sidebar", "comments", "related"])}"><p>{plain(rng, rng.randint(1, 60))}</p></div>' for _ in range(3)]
        body = "".join(f"<p>{x}</p>" + (f'<aside><p>{plain(rng, 9)}</p></aside>' if rng.random() < 0.2 else "") for x in paragraphs)
        page = f"<nav><a>{plain(rng, 2)}</a></nav>{aside[0]}<article>{body}</article>{aside[1]}{aside[2]}<footer>{plain(rng, 30)}</footer>"
        assert h.main_text(page, TREE) == "\n\n".join(paragraphs)


def test_rows(spark):
    rows = [(1, "u", f"<article><p>{WORDS}</p></article>"), (1, "u", f"<article><p>{WORDS}</p></article>"), (2, None, None), (None, "v", ""), (3, "w", "<article><p>" + "word " * 100_000 + "</p></article>")]
    pages = spark.createDataFrame([(*r, "text", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in h.extract(pages).collect()}
    assert h.extract(pages).count() == 5 and got[1, "u"] == (WORDS, len(WORDS)) and got[2, None] == ("", 0) and got[None, "v"] == ("", 0) and got[3, "w"][1] == 499_999
    assert h.extract(pages.limit(0)).count() == 0
