"""Main text where names, roles and elements mislead, on long pages, and against a scorer written out by hand."""

import math

from grainmill.llm import main_text
from grainmill.llm.main_text import extract, main_blocks

STORY = "A story, told in full; it has many words, and marks. " * 6
TEXT = STORY.strip()


def test_a_teaser_in_an_article_element_is_not_the_story():
    assert main_blocks(f"<body><div><p>{STORY}</p><p>{STORY}</p></div><article><p>Teaser card.</p></article>") == [TEXT, TEXT]


def test_wrappers_with_misleading_names():
    page = "<body><{0}><nav><a href=x>Home</a></nav><h1>Title of it</h1><p>{1}</p><p>{1}</p></{2}></body>"
    for opened in ("div class='page with-sidebar'", "div class='has-ads'", "div id='search-results'", "div class='sidebar'", "form action=x", "aside", "div role=form"):
        assert main_blocks(page.format(opened, STORY, opened.split()[0])) == ["Title of it", TEXT, TEXT]


def test_names_inside_an_article():
    page = (
        f"<article><h1>T</h1><p>{STORY}</p><p class='notice-board'>The notice board, said.</p><p id='share-prices'>Prices rose.</p><p class=ad>Buy now!</p>"
        "<ul>" + "".join(f"<li>point {k}" for k in range(20)) + "</ul><p hidden>unseen</p></article>"
        f"<div class='comment-list'><p>{STORY}</p><p>{STORY * 3}</p></div><aside><p>{STORY}</p></aside><div class=ad-slot><p>{STORY}</p></div><footer>c 2020</footer>"
    )
    assert main_blocks(page) == ["T", TEXT, "The notice board, said.", "Prices rose.", *[f"point {k}" for k in range(20)]]


def test_pages_without_article_beside_boilerplate():
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Menu entry {k}</a>" for k in range(30)) + "</ul>"
    body = "".join(f"<p>{STORY}</p>" for _ in range(5))
    assert main_blocks(f"<body><div>{menu}</div><div>{body}</div><div><span>All rights reserved</span></div></body>") == [TEXT] * 5


def test_fused_scores_by_hand():
    page = "<body><div><p>aa, bb. cc<p>dddd</div><div class=ad><p>ee!</div></body>"
    found = main_text.blocks(page)
    assert [(b.path, b.weight, b.text) for b in found] == [(("body", "div", "p"), 1.0, "aa, bb. cc"), (("body", "div", "p"), 1.0, "dddd"), (("body", "div", "p"), main_text.NAMED, "ee!")]
    ratio = [(10 + 4) / 2 * (1 + 2 / 2)] * 2 + [3 * (1 + 1)]
    near = [1, math.exp(-0.5), math.exp(-2)]
    want = [sum(near[abs(i - j)] * ratio[j] for j in range(3)) / sum(near[abs(i - j)] for j in range(3)) * found[i].weight for i in range(3)]
    assert all(math.isclose(a, b) for a, b in zip(main_text.scores(found), want, strict=True))
    assert main_blocks(page) == ["aa, bb. cc", "dddd"] and main_blocks(page, threshold=0.0) == ["aa, bb. cc", "dddd", "ee!"]


def test_very_long_pages_and_clashing_columns(spark):
    page = "<article>" + "".join(f"<p>Paragraph {k}, of many.</p>" for k in range(20_000)) + "</article>"
    pages = spark.createDataFrame([(1, "u", page, "x", 5, 6), (2, "v", "<p>" + "word " * 200_000, "y", 7, 8)], "page_id bigint, url string, html string, text string, n_chars int, n_blocks int")
    got = {r.page_id: r for r in extract(pages).collect()}
    assert got[1].n_blocks == 20_000 and got[1].text.endswith("Paragraph 19999, of many.") and got[2].n_chars == 200_000 * 5 - 1
