"""Main texts of pages built from many templates, and of pages that are badly written."""

import random
import time

import numpy as np

from aeonframe.llm import html_text as H
from tests.llm import cases

WRAPPERS = ["<div class='layout has-sidebar'>{}</div>", "<div id=page class='site-wrapper search-page'>{}</div>", "<form id=aspnetForm>{}</form>", "{}", "<table><tr><td>{}</td></tr></table>"]
CONTENT = ["<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>", "<div id=story>{}</div>", "<section class='article-share-story'>{}</section>", "<div>{}</div>", "<main><article class='entry'><div class=body>{}</div></article></main>"]
MENUS = ["<nav><ul>{}</ul></nav>", "<div class=menu><ul>{}</ul></div>", "<ul id='main-nav'>{}</ul>", "<header><ul>{}</ul></header>"]
ASIDES = ["<aside>{}</aside>", "<div class='sidebar widget'>{}</div>", "<div class='related-links'>{}</div>", "<div class='cookie-notice'>{}</div>", "<div id='ad-top' class=ad>{}</div>", "<div class=newsletter>{}</div>"]
TALK = ["<section id=comments>{}</section>", "<div class='comment-list'>{}</div>", "<ol class=comments>{}</ol>"]
ENDS = ["<footer>{}</footer>", "<div id=footer>{}</div>", "<div class='site-footer legal'>{}</div>"]


def page(seed):
    """(html, blocks of its main text)."""
    r = random.Random(seed)
    prose = lambda n: " ".join(cases.passage(r.random(), n)).capitalize() + ", and so on."
    wanted = [prose(r.randint(3, 8)).replace(", and so on.", ""), *(prose(r.randint(15, 80)) for _ in range(r.randint(3, 7)))]
    body = f"<h1>{wanted[0]}</h1>" + "".join(f"<p>{x}" + r.choice(["</p>", ""]) for x in wanted[1:])
    links = "".join(f"<li><a href='/{i}'>{prose(2)[:14]}</a>" for i in range(r.randint(4, 9)))
    extra = lambda some: "".join(x.format(f"<p>{prose(r.randint(4, 25))}</p>") for x in r.sample(some, r.randint(1, 2)))
    talk = r.choice(TALK).format("".join(f"<div class=comment><p>{prose(r.randint(5, 30))}</p></div>" for _ in range(r.randint(1, 4))))
    inner = r.choice(MENUS).format(links) + extra(ASIDES) + r.choice(CONTENT).format(body) + extra(ASIDES) + talk + r.choice(ENDS).format(f"<p>{prose(8)}</p>")
    return f"<!DOCTYPE html><html><head><title>t</title><script>x('<p>')</script></head><body class='with-sidebar'>{r.choice(WRAPPERS).format(inner)}</body></html>", wanted


def test_precision_and_recall_over_templates(spark):
    made = {i: page(i) for i in range(80)}
    pages = spark.createDataFrame([(i, "u", h, "mine") for i, (h, _) in made.items()], "page_id long, url string, html string, text string")
    right = kept = there = 0
    for row in H.main_texts(pages).collect():
        found, wanted = row.text.split("\n"), made[row.page_id][1]
        right += sum(len(x) for x in found if x in wanted)
        kept += sum(map(len, found))
        there += sum(map(len, wanted))
    assert right / kept >= 0.97 and right / there >= 0.97, (right / kept, right / there)


def test_names_of_a_whole_page_and_open_quotes():
    weights = H.train([])
    prose = "Some good prose, long enough. It has commas."
    assert H.main_text(f'<body><div id="main-content" class="layout has-sidebar search-result"><p>{prose}</p></div>', weights) == prose
    assert H.main_text(f'<div class="article-share-story"><p>{prose}</p></div>', weights) == prose
    assert H.main_text(f'<p>{prose} <a href="x>hello</a> there', weights) == f"{prose} hello there"


def test_the_cut_teaches():
    r = np.random.default_rng(0)
    x = np.hstack([np.ones((40, 1)), r.normal(size=(40, len(H.FEATURES) - 1))])
    chain = [(i - 1, i, 3.0) for i in range(1, 40)]
    assert not np.allclose(H.train([(x, chain)]), H.train([(x, [])]))
    assert np.allclose(H.train([]), [H.PRIOR[f] for f in H.FEATURES])


def test_deep_nesting_is_linear():
    weights = H.train([])
    took = []
    for n in (10_000, 40_000):
        start = time.process_time()
        assert H.main_text("<div>" * n + "deep, deep text.", weights) == "deep, deep text."
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 1


def test_pages_of_nothing(spark):
    assert H.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
