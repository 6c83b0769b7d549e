from __future__ import annotations

import html
import itertools
import random
import re
import time

import pytest

from velospan.llm import page_cut
from velospan.llm.queries import QUERIES


def test_minimum_cut_equals_all_labellings():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 9)
        net = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(labels):
            own = sum(max(0, -x) if y else max(0, x) for x, y in zip(net, labels))
            return own + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(page_cut.minimum_cut(net, edges)) - best) < 1e-9


def test_pages_of_the_tables_give_their_articles(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = QUERIES["op5_page_cut"](spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        page = pages[r["page_id"]]
        inner = re.sub(r"<[^>]*\Z", "", page.split("<article>")[1].split("</article>")[0])
        parts = [re.sub(r"<[^>]+>", "", x.replace("<br>", " ")) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = [" ".join(html.unescape(x).split()) for x in parts]
        assert r["text"] == "\n".join(x for x in want if x) and r["n_chars"] == len(r["text"])


LONG = "A paragraph of the story that goes on for quite a while, as paragraphs of a story often do, until it ends."


def page(body: str) -> str:
    return f"<html><head><title>No</title><style>p{{}}</style></head><body class='has-sidebar'>{body}</body></html>"


def test_what_surrounds_an_article_goes():
    around = [
        '<nav><a href="/">Home</a> and more</nav>',
        f"<header><h1>Site</h1><p>{LONG}</p></header>",
        f'<div id="cookie-notice"><p>{LONG}</p></div>',
        f"<aside><h3>More</h3><p>{LONG}</p></aside>",
        f'<div class="sidebar left"><article><p>{LONG}</p></article></div>',
        f'<div class="advert">{LONG}</div>',
        f"<form><label>Mail</label><input><textarea>{LONG}</textarea><button>Send</button></form>",
        f'<section id="comments"><h2>Comments</h2><article class="comment"><p>{LONG}</p></article></section>',
        f'<div role="dialog">{LONG}</div>',
        f'<div style="display: none">{LONG}</div><p hidden>{LONG}</p>',
        f"<script>document.write('<p>{LONG}</p>')</script><noscript><p>{LONG}</p></noscript><!-- <p>{LONG}</p> -->",
        f"<footer><p>{LONG}</p></footer>",
    ]
    story = f"<h1>Title</h1><p>{LONG}</p><p>Yes.</p><p>No &lt;b&gt;\n\n of <b>it</b><i>self</i><br>ends.</p>"
    want = f"Title\n{LONG}\nYes.\nNo <b> of itself ends."
    for part in around:
        for wrap in ("<article>{}</article>", "<main><div>{}</div></main>", '<div class="post"><div class="content">{}</div></div>'):
            assert page_cut.main_text(page(part + wrap.format(story))) == want, part
            assert page_cut.main_text(page(wrap.format(story) + part)) == want, part
        assert page_cut.main_text(page(f"<article>{story}{part}</article>".replace("<header>", '<header class="masthead">'))) == want, part


def test_names_of_wrappers_do_not_remove_an_article():
    story = f"<h1>Title</h1><p>{LONG}</p><p>Yes.</p>"
    want = f"Title\n{LONG}\nYes."
    for name in ("layout has-sidebar", "with-sidebar", "no-comments", "side-nav-open", "page--has-sidebar", "sidebar-layout", "sidebar", "search"):
        for inner in ("<article>{}</article>", "<main>{}</main>", "<div><article>{}</article></div>"):
            assert page_cut.main_text(page(f'<div class="{name}">{inner.format(story)}</div>')) == want, (name, inner)
    for name in ("layout has-sidebar", "no-comments", "side-nav-open"):
        assert page_cut.main_text(page(f'<div class="{name}"><div class="content">{story}</div></div>')) == want, name
    for name in ("entry-header", "post-header", "header"):
        head = f'<article><div class="{name}"><h1>Title</h1></div><p>{LONG}</p><p>Yes.</p></article>'
        assert page_cut.main_text(page(head)) == want, name
    aside = f'<div class="sidebar"><article><p>{LONG}</p></article></div>'
    assert page_cut.main_text(page(f'<div class="with-sidebar">{aside}<article>{story}</article>{aside}</div>')) == want


def test_broken_and_empty_pages():
    assert page_cut.main_text(None) == page_cut.main_text("") == page_cut.main_text("<html><nav>x</nav>") == ""
    assert page_cut.main_text(f"<nav><a>x</a><article><p>{LONG}<p>{LONG} &am") == f"{LONG}\n{LONG} &am"
    assert page_cut.main_text(f"<article><p>{LONG}</p><p clas") == LONG
    assert page_cut.main_text("<article>" + f"<p>{LONG}</p>" * 3000).count("\n") == 2999


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "", "x"), (2, "u", f"<p>{LONG}</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    assert sorted(r["text"] for r in page_cut.extract(pages).collect()) == ["", "", "", LONG]
    assert page_cut.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("broken", ["<a ", '<a "', "<a", '<a ""', "<a '\"", "<!", "< ", "&", "<!--", "</", "<p>"])
def test_broken_markup_costs_no_more_than_its_length(broken):
    began = time.perf_counter()
    page_cut.main_text("<p>one two three</p>" + broken * (2_000_000 // len(broken)) + '">')
    assert time.perf_counter() - began < 30


def test_many_undecided_blocks():
    rng = random.Random(2)
    net = [rng.uniform(-0.3, 0.3) for _ in range(20_000)]
    began = time.perf_counter()
    kept = page_cut.minimum_cut(net, [(i, i + 1, 0.9) for i in range(len(net) - 1)])
    assert time.perf_counter() - began < 60 and 0 < sum(kept) < len(net)
