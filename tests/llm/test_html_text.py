"""Blocks, the field against brute force, held-out pages, odd rows."""

import itertools
import math
import time

import numpy as np
import pytest

from lanternrank.llm import html_text as h
from lanternrank.llm import labelled_pages as lp
from lanternrank.llm import queries


@pytest.fixture(scope="module")
def field():
    return h.train(lp.labelled())


def texts(page):
    return [b.text for b in h.blocks_of(page)]


@pytest.mark.parametrize("page,want", [
    (None, []), ("", []), ("plain &amp; text", ["plain & text"]),
    ("<p>a<b>b</b>\n c<br>d<p>e&nbsp;f</p>g", ["ab c d", "e f", "g"]),
    ("<div>x<!-- y > z --><p>1 &lt; 2</p>&copy;</div>", ["x", "1 < 2", "©"]),
    ("<script>if (a<b) x='</p>';</script><style>p{}</style>t<textarea>no</textarea>", ["t"]),
    ("<ul><li>a<li>b</ul><td>c<td>d", ["a", "b", "c", "d"]), ("<a title='x>y'>l</a><p title=\"a>b\">m", ["l", "m"]),
    ("<p a='open>x</p>y", ["x", "y"]), ("<head><title>t</title><body>b", ["b"]), ("</p></div>a</b>b<", ["ab<"]),
    ("a<![CDATA[<c>]]>d<!DOCTYPE html><?x?>e", ["a<c>de"]), ("<script>never ends", []), ("<!-- never ends", []),
])
def test_blocks(page, want):
    assert texts(page) == want


def test_viterbi_is_the_best_labelling(field):
    draw = np.random.default_rng(0)
    for n in (1, 2, 5, 8):
        blocks = [h.Block("x", [f"f{draw.integers(6)}", "bias"]) for _ in range(n)]
        w = {f"f{k}": draw.normal() for k in range(6)} | {"bias": 0.1}
        f = h.Field(w, draw.normal(size=2), draw.normal(size=(2, 2)))

        def score(y, f=f, w=w, blocks=blocks):
            node = sum(sum(w[k] for k in b.features) for b, t in zip(blocks, y, strict=True) if t)
            return f.start[y[0]] + node + sum(f.moves[a, b] for a, b in zip(y, y[1:], strict=False))

        best = max(itertools.product([0, 1], repeat=n), key=score)
        assert math.isclose(score(tuple(map(int, f.decode(blocks)))), score(best))


def test_held_out_pages(field):
    pages = [lp.page_and_text(1000 + k) for k in range(200)]
    assert np.mean([h.extract(p, field) == t for p, t in pages]) > 0.95


WORDS = "The council met on Monday to talk about the new bridge over the river."
MORE = "It was the third meeting of this year, and many people came to listen."


@pytest.mark.parametrize("shape,want", [
    # Layouts that no training page has in this form.
    ("<article><p>{a}</p><p>{b}</p><div id='disqus_thread'><p>Nice text.</p><p>I agree with all of it.</p></div></article>", "{a}\n{b}"),
    ("<article><p>{a}</p><p>{b}</p><section class='reader-responses'><p>So true.</p><p>{b}</p></section></article>", "{a}\n{b}"),
    ("<div class='row'><div class='main-col'><p>{a}</p><p>{b}</p></div><div class='r-col'><h4>Latest</h4><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></div></div>", "{a}\n{b}"),
    ("<nav><a href='/'>Home</a></nav><div>{a}<br><br>{b}<br>{a}</div><footer>&copy; us</footer>", "{a} {b} {a}"),
])
def test_other_layouts(field, shape, want):
    page = f"<html><head><title>t</title></head><body>{shape}</body></html>".replace("{a}", WORDS).replace("{b}", MORE)
    assert h.extract(page, field) == want.replace("{a}", WORDS).replace("{b}", MORE)


def test_stray_and_open_tags_cost_no_more_than_their_number(field):
    began = time.process_time()
    page = "<i>" * 40_000 + "x" + "</u>" * 40_000 + "<p>y" * 2000 + "</i>" * 40_000
    assert texts(page)[:2] == ["x", "y"]
    assert time.process_time() - began < 5


def test_rows(spark, field):
    page = "<nav><a href='/'>Home</a></nav><article><h1>A title.</h1><p>One  &amp; two.</p></article><footer>c</footer>"
    long = "<article>" + "<p>Some words here.</p>" * 30_000 + "</article>"
    deep = "<div>" * 3000 + "x"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", long), (4, "x", deep), (5, "y", "<" * 50_000)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = h.main_text(df, field).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.url: r.text for r in got}
    assert by["u"] == "A title.\nOne & two." and by[None] == "" and by["v"] == ""
    assert by["w"] == "\n".join(["Some words here."] * 30_000)
    assert h.main_text(df.limit(0), field).count() == 0


def test_query(spark, tables):
    got = queries.op5_html_text(spark, tables).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{tables}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        article = pages[r.page_id].partition("<article>")[2].partition("</article>")[0]
        assert r.text == "\n".join(texts(article))
