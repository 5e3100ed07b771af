"""Main text of pages: blocks, the random field against enumeration, held-out accuracy, odd input."""

from __future__ import annotations

import itertools
import random
import re
from html import unescape

import numpy as np
import pytest

from reviewlake.llm import crf, page_text, registry
from reviewlake.llm.dom_blocks import leaf_blocks

PAGE = "page_id long, url string, html string, text string, n_chars string"


def texts(html):
    return [b.text for b in leaf_blocks(html)[1]]


@pytest.mark.parametrize("html, want", [
    ("", []),
    ("plain", ["plain"]),
    ("<p>a<p>b</p>c", ["a", "b", "c"]),
    ("<p><b>a<br><p>b</p>", ["a", "b"]),
    ("<p>one <b>two</b>\n\t three<br>four</p>", ["one two three four"]),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("a &amp; b &lt;p&gt; &eacute;&#233;&#xe9; &am &amp", ["a & b <p> ééé &am &"]),
    ("1 < 2 <3", ["1 < 2 <3"]),
    ("<script>var t='</p>'; if (a<b) x('<p>');</script><p>a</p><style>p{}</style>", ["a"]),
    ("<p>a<!-- <p>b</p> --></p><!-- open <p>c", ["a"]),
    ('<p title="x > y">a</p><a href=\'<p>\'>b</a>', ["a", "b"]),
    ('<p title="never closed>a</p><p>b</p>', ["a", "b"]),
    ("<p>a</b></i></div>b</p>", ["a", "b"]),
    ("<P>A</P><DIV>b</DiV>", ["A", "b"]),
    ("<p>a</p><tag", ["a"]),
    ("<p>   </p><div>\n</div>", []),
    ("<textarea><p>x</textarea>y<noscript><p>z</noscript>", ["y"]),
])
def test_leaf_blocks(html, want):
    assert texts(html) == want


def test_blocks_of_long_and_deep_pages_are_linear():
    assert len(texts("<p>word" * 200_000)) == 200_000
    assert texts("<div>" * 100_000 + "x") == ["x"]
    assert texts('<a href="' * 50_000) == []
    assert len(texts("<b>" * 2000 + "<p>x</p>" * 2000)) == 2000


def test_field_against_enumeration():
    rng = np.random.default_rng(3)
    scores, move, start = rng.normal(size=(1, 5, 2)), rng.normal(size=(2, 2, 2)), rng.normal(size=2)
    kinds = np.array([[0, 1, 0, 0, 1]])

    def score(y):
        return start[y[0]] + sum(scores[0, t, y[t]] for t in range(5)) + sum(move[kinds[0, t], y[t - 1], y[t]] for t in range(1, 5))

    every = list(itertools.product((0, 1), repeat=5))
    weights = np.exp([score(y) for y in every])
    total, share, moves = crf.likelihood(scores, kinds, np.array([5]), move, start)
    assert total[0] == pytest.approx(np.log(weights.sum()))
    for t in range(5):
        assert share[0, t, 1] == pytest.approx(sum(w for w, y in zip(weights, every) if y[t]) / weights.sum())
    for k, a, b in itertools.product((0, 1), repeat=3):
        want = sum(w * sum(kinds[0, t] == k and y[t - 1] == a and y[t] == b for t in range(1, 5)) for w, y in zip(weights, every))
        assert moves[k, a, b] == pytest.approx(want / weights.sum())
    names = {f"{t}": t for t in range(5)}
    model = crf.Crf(names, scores[0], move, start)
    assert model.decode([[f"{t}", "unseen"] for t in range(5)], kinds[0]) == list(max(every, key=score))
    assert model.decode([], []) == []


def test_padding_changes_nothing():
    rng = np.random.default_rng(4)
    a, move, start = rng.normal(size=(1, 3, 2)), rng.normal(size=(1, 2, 2)), rng.normal(size=2)
    b = np.concatenate((a, np.zeros((1, 4, 2))), axis=1)
    short = crf.likelihood(a, np.zeros((1, 3), dtype=int), np.array([3]), move, start)
    padded = crf.likelihood(b, np.zeros((1, 7), dtype=int), np.array([3]), move, start)
    assert np.allclose(short[0], padded[0]) and np.allclose(short[1], padded[1][:, :3]) and np.allclose(short[2], padded[2])
    assert padded[1][:, 3:].sum() == 0


def test_fit_learns_a_rule():
    seqs = [[["x"] if i % 3 else ["y"] for i in range(n)] for n in range(1, 9)]
    labels = [[int(i % 3 == 0) for i in range(n)] for n in range(1, 9)]
    model = crf.fit(seqs, [[0] * len(s) for s in seqs], labels)
    assert all(model.decode(s, [0] * len(s)) == y for s, y in zip(seqs, labels))
    assert crf.fit([], [], []).decode([["x"]], [0]) == [0]


def article(html):
    inner = re.search(r"<article>(.*)</article>", html, re.S).group(1)
    parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in parts if x)


def test_query_on_given_pages(spark):
    path = "/root/testdata/sf0.01"
    got = registry.op11_main_text(spark, path)
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    pages = {r.page_id: r for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text) == (pages[r.page_id].url, article(pages[r.page_id].html)) and r.n_chars == len(r.text)


@pytest.fixture(scope="module")
def htmls(spark):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").orderBy("page_id").limit(700).collect()]


@pytest.fixture(scope="module")
def model(htmls):
    return page_text.train(htmls[:120])


def test_accuracy_on_held_out_layouts(model, htmls):
    both = told = true = 0
    for i, html in enumerate(htmls[200:600]):
        title, blocks = leaf_blocks(html)
        own = page_text.own_labels(blocks)
        made = page_text._Layouts(10 ** 6 + i, title, [b.text for b, y in zip(blocks, own) if y], [b.text for b, y in zip(blocks, own) if not y]).page()
        title, blocks = leaf_blocks(made)
        want, got = page_text.own_labels(blocks), model.decode(page_text.features(title, blocks), page_text.steps_of(blocks))
        both, told, true = both + sum(a and b for a, b in zip(want, got)), told + sum(got), true + sum(want)
    assert both / told > 0.96 and both / true > 0.96


def test_all_kinds_beside_an_article_go(model):
    rnd = random.Random(2)
    words = "the of and time year people way day man thing woman life child world school state".split()
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."
    keep = [line(n) for n in (6, 40, 25, 60)]
    beside = [f"<header><a href=/>Site</a><p>{line(4)}</p></header>", "<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>",
              f"<aside class=sidebar><h3>More</h3><p>{line(12)}</p></aside>", f'<div class="cookie-notice"><p>{line(15)}</p><button>OK</button></div>',
              f'<div class="ad">{line(10)}</div>', f"<form><label>Mail</label><input><p>{line(9)}</p><button>Go</button></form>"]
    after = [f'<section id="comments"><div class="comment"><p>Ann</p><p>{line(20)}</p></div><div class="comment"><p>Bo</p><p>{line(8)}</p></div></section>',
             f"<footer>&copy; {line(5)}</footer>"]
    body = f"<article><h1>{keep[0]}</h1>" + "".join(f"<p>{k}</p>" for k in keep[1:]) + "</article>"
    assert page_text.extract(model, "<html><head><title>T</title></head><body>" + "".join(beside) + body + "".join(after)) == "\n".join(keep)


def test_odd_pages(spark, model, htmls):
    long = "<html><body><nav><a href=/>Home</a></nav><article>" + "<p>Some words stand here, and they are many.</p>" * 20_000 + "</article><footer>&copy; x</footer>"
    rows = [(1, "u", htmls[0]), (1, "u", htmls[0]), (None, None, htmls[1]), (3, "v", None), (4, "w", ""), (5, "x", " \n"), (6, "y", long), (7, "z", "<p")]
    pages = spark.createDataFrame([r + ("clash", "clash") for r in rows], PAGE)
    got = {(r.page_id, r.url): r for r in page_text.main_texts(pages, model).collect()}
    assert page_text.main_texts(pages, model).count() == len(rows)
    assert got[(1, "u")].text == article(htmls[0]) and got[(None, None)].text == article(htmls[1])
    assert [got[k].text for k in ((3, "v"), (4, "w"), (5, "x"), (7, "z"))] == [""] * 4
    assert got[(6, "y")].text.count("\n") == 19_999 and got[(6, "y")].n_chars == len(got[(6, "y")].text)
    none = page_text.main_texts(spark.createDataFrame([], PAGE))
    assert none.collect() == [] and none.columns == ["page_id", "url", "text", "n_chars"]
