"""Main text of web pages: a linear-chain CRF over DOM leaf blocks, trained on labelled pages and decoded by Viterbi.

A page's leaf blocks (``dom_blocks``) are labelled main or other.  Features are the names of the
ancestors (tags, and words of their class, id and role), and of the text its length, punctuation,
links, and its place in the page and among its neighbours.

Training pages are a bounded sample of the table: ``SAMPLE_PAGES`` pages of at most
``SAMPLE_CHARS`` characters, the first by a hash of their ids and urls, labelled by their only article or
main element.  Every second one is learned from once more without that element's
name, so that the model doesn't rest on it alone, and from each come two pages that hold the same texts in other layouts (headers, menus,
breadcrumbs, notices, adverts, sidebars, forms, comments, related links and footers around or
inside the article), which mark their main elements.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .dom_blocks import MARK, Block, leaf_blocks
from .tables import broadcast

SAMPLE_PAGES, SAMPLE_CHARS = 120, 1 << 15
#: blocks of a training page; longer ones are left out of the training (never of the extraction)
SAMPLE_BLOCKS = 120
OTHER, MAIN = 0, 1
#: ancestors that are not main text even inside an article
BESIDE = frozenset("<nav <aside <footer <form <menu ad ads advert advertisement sponsored promo banner sidebar related share social comment comments "
                   "cookie consent notice newsletter breadcrumb breadcrumbs toolbar".split())


def _grade(x: int, *steps: int) -> int:
    return sum(x >= s for s in steps)


def _own(b: Block, title: str) -> list[str]:
    words = b.text.count(" ") + 1
    stop = b.text[-1] in ".!?…。！？:;\"'”»)"
    size = _grade(words, 2, 4, 8, 16, 40)
    out = [f"words {size}", f"links {_grade(int(b.linked * 100), 1, 35, 99)}", f"stop {stop}", f"tag {b.tag}", f"size and stop {size} {stop}",
           f"tag and size {b.tag} {size}"]
    if b.text[0] in "©®™" or "©" in b.text[:40]:
        out.append("right sign")
    if b.text.count(",") > 1:
        out.append("commas")
    if title and (b.text == title or len(b.text) > 15 and (title.startswith(b.text) or b.text.startswith(title))):
        out.append("title")
    return out


def features(title: str, blocks: list[Block], without: frozenset = frozenset()) -> list[list[str]]:
    """The features of each block of a page; ancestors named in ``without`` are not told.

    Text inside an article or main element is told apart by whether something that stands beside
    main text (``BESIDE``) is among its ancestors.
    """
    own = [_own(b, title) for b in blocks]
    out = []
    for t, b in enumerate(blocks):
        f = ["any", *own[t], *[f"in {n}" for n in b.above if n not in without]]
        if b.inside and not without:
            f.append(f"article {BESIDE.isdisjoint(b.above)}")
        for side, k in (("before", t - 1), ("after", t + 1)):
            if 0 <= k < len(blocks):
                f += [f"{side} {own[k][0]}", f"{side} {own[k][3]}", f"{side} as deep {len(blocks[k].above) == len(b.above)}"]
            else:
                f.append(f"none {side}")
        out.append(f)
    return out


def steps_of(blocks: list[Block]) -> list[int]:
    """The kind of the step to each block: 1 from a sibling in the same element, else 0."""
    return [int(t > 0 and b.parent == blocks[t - 1].parent) for t, b in enumerate(blocks)]


def own_labels(blocks: list[Block]) -> list[int]:
    """Labels by the ``MARK`` attribute if the page has any, else by its article or main elements."""
    if any(b.marked for b in blocks):
        return [MAIN if b.marked else OTHER for b in blocks]
    return [MAIN if b.inside and not BESIDE.intersection(b.above) else OTHER for b in blocks]


_FALLBACK = ("Alder birch cedar, and elm grow by the water. In spring the leaves come late, but they stay long. "
             "Few paths lead here. Who walks them, hears little but wind and birds.").split(". ")


class _Layouts:
    """Labelled pages of other layouts from the texts of a page."""

    def __init__(self, seed: int, title: str, main: list[str], other: list[str]):
        self.rnd = random.Random(seed)
        self.title = title or "Home"
        self.long = [t for t in main if t.count(" ") >= 5] or _FALLBACK
        words = " ".join([*other, *self.long[:2]]).split()
        self.short = [" ".join(words[i:i + 2]) for i in range(0, min(len(words), 60), 2)] or ["Home"]

    def some(self, texts: list[str], least: int, most: int) -> list[str]:
        return [escape(self.rnd.choice(texts)) for _ in range(self.rnd.randint(least, most))]

    def named(self, tag: str, *names: str) -> str:
        """A start tag, with a class or id or neither."""
        return f"<{tag}>" if self.rnd.random() < 0.3 else f'<{tag} {self.rnd.choice(("class", "id"))}="{self.rnd.choice(names)}">'

    def links(self, least: int, most: int) -> str:
        items = [f'<a href="/{i}">{t}</a>' for i, t in enumerate(self.some(self.short, least, most))]
        if self.rnd.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.rnd.choice((" | ", " ")).join(items)

    def box(self, tags: str, names: str, body: str) -> str:
        tag = self.rnd.choice(tags.split())
        return f"{self.named(tag, *names.split())}{body}</{tag}>"

    def prose(self, least: int, most: int) -> str:
        return "".join(f"<p>{t}</p>" for t in self.some(self.long, least, most))

    def beside(self) -> str:
        """Something that is no main text, as it stands beside or inside an article."""
        person = lambda: f"<p>{self.rnd.choice(self.some(self.short, 1, 1))}</p>{self.prose(1, 2)}"
        return self.rnd.choice([
            lambda: self.box("div aside section", "ad ads advert sponsored ad-slot promo", self.rnd.choice(self.some(self.long, 1, 1)[0:1] + self.some(self.short, 1, 1))),
            lambda: self.box("aside div section", "sidebar side right-column widget", "<h3>" + self.some(self.short, 1, 1)[0] + "</h3>" + self.links(2, 6) + (self.prose(1, 1) if self.rnd.random() < 0.4 else "")),
            lambda: self.box("div section aside", "cookie-notice notice consent alert banner message", f"<p>{self.some(self.long, 1, 1)[0]}</p><button>OK</button>"),
            lambda: self.box("form", "newsletter subscribe search login", f"<label>{self.some(self.short, 1, 1)[0]}</label><input name=q><p>{self.some(self.long, 1, 1)[0]}</p><button>Go</button>"),
            lambda: self.box("div section", "related more recommended share social", "<h4>" + self.some(self.short, 1, 1)[0] + "</h4>" + self.links(2, 5)),
            lambda: self.box("section div", "comments comment-list responses discussion", "".join(self.box("div article", "comment reply", person()) for _ in range(self.rnd.randint(1, 4)))),
        ])()

    def body(self) -> str:
        """Marked main elements, with things beside them now and then."""
        mark, parts, rnd = f' {MARK}="1"', [], self.rnd
        if rnd.random() < 0.9:
            parts.append(f"<h1{mark}>{escape(self.title)}</h1>")
        for t in self.some(self.long, 1, 12):
            kind = rnd.random()
            if kind < 0.1:
                parts.append(f"<h2{mark}>{self.some(self.short, 1, 1)[0]}</h2>")
            elif kind < 0.16:
                parts.append(f"<ul{mark}>" + "".join(f"<li>{x}</li>" for x in self.some(self.long + self.short, 2, 4)) + "</ul>")
            elif kind < 0.22:
                parts.append(f"<blockquote{mark}><p>{t}</p></blockquote>")
            elif kind < 0.25:
                parts.append(f"<table{mark}><tr><td>{t}</td><td>{self.some(self.short, 1, 1)[0]}</td></tr></table>")
            elif kind < 0.3:
                parts.append(f"<figure{mark}><img src=a.png><figcaption>{self.some(self.short, 1, 1)[0]}</figcaption></figure>")
            elif kind < 0.45:
                parts.append(f"<p{mark}>{' '.join(self.some(self.short, 1, 3))[:rnd.choice((5, 99))]}{rnd.choice(('.', '', ':'))}</p>")
            else:
                parts.append(f"<p{mark}>{t}</p>")
            if rnd.random() < 0.12:
                parts.append(self.beside())
        tag = rnd.choice(["article", "article", "main", "div", "div", "section"])
        return self.named(tag, "content", "post", "entry-content", "story", "article-body", "text", "main-content") + "".join(parts) + f"</{tag}>"

    def page(self) -> str:
        rnd = self.rnd
        top = [self.box("header div", "header masthead top site-header", f"<a href=/>{self.some(self.short, 1, 1)[0]}</a><p>{self.some(self.short, 1, 1)[0]}</p>"
                        + (self.box("nav div", "nav menu navigation", self.links(2, 8)) if rnd.random() < 0.5 else "")),
               self.box("nav div", "nav menu navbar navigation main-menu", self.links(2, 8)),
               self.box("div nav", "breadcrumb breadcrumbs", self.links(2, 4))]
        parts = [x for x in top if rnd.random() < 0.6] + [self.beside() for _ in range(rnd.choice([0, 0, 1, 2]))]
        parts.append(self.body())
        parts += [self.beside() for _ in range(rnd.choice([0, 1, 1, 2, 3]))]
        if rnd.random() < 0.85:
            foot = self.rnd.choice([f"&copy; {self.some(self.short, 1, 1)[0]}", self.links(1, 5), f"<p>{self.some(self.long, 1, 1)[0]}</p>",
                                    f"&copy; {self.some(self.short, 1, 1)[0]} &middot; {self.some(self.long, 1, 1)[0]}"])
            parts.append(self.box("footer footer div", "footer bottom copyright site-footer", foot))
        inner = "".join(parts)
        if rnd.random() < 0.3:
            inner = self.box("div", "wrapper page container", inner)
        return f"<!DOCTYPE html><html><head><title>{escape(self.title)}</title></head><body>{inner}</body></html>"


def train(htmls: Iterable[str], layouts: int = 2) -> crf.Crf:
    """The model of labelled pages (see ``own_labels``; pages without any main block are left out).

    ``layouts`` pages of other layouts are made from each page's texts.
    """
    sequences, kinds, labels = [], [], []

    def learn(title: str, blocks: list[Block], without: frozenset = frozenset()) -> bool:
        own = own_labels(blocks)
        if not 0 < len(blocks) <= SAMPLE_BLOCKS or MAIN not in own:
            return False
        sequences.append(features(title, blocks, without))
        kinds.append(steps_of(blocks))
        labels.append(own)
        return True

    for i, html in enumerate([*htmls, ""]):
        title, blocks = leaf_blocks(html)
        if learn(title, blocks) and i % 2:
            learn(title, blocks, frozenset(("<article", "<main")))
        own = own_labels(blocks)
        for j in range(layouts):
            made = _Layouts(i * layouts + j, title, [b.text for b, y in zip(blocks, own) if y == MAIN], [b.text for b, y in zip(blocks, own) if y == OTHER])
            learn(*leaf_blocks(made.page()))
    return crf.fit(sequences, kinds, labels, n_kinds=2)


def sample_of(pages: DataFrame) -> list[str]:
    """The html of the sample: at most ``SAMPLE_PAGES`` pages of at most ``SAMPLE_CHARS`` characters.

    Hashes alone are ordered first, so that what a task sends to the driver doesn't hold pages.
    """
    rows = pages.where(F.length("html").between(1, SAMPLE_CHARS)).select("html", F.xxhash64(F.col("page_id").cast("string"), "url").alias("h"))
    first = [r.h for r in rows.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).collect()]
    if not first:
        return []
    return [r.html for r in rows.where(F.col("h") <= first[-1]).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()]


def extract(model: crf.Crf, html: str | None) -> str:
    """The main text of one page."""
    title, blocks = leaf_blocks(html) if isinstance(html, str) else ("", [])
    return "\n".join(b.text for b, y in zip(blocks, model.decode(features(title, blocks), steps_of(blocks))) if y == MAIN)


def main_texts(pages: DataFrame, model: crf.Crf | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html; others are not read): page_id, url, text, n_chars.

    ``text`` holds the main blocks in page order, joined by line ends; ``n_chars`` are its code
    points.  ``model`` defaults to one trained on a sample of ``pages``.

    Null and empty html has an empty text.  Null ids, null urls and repeated rows are rows like
    others; of sample pages with one id and url the least html counts.  Very long pages are read whole, in
    time and memory linear in their length.  An empty table gives an empty table.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    held = broadcast(pages.sparkSession, model or train(sample_of(rows)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [extract(held.value, h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    keyed = rows.withColumn("page_id", F.col("page_id").cast("string"))
    out = keyed.mapInPandas(run, "page_id string, url string, text string, n_chars bigint")
    return out.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))
