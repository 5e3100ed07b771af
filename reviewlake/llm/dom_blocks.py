"""Leaf blocks of an HTML page: runs of text between block-level tags, with what their ancestors are.

One forward scan with a stack of open elements; unclosed, crossed and stray tags are closed as
browsers do for the common cases.  Work and memory are linear in the page's length.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
 figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search
 section select summary table tbody td tfoot th thead tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose text is none of the page's
SILENT_TAGS = frozenset("script style noscript template title textarea svg math iframe object canvas audio video".split())
#: a start tag ends open elements of these kinds, up to the nearest of the second kind
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
        "option": ({"option"}, {"select"})}
#: the attribute by which a labelled page marks its main elements
MARK = "data-main"

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?])")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TOKEN = re.compile(r"[A-Za-z]+")


@dataclass
class Block:
    text: str            # references decoded, white space as one space, trimmed
    tag: str             # the innermost block-level element
    above: tuple         # the names of all ancestors: tags, and the words of their class, id and role
    linked: float        # share of the characters inside links
    marked: bool         # inside an element with the ``MARK`` attribute
    inside: bool         # inside an article or main element
    parent: int          # the element that holds the innermost block-level one, as a number of its own in the page


class _Stack:
    def __init__(self):
        self.items = [("", (), False, False, 0)]     # tag, names above, marked, inside, number
        self.count = Counter()
        self.pushed = 0

    def push(self, tag: str, attributes: str) -> None:
        _, above, marked, inside, _ = self.items[-1]
        self.pushed += 1
        names = [f"<{tag}"]
        for value in _NAMED.findall(attributes) if attributes else ():
            names += [w.lower() for w in _TOKEN.findall(value)]
        new = [n for n in dict.fromkeys(names) if n not in above]
        self.items.append((tag, above + tuple(new) if new else above, marked or MARK in attributes, inside or tag in ("article", "main"), self.pushed))
        self.count[tag] += 1

    def cut(self, at: int) -> None:
        for tag, *_ in self.items[at:]:
            self.count[tag] -= 1
        del self.items[at:]

    def end(self, tag: str) -> None:
        """An end tag: closes the innermost element of its name; an inline one reaches no further than its block."""
        if self.count[tag] <= 0:
            return
        for at in range(len(self.items) - 1, 0, -1):
            own = self.items[at][0]
            if own == tag:
                return self.cut(at)
            if own in BLOCK_TAGS and tag not in BLOCK_TAGS:
                return None

    def implied(self, tag: str) -> None:
        """What the start of a block-level element ends by itself."""
        if self.count["p"] > 0:
            for at in range(len(self.items) - 1, 0, -1):
                own = self.items[at][0]
                if own == "p":
                    self.cut(at)
                    break
                if own in BLOCK_TAGS:
                    break
        ended, limit = ENDS.get(tag, ((), ()))
        if any(self.count[x] > 0 for x in ended):
            for at in range(len(self.items) - 1, 0, -1):
                own = self.items[at][0]
                if own in limit:
                    break
                if own in ended:
                    self.cut(at)
                    break


def leaf_blocks(html: str) -> tuple[str, list[Block]]:
    """(title, blocks in page order) of a page."""
    stack, out, parts = _Stack(), [], []
    chars = linked = 0
    title, quoted, at, end = "", True, 0, len(html)

    def add(raw: str) -> None:
        nonlocal chars, linked
        if raw:
            value = unescape(raw)
            parts.append(value)
            chars += len(value)
            linked += len(value) if stack.count["a"] > 0 else 0

    def flush() -> None:
        nonlocal chars, linked
        if parts:
            words = " ".join("".join(parts).split())
            if words:
                at_block = next((i for i in range(len(stack.items) - 1, 0, -1) if stack.items[i][0] in BLOCK_TAGS), 0)
                _, above, marked, inside, _ = stack.items[-1]
                out.append(Block(words, stack.items[at_block][0], above, linked / chars, marked, inside, stack.items[max(at_block - 1, 0)][4]))
            parts.clear()
            chars = linked = 0

    while at < end:
        m = _OPEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at:m.start()])
        if m.group(2) is None:
            # a comment, a declaration or a processing instruction
            close = "-->" if html.startswith("<!--", m.start()) else ">"
            to = html.find(close, m.start() + (4 if len(close) == 3 else 1))
            at = end if to < 0 else to + len(close)
            continue
        tag, rest = m.group(2).lower(), _REST.match(html, m.end()) if quoted else None
        if rest is None:
            quoted = False      # a quote without its end: from here on tags end at the next >
            to = html.find(">", m.end())
            after = end if to < 0 else to + 1
        else:
            after = rest.end()
        if m.group(1):
            if tag in BLOCK_TAGS:
                flush()
            stack.end(tag)
            at = after
            continue
        attributes = html[m.end():after - 1]
        if tag in SILENT_TAGS:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, after)
            if tag == "title" and not title:
                title = " ".join(unescape(html[after:close.start() if close else end]).split())
            at = end if close is None else close.start()
            continue
        if tag in BLOCK_TAGS:
            flush()
            stack.implied(tag)
        elif tag == "br":
            add(" ")
        if tag not in VOID_TAGS:
            stack.push(tag, attributes)
        at = after
    flush()
    return title, out
