"""Token counts: greedy longest-match word pieces by a linear automaton, without building pieces.

The vocabulary is a byte trie with two roots, one for pieces that begin a word and one for
pieces that go on.  Every node has a failure link and the number of pieces that following it
completes (Song et al. 2021, LinMaxMatch), so a word is counted in one pass over its bytes.
Distinct words of a chunk walk the automaton together, one byte of all of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import text
from .tables import broadcast

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD_START = "▁"


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[str], list[str]]:
    """(pieces that begin a word, pieces that go on) of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    begin = [p[1:] for p in plain if p.startswith(WORD_START) and len(p) > 1]
    return begin, [p for p in plain if WORD_START not in p and p]


class Automaton:
    """Trie, failure links and popped-piece counts as arrays; bounded by the vocabulary."""

    def __init__(self, begin: Iterable[str], go_on: Iterable[str]):
        children: list[dict[int, int]] = [{}, {}]
        ends = {}
        for root, pieces in ((0, begin), (1, go_on)):
            for p in pieces:
                node = root
                for b in p.encode("utf-8"):
                    nxt = children[node].get(b)
                    if nxt is None:
                        nxt = children[node][b] = len(children)
                        children.append({})
                    node = nxt
                ends[node] = True
        n = len(children)
        fail, pops = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        queue = [0, 1]
        for node in queue:
            for b, child in children[node].items():
                if child in ends:
                    fail[child], pops[child] = 1, 1
                else:
                    z, got = fail[node], pops[node]
                    while z >= 0 and b not in children[z]:
                        got += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[child], pops[child] = children[z][b], got
                queue.append(child)
        edges = sorted((node << 8 | b, child) for node, kids in enumerate(children) for b, child in kids.items())
        self.edge = np.array([e[0] for e in edges], dtype=np.int64)
        self.target = np.array([e[1] for e in edges], dtype=np.int64)
        self.fail, self.pops = fail, pops

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node by its byte, -1 for none."""
        key = node << 8 | byte
        if not len(self.edge):
            return np.full(len(node), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[at] == key, self.target[at], -1)

    def counts(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each word; -1 where no sequence of longest matches covers it."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        node, total = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
        for i in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -i, side="left"))     # words longer than i
            live = np.flatnonzero(node[:n] >= 0)
            byte = buf[start[live] + i].astype(np.int64)
            while len(live):
                nxt = self.step(node[live], byte)
                node[live[nxt >= 0]] = nxt[nxt >= 0]
                live, byte = live[nxt < 0], byte[nxt < 0]
                total[live] += self.pops[node[live]]
                node[live] = self.fail[node[live]]
                go = node[live] >= 0
                live, byte = live[go], byte[go]
        live = np.flatnonzero(node > 1)
        while len(live):
            total[live] += self.pops[node[live]]
            node[live] = self.fail[node[live]]
            live = live[node[live] > 1]
        out = np.empty(len(size), dtype=np.int64)
        out[order] = np.where(node == 1, total, -1)
        return out


def _count(automaton):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a: Automaton = automaton.value
        for pdf in batches:
            for first, part in text.chunks(pdf["text"]):
                w = text.words(part, lower=False)
                _, at, which = np.unique(w.hash, return_index=True, return_inverse=True)
                got = a.counts(w.buf, w.start[at], w.end[at])[which]
                unknown = got < 0
                sums = [np.concatenate(([0], np.cumsum(x))) for x in (np.where(unknown, 1, got), unknown)]
                own = pdf.iloc[first:first + len(part)].drop(columns="text").reset_index(drop=True)
                own["n_words"] = np.diff(w.offset)
                own["n_tokens"], own["n_unknown"] = (s[w.offset[1:]] - s[w.offset[:-1]] for s in sums)
                yield own
    return run


def token_counts(docs: DataFrame, vocabulary: str | tuple[list[str], list[str]] = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of each row of ``docs`` (doc_id, text).

    A word (``[^\\x20\\x09-\\x0D]+`` of the whole text, as written) is cut greedily: the longest
    piece that begins a word, then always the longest piece that goes on.  A word that cannot be
    cut so is one unknown token.  ``vocabulary`` is a sentencepiece model file or the two lists.

    Null and empty texts count zero; null ids and repeated rows are rows like others; an empty
    table gives an empty table.
    """
    begin, go_on = read_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
    shared = broadcast(docs.sparkSession, Automaton(begin, go_on))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInPandas(
        _count(shared), f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
