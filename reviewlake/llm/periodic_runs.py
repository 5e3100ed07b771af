"""Periodic runs of words by grammar-compressed detection: Re-Pair, one look at each rule's boundary, translation to all derivations.

A run is a stretch of consecutive words with smallest period q (words q apart are identical)
and a length of at least max(``LEAST``, 3 * q) that no neighbouring word extends.

Every window of ``GRAM`` words inside a run occurs again q words away, in the same run: the run
is no shorter than 2 * q + ``GRAM``.  Windows that a text holds once are therefore cuts, and only
stretches of ``LEAST`` words or more between them can hold a run; in plain prose there are few.
Each such stretch is Re-Paired on its own.

Re-Pair works in rounds: the pairs that occur most often among their neighbours become rules at
once, the most frequent pair of all in every round, until no pair occurs twice; the symbols left
are joined as a balanced tree.  A run is cut by the boundary between the two halves of the lowest
rule that holds it whole, so each rule's boundary is looked at once, at the rule's first
occurrence.  A run over a boundary repeats the window that begins there or the one that ends
there at the distance of its period, so occurrences of these two windows give the candidate
periods; common extensions to both sides, by hashes of windows of doubling length, give the
interval.  Intervals move with their rule to all its derivation positions, and those inside
another one of the same period go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text

LEAST, TIMES = 24, 3
GRAM = LEAST // TIMES
#: candidate periods that are extended at a time
BLOCK = 1 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _pair_hash(x: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of the windows made of the windows ``x`` at i and i + apart."""
    return text.mix64(x[:-apart] * text._BASE + x[apart:]) if len(x) > apart else x[:0]


def _window_hashes(h: np.ndarray) -> np.ndarray:
    """A hash of each window of ``GRAM`` words."""
    return text.sequence_hash(h, GRAM)


def stretches(h: np.ndarray) -> list[tuple[int, int]]:
    """(first word, word after the last) of the stretches in which every window of ``GRAM`` words occurs twice or more in ``h``."""
    g = _window_hashes(h)
    if len(g) < 2:
        return []
    order = np.argsort(g)
    same = g[order[1:]] == g[order[:-1]]
    twice = np.zeros(len(g) + 2, dtype=np.int8)
    twice[order[1:][same] + 1] = 1
    twice[order[:-1][same] + 1] = 1
    edge = np.diff(twice)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first > LEAST - GRAM
    return [(int(a), int(b) + GRAM - 1) for a, b in zip(first[long], last[long])]


class Grammar:
    """Rules of two symbols each; symbols below ``words`` are words, ``words + r`` is rule r, the last rule is the whole."""

    def __init__(self, symbols: np.ndarray, words: int):
        self.words = words
        self.size = [1] * words
        self.halves: list[tuple[int, int]] = []
        self._known: dict[tuple[int, int], int] = {}
        seq = symbols.astype(np.int64)
        while len(seq) > 1:
            picked = self._frequent(seq)
            if picked is None:
                # no pair occurs twice: join neighbours
                picked = np.arange(0, len(seq) - 1, 2)
            seq = self._replace(seq, picked)
        self.root = int(seq[0]) if len(seq) else None

    @staticmethod
    def _frequent(seq: np.ndarray) -> np.ndarray | None:
        """Places of pairs to replace: those that occur more often than the pairs they overlap (ties: the larger pair)."""
        key = (seq[:-1] << 32) | seq[1:]
        pairs, at, n = np.unique(key, return_inverse=True, return_counts=True)
        if n.max() < 2:
            return None
        rank = np.empty(len(pairs), dtype=np.int64)
        rank[np.lexsort((pairs, n))] = np.arange(1, len(pairs) + 1)
        weight = np.where(n >= 2, rank, 0)[at]
        around = np.concatenate(([0], weight, [0]))
        top = (weight > 0) & (weight >= around[:-2]) & (weight >= around[2:])
        # in a row of one word's repetition the pairs overlap each other: every second one
        chain = np.concatenate(([False], top[1:] & top[:-1]))
        start = np.maximum.accumulate(np.where(chain, 0, np.arange(len(top))))
        return np.flatnonzero(top & ((np.arange(len(top)) - start) % 2 == 0))

    def _replace(self, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = (seq[at] << 32) | seq[at + 1]
        pairs, which = np.unique(key, return_inverse=True)
        new = np.empty(len(pairs), dtype=np.int64)
        for i, pair in enumerate(pairs.tolist()):
            halves = (pair >> 32, pair & 0xFFFFFFFF)
            if halves not in self._known:
                self._known[halves] = self.words + len(self.halves)
                self.halves.append(halves)
                self.size.append(self.size[halves[0]] + self.size[halves[1]])
            new[i] = self._known[halves]
        out = seq.copy()
        out[at] = new[which]
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        return out[keep]

    def derivations(self) -> tuple[np.ndarray, np.ndarray]:
        """(rule, position) of each occurrence of each rule of at least ``LEAST`` words."""
        size, halves = np.array(self.size), np.array(self.halves).reshape(-1, 2)
        rules, places = [], []
        rule, place = np.array([self.root], dtype=np.int64), np.zeros(1, dtype=np.int64)
        while len(rule):
            wide = size[rule] >= LEAST
            rule, place = rule[wide] - self.words, place[wide]
            rules.append(rule)
            places.append(place)
            left, right = halves[rule, 0], halves[rule, 1]
            rule, place = np.concatenate((left, right)), np.concatenate((place, place + size[left]))
        return np.concatenate(rules), np.concatenate(places)


class _Extensions:
    """Longest common extensions of pairs of positions, by hashes of windows of doubling length."""

    def __init__(self, h: np.ndarray):
        self.levels = [h]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            self.levels.append(_pair_hash(self.levels[-1], 1 << (len(self.levels) - 1)))

    def right(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on, ``most`` at most."""
        got = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            can = np.flatnonzero(got + (1 << k) <= most)
            x = self.levels[k]
            can = can[x[a[can] + got[can]] == x[b[can] + got[can]]]
            got[can] += 1 << k
        return got

    def left(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before ``a`` equal those before ``b``, ``most`` at most."""
        got = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            can = np.flatnonzero(got + (1 << k) <= most)
            x = self.levels[k]
            can = can[x[a[can] - got[can] - (1 << k)] == x[b[can] - got[can] - (1 << k)]]
            got[can] += 1 << k
        return got


def _ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (n of them) of each element, end to end."""
    return np.arange(int(n.sum()), dtype=np.int64) + np.repeat(first - (np.cumsum(n) - n), n)


def _outermost(rows: np.ndarray) -> np.ndarray:
    """Rows (group, begin, end, period) without those inside another one of the same group and period, and of equal intervals the least period."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((-rows[:, 2], rows[:, 1], rows[:, 3], rows[:, 0]))]
    new = np.concatenate(([True], (rows[1:, [0, 3]] != rows[:-1, [0, 3]]).any(axis=1)))
    room = int(rows[:, 2].max()) + 1
    reach = np.maximum.accumulate(rows[:, 2] + (np.cumsum(new) - 1) * room) - (np.cumsum(new) - 1) * room
    rows = rows[new | (rows[:, 2] > np.concatenate(([-1], reach[:-1])))]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))]


def _over_boundaries(h: np.ndarray, first: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows (rule, begin, end, period) of the stretches over each rule's boundary, within its occurrence from ``first`` to ``end``."""
    g, n = _window_hashes(h), len(h)
    _, rank = np.unique(g, return_inverse=True)
    places = np.sort(rank * (n + 1) + np.arange(len(g)))
    ext = _Extensions(h)
    most = (end - first) // TIMES
    found = [np.zeros((0, 4), dtype=np.int64)]
    for back in (0, GRAM):      # the window that begins at the boundary, and the one that ends there
        at = middle - back
        rules = np.flatnonzero((at >= 0) & (at < len(g)))
        base = rank[at[rules]] * (n + 1)
        low = np.searchsorted(places, base + np.maximum(first[rules], middle[rules] - most[rules]) - back)
        high = np.searchsorted(places, base + np.minimum(end[rules], middle[rules] + most[rules]) - back, side="right")
        total = np.cumsum(np.maximum(high - low, 0))
        a = 0
        while a < len(rules):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BLOCK, side="right")))
            k = np.maximum(high[a:b] - low[a:b], 0)
            rule = np.repeat(rules[a:b], k)
            other = places[_ragged(low[a:b], k)] % (n + 1) + back
            apart = other != middle[rule]
            rule, other = rule[apart], other[apart]
            p, q = np.minimum(other, middle[rule]), np.maximum(other, middle[rule])
            begin = p - ext.left(p, q, p - first[rule])
            stop = q + ext.right(p, q, end[rule] - q)
            run = stop - begin >= np.maximum(LEAST, TIMES * (q - p))
            found.append(_outermost(np.stack((rule, begin, stop, q - p), axis=1)[run]))
            a = b
    return _outermost(np.concatenate(found))


def runs_of(h: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words with the hashes ``h``, by start, then period."""
    distinct, symbols = np.unique(h, return_inverse=True)
    grammar = Grammar(symbols, len(distinct))
    if len(h) < LEAST:
        return []
    rule, place = grammar.derivations()
    order = np.lexsort((place, rule))
    rule, place = rule[order], place[order]
    used, head, times = np.unique(rule, return_index=True, return_counts=True)
    size = np.array(grammar.size)
    left = size[np.array(grammar.halves).reshape(-1, 2)[used, 0]]
    first = place[head]
    rows = _over_boundaries(h, first, first + left, first + size[grammar.words + used])
    # every interval moves with its rule to all derivation positions
    n = times[rows[:, 0]]
    moved = place[_ragged(head[rows[:, 0]], n)] - np.repeat(first[rows[:, 0]], n)
    every = np.stack((np.zeros(len(moved), dtype=np.int64), np.repeat(rows[:, 1], n) + moved, np.repeat(rows[:, 2], n) + moved,
                      np.repeat(rows[:, 3], n)), axis=1)
    return [(int(a), int(b - a), int(q)) for _, a, b, q in _outermost(every)]


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for first, part in text.chunks(pdf["text"]):
            w = text.words(part, lower=False)
            # a word counts as equal inside its own text alone
            own = text.mix64(w.hash + text.mix64(w.owner.astype(np.uint64)))
            found: dict[int, list] = {}
            for a, b in stretches(own):
                i = int(np.searchsorted(w.offset, a, side="right")) - 1
                start = a - int(w.offset[i])
                found.setdefault(i, []).extend((start + s, n, q) for s, n, q in runs_of(own[a:b]))
            rows = []
            for i, raw in enumerate(part):
                parts, runs = raw.split(), sorted(found.get(i, []), key=lambda r: (r[0], r[2]))
                n_words = len(parts)
                if runs:
                    keep = np.ones(n_words, dtype=bool)
                    for s, n, q in runs:
                        keep[s + q:s + n] = False
                    parts = [parts[j] for j in np.flatnonzero(keep)]
                rows.append((n_words, [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(parts).decode("utf-8", "surrogatepass")))
            out = pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])
            out.insert(0, "doc_id", pdf["doc_id"].iloc[first:first + len(part)].to_numpy())
            yield out


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are not read): doc_id, n_words, runs, collapsed.

    ``runs`` are structs (start, length, period) by start, then period, word numbers from 0;
    words are ``[^\\x20\\x09-\\x0D]+``, compared as they are.  ``collapsed`` is the text's words
    joined by one space, without those that a run holds after its first period.

    Null and empty texts have no words, no runs and an empty ``collapsed``.  Null ids and
    repeated rows are rows like others; an empty table gives an empty table.  A text is read
    whole however long; memory grows with the longest text alone.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInPandas(_texts, f"doc_id string, n_words bigint, runs array<{RUN}>, collapsed string")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def longest_power(runs):
    """The run with the greatest length / period, exactly (ties: smallest start, then period); null if there is none."""
    better = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), better)
