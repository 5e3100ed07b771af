"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max index, calibrated votes.

Examples are a bounded sample of the labelled rows (``per_label`` of each label, those with the
smallest hash of the id).  Terms are words and their first four and five letters, so that a
slur with another ending is still met; the vocabulary is what tells the labels apart in the
sample (a chi-squared test), and what toxic examples hold far more often than all documents do
(a likelihood-ratio test: a word of few toxic examples is told from chance by how rare it is
elsewhere).  Document frequencies are counted over all documents.

Each executor holds the index of the examples: weights term by term in blocks of examples,
and the largest weight of each term in each block.  A document's cosine with any example of a
block is at most the sum over its terms of weight times block maximum; blocks are visited from
the highest bound down and the search ends when the bound falls below the k-th best cosine, so
the neighbours are exact.  Neighbours vote by their cosine, and a logistic curve fitted on
half of the sample, never on the other folds, turns votes into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .tables import broadcast

#: words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text
SEPARATORS = np.array([b < 0x80 and not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A) for b in range(256)])
PER_LABEL = 2000     # examples of each label at most, for the vocabulary, the index and the calibration
CHI2 = 20.0          # least association of a term with the labels, and least excess in toxic examples
LEAST_DOCS = 4       # examples that must hold a term
BLOCK = 64
NEIGHBOURS = 15


def terms(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(term hashes, index of the text) of the distinct words and word beginnings of each text."""
    w = text.words(part, SEPARATORS)
    size, found, owner = w.end - w.start, [w.hash], [w.owner]
    for n in (4, 5):
        long = size > n
        found.append(text.draw(text.spans_hash(w.buf, w.start[long], w.start[long] + n), n))
        owner.append(w.owner[long])
    return np.concatenate(found), np.concatenate(owner)


def _distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, text) with their counts, text by text."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return h[at], owner[at], np.diff(np.append(at, len(h)))


def _lookup(vocabulary: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in the sorted vocabulary, whether it is in it)."""
    if not len(vocabulary):
        return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return at, vocabulary[at] == h


@dataclass
class Index:
    """Examples as unit TF-IDF vectors, term by term and block by block."""

    vocabulary: np.ndarray                  # sorted term hashes
    idf: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))    # terms x examples
    block_max: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # terms x blocks
    label: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slope: float = 0.0
    shift: float = 0.0
    prior: float = 0.0

    def vectors(self, part: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of each text: (1 + log tf) * idf, of length one; empty without known terms."""
        h, owner = terms(part)
        at, known = _lookup(self.vocabulary, h)
        t, o, n = _distinct(at[known], owner[known])
        w = (1 + np.log(n)) * self.idf[t] if len(t) else np.zeros(0)
        norm = np.sqrt(np.bincount(o, weights=w * w, minlength=len(part)))
        w = w / norm[o]
        edge = np.searchsorted(o, np.arange(len(part) + 1))
        return [(t[a:b], w[a:b]) for a, b in zip(edge[:-1], edge[1:])]

    def add(self, vectors: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> None:
        n = -(-max(len(vectors), 1) // BLOCK) * BLOCK
        self.weights = np.zeros((len(self.vocabulary), n), dtype=np.float32)
        for i, (t, w) in enumerate(vectors):
            self.weights[t, i] = w
        self.block_max = self.weights.reshape(len(self.vocabulary), -1, BLOCK).max(axis=2)
        self.label = np.zeros(n)
        self.label[:len(label)] = label

    def vote(self, t: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> tuple[float, np.ndarray]:
        """(cosine-weighted share of label 1 among the ``k`` nearest examples, their numbers).

        Examples with no common term are no neighbours; none at all votes the prior.
        """
        if not len(t):
            return self.prior, np.zeros(0, dtype=np.int64)
        bound = w @ self.block_max[t]
        best, where = np.zeros(0), np.zeros(0, dtype=np.int64)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(best) == k and bound[b] * (1 + 1e-6) < best[-1]):
                break
            cosine = w @ self.weights[t, b * BLOCK:(b + 1) * BLOCK]
            some = np.flatnonzero(cosine > 0)
            best, where = np.concatenate((best, cosine[some])), np.concatenate((where, some + b * BLOCK))
            order = np.lexsort((where, -best))[:k]
            best, where = best[order], where[order]
        # one vote's weight stands for the prior, so that a single weak neighbour decides little
        return float((best @ self.label[where] + 0.1 * self.prior) / (best.sum() + 0.1)), where

    def probability(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * vote + self.shift, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits ``y`` best, with a small pull to zero."""
    a = np.stack((x, np.ones(len(x))), axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 1e-3])
        step = np.linalg.solve(hess, a.T @ (y - p) - 1e-3 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _excess(seen: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """The likelihood ratio (twice its logarithm) of counts against the counts by chance; 0 where they are no higher."""
    chance = np.maximum(chance, 1e-9)
    ratio = 2 * (seen * np.log(np.maximum(seen, 1e-9) / chance) - (seen - chance))
    return np.where(seen > chance, ratio, 0.0)


def _document_frequency(vocabulary):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = vocabulary.value
        n, counts = 0, np.zeros(len(own), dtype=np.int64)
        for pdf in batches:
            for _, part in text.chunks(pdf["text"]):
                n += len(part)
                h, owner = terms(part)
                at, known = _lookup(own, h)
                counts += np.bincount(np.unique(at[known] * len(part) + owner[known]) // len(part), minlength=len(own))
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"term": np.append(some, -1), "n": np.append(counts[some], n)})
    return run


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Index:
    """The index of a bounded sample of the labelled documents.

    ``labels`` has doc_id and toxic (1 or 0; other values and nulls are no label, and of
    several rows of a doc_id the largest label counts); rows of ``docs`` repeating a doc_id
    count once, as the smallest text.  ``per_label`` bounds the sample: it is collected, and the model, of
    at most 2 * ``per_label`` examples and the terms they hold, is broadcast.  Without
    examples of both labels every score is the share of label 1.
    """
    spark = docs.sparkSession
    lab = (labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
           .agg(F.max("toxic").cast("int").alias("toxic")))
    chosen = None
    for y in (0, 1):
        some = lab.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        chosen = some if chosen is None else chosen.unionAll(some)
    counted = {r["toxic"]: r["count"] for r in lab.groupBy("toxic").count().collect()}
    n0, n1 = counted.get(0, 0), counted.get(1, 0)
    share = n1 / max(1, n0 + n1)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas())
    rows = rows.sort_values("doc_id", kind="stable").reset_index(drop=True)
    y = rows["toxic"].to_numpy(dtype=float)
    empty = Index(np.zeros(0, np.uint64), np.zeros(0), prior=share, slope=1.0,
                  shift=float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)) - share))
    if not len(y) or y.min() == y.max():
        return empty
    found, owner = [], []
    for first, part in text.chunks(rows["text"]):
        h, o = terms(part)
        h, o, _ = _distinct(h, o)
        found.append(h)
        owner.append(o + first)
    h, o = np.concatenate(found), np.concatenate(owner)
    term, at, df = np.unique(h, return_inverse=True, return_counts=True)
    in1 = np.bincount(at, weights=y[o], minlength=len(term))
    m, m1 = len(y), y.sum()
    expected = df * m1 / m
    chi2 = (in1 - expected) ** 2 / np.maximum(expected * (1 - df / m) * (1 - m1 / m), 1e-9)
    least = min(LEAST_DOCS, max(2, m // 50))
    telling = (df >= least) & (chi2 >= CHI2)
    tried = telling | ((in1 >= least) & (in1 > expected))
    if not tried.any():
        return empty
    shared = broadcast(spark, term[tried])
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(_document_frequency(shared), "term long, n long")
    counts = counts.groupBy("term").agg(F.sum("n").alias("n")).toPandas().set_index("term")["n"]
    df_all, n_all = counts.reindex(range(int(tried.sum())), fill_value=0).to_numpy(dtype=float), float(counts.get(-1, 0))
    kept = telling[tried] | (_excess(in1[tried], m1 * df_all / max(n_all, 1.0)) >= CHI2)
    if not kept.any():
        return empty
    index = Index(term[tried][kept], np.log((1 + n_all) / (1 + df_all[kept])) + 1, prior=share)
    # half of the examples are neighbours while the other half sets the curve; then all are neighbours
    vectors = [v for _, part in text.chunks(rows["text"]) for v in index.vectors(part)]
    half = text.mix64(rows["doc_id"].to_numpy(dtype=np.int64).view(np.uint64)) & np.uint64(1) == 1
    index.add([v for v, a in zip(vectors, half) if a], y[half])
    votes = np.array([index.vote(*v)[0] for v, a in zip(vectors, half) if not a])
    index.slope, index.shift = _logistic(votes, y[~half]) if len(votes) else (1.0, 0.0)
    # the sample holds the labels in other shares than the corpus does
    index.shift += float(np.log(max(n1, 1) / max(n0, 1)) - np.log(m1 / (m - m1)))
    index.add(vectors, y)
    return index


def _score(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = model.value
        known: dict[bytes, tuple[float, np.ndarray]] = {}
        for pdf in batches:
            scores, evidence = [], []
            for _, part in text.chunks(pdf["text"]):
                for t, w in index.vectors(part):
                    key = t.tobytes() if len(t) <= 1 else None   # texts of no or one known term are alike
                    if key is None or key not in known:
                        got = index.vote(t, w)
                        if key is not None:
                            known[key] = got
                    else:
                        got = known[key]
                    scores.append(index.probability(got[0]))
                    evidence.append(got[1])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "mark": pdf["mark"], "score": scores, "evidence": evidence})
    return run


def toxicity(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, per_label: int = PER_LABEL) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, mark (a hash of the text), score, evidence.

    ``score`` is the probability of label 1; ``evidence`` numbers the nearest examples, nearest
    first, in the order of their doc_id.  ``labels`` are those that may be learnt from; their
    texts are in ``corpus`` (by default ``docs``).  Only texts are inputs of a score.

    Null, empty and unknown texts have no neighbours and get the score of the prior share.
    Null ids are scored like others; repeated rows get equal scores; an empty table gives an empty table.
    """
    model = broadcast(docs.sparkSession, train(docs if corpus is None else corpus, labels, per_label))
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(_score(model), f"doc_id {kind}, mark long, score double, evidence array<long>")
