"""Hidden Markov language model: Baum-Welch counts summed across partitions, exact scaled forward scores.

Words have classes: the ``TOP`` most frequent training words one each, all others one of
``SHAPES`` classes by their first and last letters, and the end of a text its own.  A text's
probability is that of its class sequence under the HMM times that of each word within its
class, which is counted over the whole training corpus.  The HMM's size is fixed by its
parameters; the word counts grow with the corpus and are joined, never broadcast.

Texts are encoded once: each batch gets a dictionary of its distinct words, the dictionaries
are joined with the corpus counts, and the batch is put together again with what its words
count.  Training then reads sequences of two-byte classes; each task sums the expected counts
of its texts, and the sums of all tasks make the next model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text
from .tables import broadcast, written

STATES, TOP, SHAPES = 8, 2048, 1024
END = 0
CLASSES = 1 + TOP + SHAPES
SWEEPS = 3            # Baum-Welch sweeps over all training texts
SAMPLE_TEXTS = 256    # training texts that set the starting point, in SAMPLE_SWEEPS sweeps
SAMPLE_SWEEPS = 20
BATCH_BYTES = 24 << 20
#: rows of distinct words that are handed to Spark at once
WORD_ROWS = 1 << 16
#: tokens that a step of the recursions holds at once; a longer text goes through in blocks of as many
STEP_TOKENS = 1 << 18
ENCODED = "batch long, doc_id long, held_out boolean, size int, codes binary, word long, local int, n long, shape int"


def _flush(batch: int, held: list) -> Iterator[pd.DataFrame]:
    """One batch: a row for each text with its words as numbers, and a row for each distinct word.

    The more often a word occurs in the batch, the smaller its number, so the sequences compress well.
    """
    word, first, at = np.unique(np.concatenate([h["word"] for h in held]), return_index=True, return_inverse=True)
    shape = np.concatenate([h["shape"] for h in held])[first]
    uses, n = (np.bincount(at, np.concatenate([h[x] for h in held]), len(word)).astype(np.int64) for x in ("uses", "n"))
    order = np.argsort(-uses, kind="stable")
    number = np.empty(len(word), dtype=np.int32)
    number[order] = np.arange(len(word), dtype=np.int32)
    at = number[at]
    names = [c.split()[0] for c in ENCODED.split(", ")]
    none = dict.fromkeys(names)
    # as frames of typed columns: one of mixed rows would box every number
    begin = 0
    for h in held:
        local = at[begin:begin + len(h["word"])][h["local"]]
        begin += len(h["word"])
        edge = np.concatenate(([0], np.cumsum(h["size"])))
        yield pd.DataFrame(none | {"batch": batch, "doc_id": pd.array(h["id"], dtype="Int64"), "held_out": h["out"], "size": h["size"],
                                   "codes": [zlib.compress(local[a:b].tobytes(), 1) for a, b in zip(edge[:-1], edge[1:])]}, columns=names)
    for a in range(0, len(word), WORD_ROWS):
        some = order[a:a + WORD_ROWS]
        yield pd.DataFrame(none | {"batch": batch, "word": text.signed(word[some]), "local": number[some], "n": n[some],
                                   "shape": shape[some]}, columns=names, index=range(len(some)))


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number, held, bytes_held = 0, [], 0
    part_id = TaskContext.get().partitionId() << 32
    for pdf in batches:
        ids, out = pdf["doc_id"].array, pdf["held_out"].to_numpy(dtype=bool)
        ids = np.array([None if pd.isna(x) else int(x) for x in ids], dtype=object)
        for first, part in text.chunks(pdf["text"]):
            w = text.words(part)
            # a chunk is held as its distinct words and the places of its words among them
            word, at, local = np.unique(w.hash, return_index=True, return_inverse=True)
            start, last = w.start[at], w.end[at] - 1
            ends = (w.buf[start].astype(np.uint64) << np.uint64(16)) | (
                w.buf[np.maximum(last - 1, start)].astype(np.uint64) << np.uint64(8)) | w.buf[last].astype(np.uint64)
            size, held_out = np.diff(w.offset), out[first:first + len(part)]
            held.append({"word": word, "local": local.astype(np.int32), "shape": (text.mix64(ends) % np.uint64(SHAPES)).astype(np.int32),
                         "uses": np.bincount(local, minlength=len(word)).astype(np.int32),
                         "n": np.bincount(local[np.repeat(~held_out, size)], minlength=len(word)).astype(np.int32),
                         "size": size, "id": ids[first:first + len(part)], "out": held_out})
            bytes_held += len(w.buf)
            if bytes_held >= BATCH_BYTES:
                yield from _flush(part_id + number, held)
                number, held, bytes_held = number + 1, [], 0
    if held:
        yield from _flush(part_id + number, held)


@dataclass
class Counts:
    """What the words of the training texts add up to; its size does not depend on the corpus."""

    tokens: int           # all, with one end for each text
    distinct: int
    texts: int
    top: np.ndarray       # the words of a class of their own, sorted
    shape_tokens: np.ndarray
    shape_words: np.ndarray


def _resolve(counts):
    def run(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        k: Counts = counts.value
        words = words.sort_values("local")
        c = words["c"].to_numpy(dtype=np.int64)
        word, shape = words["word"].to_numpy(dtype=np.int64), words["shape"].to_numpy(dtype=np.int64)
        at = np.minimum(np.searchsorted(k.top, word), max(len(k.top) - 1, 0))
        is_top = k.top[at] == word if len(k.top) else np.zeros(len(word), dtype=bool)
        cls = np.where(is_top, 1 + at, 1 + TOP + shape).astype(np.uint16)
        room = k.tokens + 1 * (k.distinct + 1)
        base = np.log10((c + 1) / room)
        inner = np.where(is_top, 0.0, np.log10((c + 1) / (k.shape_tokens[shape] + k.shape_words[shape] + 1)))
        end_base, known_end = np.log10((k.texts + 1) / room), int(k.texts > 0)
        rows = []
        for code in texts["codes"]:
            x = np.frombuffer(zlib.decompress(code), dtype=np.int32)
            rows.append((len(x) + 1, int((c[x] > 0).sum()) + known_end, float(base[x].sum() + end_base), float(inner[x].sum()),
                         zlib.compress(np.append(cls[x], np.uint16(END)).tobytes(), 1)))
        out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "base_score", "inner", "classes"])
        return pd.concat([texts[["doc_id", "held_out"]].reset_index(drop=True), out], axis=1)
    return run


@dataclass
class Model:
    start: np.ndarray    # states
    move: np.ndarray     # states x states
    emit: np.ndarray     # classes x states

    @classmethod
    def of(cls, counts: np.ndarray) -> Model:
        """The model of expected counts, a little smoothed so that nothing is impossible."""
        start, move, emit = counts[:STATES] + 0.1, counts[STATES:STATES + STATES ** 2].reshape(STATES, STATES) + 0.1, (
            counts[STATES + STATES ** 2:].reshape(CLASSES, STATES) + 0.01)
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


N_COUNTS = STATES + STATES ** 2 + CLASSES * STATES


def _step_major(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the sequences, longest first; classes step by step; sequences still running at each step; offsets)."""
    size = np.array([len(s) for s in seqs])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    steps = size[0]
    running = len(size) - np.searchsorted(size[::-1], np.arange(steps), side="right")
    offset = np.concatenate(([0], np.cumsum(running)))
    flat = np.concatenate([seqs[i] for i in order])
    t = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out = np.empty(len(flat), dtype=np.int64)
    out[offset[t] + np.repeat(np.arange(len(size)), size)] = flat
    return order, out, running, offset


def forward(model: Model, seqs: list[np.ndarray], keep: bool = False):
    """Natural-log likelihood of each sequence by the scaled forward recursion, one step for all at a time."""
    order, obs, running, offset = _step_major(seqs)
    loglik = np.zeros(len(seqs))
    alphas = np.empty((len(obs), STATES)) if keep else None
    scales = np.empty(len(obs)) if keep else None
    alpha = None
    for t, n in enumerate(running):
        a, b = offset[t], offset[t + 1]
        alpha = (model.start if t == 0 else alpha[:n] @ model.move) * model.emit[obs[a:b]]
        s = alpha.sum(axis=1)
        alpha /= s[:, None]
        loglik[:n] += np.log(s)
        if keep:
            alphas[a:b], scales[a:b] = alpha, s
    out = np.empty(len(seqs))
    out[order] = loglik
    return (out, obs, running, offset, alphas, scales) if keep else out


def expected_counts(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """Baum-Welch: expected starts, moves and emissions of the sequences, end to end."""
    _, obs, running, offset, alphas, scales = forward(model, seqs, keep=True)
    moves = np.zeros((STATES, STATES))
    beta = np.zeros((0, STATES))
    for t in range(len(running) - 1, -1, -1):
        a, n = offset[t], running[t]
        now = np.ones((n, STATES))
        if len(beta):
            m = len(beta)
            c, d = offset[t + 1], offset[t + 1] + m
            ahead = model.emit[obs[c:d]] * beta / scales[c:d, None]
            moves += alphas[a:a + m].T @ ahead
            now[:m] = ahead @ model.move.T
            # the kept alphas of the later step become state probabilities
            alphas[c:d] *= beta
        beta = now
    alphas[:offset[1]] *= beta
    alphas /= alphas.sum(axis=1, keepdims=True)      # now the state probabilities
    emit = np.stack([np.bincount(obs, weights=alphas[:, s], minlength=CLASSES) for s in range(STATES)], axis=1)
    return np.concatenate((alphas[:offset[1]].sum(axis=0), (moves * model.move).ravel(), emit.ravel()))


def _advance(model: Model, alpha: np.ndarray | None, obs: np.ndarray, keep: bool):
    """The forward recursion over one block of a text from the state before it: (alphas or the last one, scales)."""
    alphas, scales = np.empty((len(obs) if keep else 1, STATES)), np.empty(len(obs))
    for t, o in enumerate(obs):
        alpha = (model.start if alpha is None else alpha @ model.move) * model.emit[o]
        scales[t] = alpha.sum()
        alpha = alpha / scales[t]
        if keep:
            alphas[t] = alpha
    return (alphas if keep else alpha), scales


def long_counts(model: Model, seq: np.ndarray, block: int = STEP_TOKENS) -> np.ndarray:
    """``expected_counts`` of one text of any length, a block in memory at a time.

    The forward recursion first keeps its state at the block boundaries alone; backwards, each
    block's states are computed again from there.
    """
    parts = [seq[i:i + block] for i in range(0, len(seq), block)]
    before = [None]
    for part in parts[:-1]:
        before.append(_advance(model, before[-1], part, False)[0])
    moves, emit = np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
    ahead, gamma = None, None
    for part, alpha in zip(parts[::-1], before[::-1]):
        alphas, scales = _advance(model, alpha, part, True)
        for t in range(len(part) - 1, -1, -1):
            beta = np.ones(STATES) if ahead is None else model.move @ ahead
            if ahead is not None:
                moves += np.outer(alphas[t], ahead)
            ahead = model.emit[part[t]] * beta / scales[t]
            gamma = alphas[t] * beta
            gamma /= gamma.sum()
            emit[part[t]] += gamma
    return np.concatenate((gamma, (moves * model.move).ravel(), emit.ravel()))


def _groups(classes, n_tokens, limit: int = STEP_TOKENS) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(row numbers, sequences) of groups of like length and bounded size; a longer text is a group of its own."""
    size, classes = np.asarray(n_tokens), list(classes)
    order = np.argsort(size, kind="stable")
    first = 0
    while first < len(order):
        last, held = first + 1, int(size[order[first]])
        while last < len(order) and held + size[order[last]] <= limit:
            held += int(size[order[last]])
            last += 1
        rows = order[first:last]
        yield rows, [np.frombuffer(zlib.decompress(classes[i]), dtype=np.uint16) for i in rows]
        first = last


def _count(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(N_COUNTS)
        for pdf in batches:
            for _, seqs in _groups(pdf["classes"], pdf["n_tokens"]):
                total += long_counts(model.value, seqs[0]) if len(seqs[0]) > STEP_TOKENS else expected_counts(model.value, seqs)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"i": some, "x": total[some]})
    return run


def _score(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = np.zeros(len(pdf))
            for rows, seqs in _groups(pdf["classes"], pdf["n_tokens"]):
                score[rows] = forward(model.value, seqs) / np.log(10)
            out = pdf[["doc_id", "held_out", "n_tokens", "n_known", "base_score"]].copy()
            out["score"] = score + pdf["inner"].to_numpy()
            yield out
    return run


def starting_model(seqs: list[np.ndarray], class_tokens: np.ndarray) -> Model:
    """A model from noise around the class shares, improved on a sample of the training texts."""
    share = (class_tokens + 0.5) / (class_tokens + 0.5).sum()
    noise = text.draw(np.arange(CLASSES * STATES, dtype=np.uint64), 7).astype(np.float64) / 2.0 ** 64
    emit = share[:, None] * (0.5 + noise.reshape(CLASSES, STATES))
    model = Model(np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1)),
                  emit / emit.sum(axis=0))
    for _ in range(SAMPLE_SWEEPS if seqs else 0):
        # the class shares stand in for what the sample does not hold
        model = Model.of(expected_counts(model, seqs) + np.concatenate((np.zeros(STATES + STATES ** 2), (share[:, None] * np.full(STATES, 200.0)).ravel())))
    return model


def language_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows for which ``held_out`` (a Column over ``docs``; null is false) is
    false.  Tokens are words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, then one end.
    ``base_score`` is the sum of log10((c + 1) / (N + 1 * (V + 1))) over the tokens; ``score``
    is the model's log10 probability of the text.

    Null and empty texts are the end alone.  Null ids are rows like others; repeated rows count
    and are scored each.  Nothing to learn from leaves the starting model and counts of zero;
    an empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    encoded = written(rows.mapInPandas(_encode, ENCODED), "encoded")
    texts = encoded.where("word IS NULL").select("batch", "doc_id", "held_out", "codes")
    words = encoded.where("word IS NOT NULL").select("batch", "word", "local", "n", "shape")
    counts = written(words.groupBy("word").agg(F.sum("n").alias("c"), F.max("shape").alias("w_shape")), "counts")
    n_texts = texts.where("NOT held_out").count()
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    top = counts.where("c > 0").orderBy(F.desc("c"), "word").limit(TOP).toPandas().sort_values("word")
    own_class = spark.createDataFrame([(int(w),) for w in top["word"]], "word long")   # at most TOP rows
    rest = counts.join(F.broadcast(own_class), "word", "left_anti")
    shapes = rest.groupBy("w_shape").agg(F.sum("c").alias("c"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).toPandas()
    shape_tokens, shape_words = np.zeros(SHAPES), np.zeros(SHAPES)
    shape_tokens[shapes["w_shape"].to_numpy(dtype=int)] = shapes["c"]
    shape_words[shapes["w_shape"].to_numpy(dtype=int)] = shapes["v"]
    known = Counts(tokens + n_texts, distinct + (n_texts > 0), n_texts, top["word"].to_numpy(dtype=np.int64), shape_tokens, shape_words)
    counted = words.join(counts.select("word", "c"), "word").select(F.col("batch").alias("in_batch"), "word", "local", "shape", "c")
    resolved = written(texts.groupBy("batch").cogroup(counted.groupBy("in_batch")).applyInPandas(
        _resolve(broadcast(spark, known)),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inner double, classes binary"), "resolved")
    learn = resolved.where("NOT held_out").select("classes", "n_tokens", "doc_id")
    sample = learn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_TEXTS).toPandas()
    class_tokens = np.concatenate(([n_texts], np.zeros(TOP), shape_tokens))
    class_tokens[1:1 + len(top)] = top["c"]
    seqs = [np.frombuffer(zlib.decompress(x), dtype=np.uint16) for x in sample["classes"]]
    model = starting_model(seqs, class_tokens)
    for _ in range(SWEEPS if n_texts else 0):
        sums = learn.select("classes", "n_tokens").mapInPandas(_count(broadcast(spark, model)), "i int, x double").groupBy("i").agg(
            F.sum("x").alias("x")).toPandas()
        total = np.zeros(N_COUNTS)
        total[sums["i"].to_numpy(dtype=int)] = sums["x"]
        model = Model.of(total)
    out = resolved.mapInPandas(_score(broadcast(spark, model)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(known.tokens)).cast("long").alias("train_tokens"), "base_score", "score")
