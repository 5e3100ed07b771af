"""A linear-chain conditional random field: named features, moves by kind of step, exact gradients by forward-backward, Viterbi decoding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: strength of the squared penalty, and steps and rate of Adam on the penalised log likelihood
PENALTY, STEPS, RATE = 0.005, 150, 0.15


@dataclass
class Crf:
    names: dict          # feature -> row of ``state``
    state: np.ndarray    # features x labels
    move: np.ndarray     # kinds of steps x labels x labels: from, to
    start: np.ndarray    # labels

    def scores(self, sequence: Sequence[Sequence[str]]) -> np.ndarray:
        """Steps x labels; features that the model has not seen count nothing."""
        out = np.zeros((len(sequence), len(self.start)))
        known = self.names.get
        for t, features in enumerate(sequence):
            rows = [r for r in map(known, features) if r is not None]
            if rows:
                out[t] = self.state[rows].sum(axis=0)
        return out

    def decode(self, sequence: Sequence[Sequence[str]], kinds: Sequence[int]) -> list[int]:
        """The most probable labels (ties: the smaller label); ``kinds[t]`` is that of the step to element ``t``."""
        if not sequence:
            return []
        scores = self.scores(sequence)
        best, back = self.start + scores[0], np.zeros(scores.shape, dtype=np.int8)
        for t in range(1, len(scores)):
            step = best[:, None] + self.move[kinds[t]]
            back[t] = step.argmax(axis=0)
            best = step.max(axis=0) + scores[t]
        labels = [int(best.argmax())]
        for t in range(len(scores) - 1, 0, -1):
            labels.append(int(back[t, labels[-1]]))
        return labels[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def likelihood(scores: np.ndarray, kinds: np.ndarray, size: np.ndarray, move: np.ndarray, start: np.ndarray):
    """(log partition of each sequence, label probabilities, expected moves) of padded scores: sequences x steps x labels; kinds: sequences x steps."""
    n, steps, k = scores.shape
    alpha, beta = np.zeros(scores.shape), np.zeros(scores.shape)
    alpha[:, 0] = start + scores[:, 0]
    for t in range(1, steps):
        alpha[:, t] = _logsum(alpha[:, t - 1, :, None] + move[kinds[:, t]], 1) + scores[:, t]
    for t in range(steps - 2, -1, -1):
        ahead = _logsum(move[kinds[:, t + 1]] + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where((t + 1 < size)[:, None], ahead, 0.0)
    total = _logsum(alpha[np.arange(n), size - 1], 1)
    inside = (np.arange(steps) < size[:, None])[:, :, None]
    share = np.where(inside, np.exp(np.minimum(alpha + beta - total[:, None, None], 0)), 0.0)
    moves = np.zeros(move.shape)
    for t in range(1, steps):
        on = np.flatnonzero(t < size)
        both = np.exp(alpha[on, t - 1, :, None] + move[kinds[on, t]] + (scores[on, t] + beta[on, t])[:, None, :] - total[on, None, None])
        np.add.at(moves, kinds[on, t], both)
    return total, share, moves


def fit(sequences: Sequence[Sequence[Sequence[str]]], kinds: Sequence[Sequence[int]], labels: Sequence[Sequence[int]],
        n_labels: int = 2, n_kinds: int = 1) -> Crf:
    """The model of the labelled sequences; without any, all labels are alike."""
    kept = [i for i, s in enumerate(sequences) if len(s)]
    pairs = [(sequences[i], labels[i]) for i in kept]
    names: dict[str, int] = {}
    for s, _ in pairs:
        for features in s:
            for f in features:
                names.setdefault(f, len(names))
    params = [np.zeros((len(names), n_labels)), np.zeros((n_kinds, n_labels, n_labels)), np.zeros(n_labels)]
    if not pairs:
        return Crf(names, *params)
    size = np.array([len(s) for s, _ in pairs])
    steps, n = int(size.max()), len(pairs)
    where = np.concatenate([i * steps + np.arange(len(s)) for i, (s, _) in enumerate(pairs)])
    y = np.concatenate([np.asarray(y) for _, y in pairs])
    kind = np.concatenate([np.asarray(kinds[i]) for i in kept])
    padded_kinds = np.zeros(n * steps, dtype=np.int64)
    padded_kinds[where] = kind
    padded_kinds = padded_kinds.reshape(n, steps)
    row = np.array([names[f] for s, _ in pairs for features in s for f in features], dtype=np.int64)
    of = np.repeat(np.arange(len(where)), [len(features) for s, _ in pairs for features in s])
    gold = [np.zeros_like(p) for p in params]
    np.add.at(gold[0], (row, y[of]), 1.0)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    np.add.at(gold[2], y[first], 1.0)
    inner = np.setdiff1d(np.arange(len(y)), first)
    np.add.at(gold[1], (kind[inner], y[inner - 1], y[inner]), 1.0)
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        own = np.stack([np.bincount(of, weights=params[0][row, k], minlength=len(where)) for k in range(n_labels)], axis=1)
        padded = np.zeros((n * steps, n_labels))
        padded[where] = own
        _, share, moves = likelihood(padded.reshape(n, steps, n_labels), padded_kinds, size, params[1], params[2])
        at = share.reshape(n * steps, n_labels)[where]
        expected = [np.stack([np.bincount(row, weights=at[of, k], minlength=len(names)) for k in range(n_labels)], axis=1), moves, share[:, 0].sum(axis=0)]
        for i, p in enumerate(params):
            slope = expected[i] - gold[i] + PENALTY * p
            mean[i] = 0.9 * mean[i] + 0.1 * slope
            square[i] = 0.99 * square[i] + 0.01 * slope ** 2
            p -= RATE * (mean[i] / (1 - 0.9 ** step)) / (np.sqrt(square[i] / (1 - 0.99 ** step)) + 1e-8)
    return Crf(names, *params)
