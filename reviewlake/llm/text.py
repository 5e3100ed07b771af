"""Array-at-a-time text work for Arrow batches: words, word hashes, shingle hashes.

Texts are cut into chunks of a bounded number of bytes (a single longer text is a chunk
of its own), each chunk is one byte array, and words are found with array operations; no
Python loop runs per word.  Hashes are 64-bit and depend only on the word, never on the
batch, so every task of every executor gives a word the same number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

CHUNK_BYTES = 1 << 20

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit words that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def draw(h: np.ndarray, step: int) -> np.ndarray:
    """The ``step``-th pseudo-random 64-bit word of the generators seeded with ``h``."""
    return mix64(h + _U(0x9E3779B97F4A7C15 * (step + 1) % 2**64))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_BASE = _U(0x9E3779B97F4A7C55)


def _separators(codes: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(codes)] = True
    return table


#: words are ``[^\x20\x09-\x0D]+``
SPACES = _separators([0x20, *range(0x09, 0x0E)])
#: the line end
LINE_END = 0x0A


@dataclass
class Words:
    """Words of a chunk of texts; ``offset[i]:offset[i + 1]`` are those of text ``i``."""

    buf: np.ndarray      # the bytes of the chunk, lower-cased A-Z
    start: np.ndarray    # first byte of each word
    end: np.ndarray      # byte after each word
    hash: np.ndarray     # uint64 per word
    offset: np.ndarray   # int64, one more than there are texts
    bounds: np.ndarray   # first byte of each text, and the end

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offset) - 1), np.diff(self.offset))


def encoded(texts: Iterable) -> list[bytes]:
    """UTF-8 bytes of each text (bytes stay as they are); null (None or NaN) is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t if isinstance(t, bytes) else b"" for t in texts]


def chunks(texts: Iterable, size: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts) of consecutive chunks of about ``size`` bytes."""
    part, first, held = [], 0, 0
    for i, b in enumerate(encoded(texts)):
        if part and held + len(b) > size:
            yield first, part
            part, first, held = [], i, 0
        part.append(b)
        held += len(b)
    if part:
        yield first, part


def words(part: list[bytes], separators: np.ndarray = SPACES, lower: bool = True) -> Words:
    """Words of the texts of one chunk, with a 64-bit hash of each."""
    joined = b" ".join(part) + b" "
    if lower:
        joined = joined.translate(_LOWER)
    buf = np.frombuffer(joined, dtype=np.uint8)
    bounds = np.zeros(len(part) + 1, dtype=np.int64)
    np.cumsum([len(b) + 1 for b in part], out=bounds[1:])
    inside = np.frombuffer(joined.translate((~separators).tobytes()), dtype=bool)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    offset = np.searchsorted(start, bounds)
    return Words(buf, start, end, spans_hash(buf, start, end), offset, bounds)


#: bytes of a chunk whose powers of the base are kept
_MOST_POWERS = 1 << 21
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of the base and of its inverse (mod 2^64), kept for the next chunk."""
    if len(_powers[0]) < n:
        n = min(_MOST_POWERS, -(-n // (1 << 18)) << 18)
        for i, base in enumerate((int(_BASE), pow(int(_BASE), -1, 2**64))):
            power = np.full(n, base, dtype=np.uint64)
            power[0] = 1
            _powers[i] = np.multiply.accumulate(power)
    return _powers


def spans_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and none is empty."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    size = (end - start).astype(np.uint64)
    if len(buf) < _MOST_POWERS:
        # sums of byte * base^place up to each byte; a span's own sum is a difference, moved to place 0
        power, inverse = _power(len(buf))
        total = np.empty(len(buf) + 1, dtype=np.uint64)
        total[0], sums = 0, total[1:]
        np.take(_BYTE, buf, out=sums, mode="clip")
        sums *= power[:len(buf)]
        np.cumsum(sums, out=sums)
        return mix64((total[end] - total[start]) * inverse[start] + size * _GOLDEN)
    size = end - start
    first = np.zeros(len(size), dtype=np.int64)
    np.cumsum(size[:-1], out=first[1:])
    within = np.arange(int(size.sum()), dtype=np.int64)
    at = within + np.repeat(start - first, size)
    within -= np.repeat(first, size)
    power = np.full(int(size.max()), _BASE, dtype=np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    value = _BYTE[buf[at]]
    value *= power[within]
    return mix64(np.add.reduceat(value, first) + size.astype(np.uint64) * _GOLDEN)


def sequence_hash(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive values of ``h`` (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= _BASE
        out += h[j:j + n]
    return mix64(out + _U(0x9E3779B97F4A7C15 * k % 2**64))


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles of each text of a chunk, sorted, end to end, and their offsets.

    A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    grams = sequence_hash(w.hash, k)
    sets, offset = [], np.zeros(len(w.offset), dtype=np.int64)
    for i in range(len(w.offset) - 1):
        a, b = w.offset[i], w.offset[i + 1]
        if b - a >= k:
            own = np.unique(grams[a:b - k + 1])
        elif b > a:
            own = sequence_hash(w.hash[a:b], int(b - a))
        else:
            own = grams[:0]
        sets.append(own)
        offset[i + 1] = offset[i] + len(own)
    return (np.concatenate(sets) if sets else grams[:0]), offset


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the long of the same bits."""
    return x.view(np.int64)
