"""Line deduplication: an exact set-similarity join of lines that removes later matches.

A line is the set of its distinct words.  Lines with equal sets fall into one class by a
128-bit fingerprint of the set, so a line repeated in every document costs one class.  Classes
are joined by prefix filtering: words are ordered by rarity, two sets of similarity t share one
of their rarest words, and only those prefixes meet.  The join's condition holds the length
filter, the positional filter and a bitmap filter (the parity of 128 hash bits differs in no
more places than the sets differ in words), so it emits next to the true matches alone; these
are verified on the full sets.

A line needs only one earlier match to go, so a group of near copies never emits all its
pairs.  Before the join every class is tested against the earliest class of each of its few
buckets of lines with the same pairs of smallest word hashes, on the full sets; the join then
leaves out pairs of two classes that have both lost all their lines already.

A set so small that one word more would break the similarity (1 to 3 words at 0.8; 4 words match
5 of which they are a part) can only match an equal set: its class settles it, without the join.

Rarity is counted over all words of all texts, in a table of 2^19 hashed counters, whose size
does not depend on the input.  The counters only order the words - any fixed order gives the
same matches - so words sharing a counter do no harm.  Every text is parsed once more, for its
lines' classes, prefixes and buckets; the full sets that are compared come from their own lines
alone, found by document and line number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .tables import broadcast, emptied, in_sketch, membership_sketch, plain_hashes, written

CELL_BITS = 19
CELLS = 1 << CELL_BITS
MIN_WORDS = 5
BLOCK = 1 << 10   # counters in one row of the table
BUCKETS = 5      # a class of similarity 0.8 to the earliest line shares none of its buckets once in 35
CROWD = 16       # buckets of fewer classes are left to the join: each class meets few others there
KEYS = [f"k{i}" for i in range(BUCKETS)]   # a class's bucket keys; null for classes that can match no others
LINES = f"doc_id long, mark long, line int, again boolean, fp1 long, fp2 long, n int, b1 long, b2 long, {' int, '.join(KEYS)} int, prefix array<int>"
LINE_FIELDS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("line", pa.int32()), ("again", pa.bool_()), ("fp1", pa.int64()),
                         ("fp2", pa.int64()), ("n", pa.int32()), ("b1", pa.int64()), ("b2", pa.int64()), *[(k, pa.int32()) for k in KEYS],
                         ("prefix", pa.list_(pa.int32()))])


class Lines:
    """The lines of a chunk of texts that have at least ``least`` distinct words, as word sets.

    A set's words are in the order of (``rank`` of their counter, hash), without ranks by hash.
    """

    def __init__(self, part: list[bytes], least: int, rank: np.ndarray | None = None):
        w = text.words(part)
        cut = np.flatnonzero(w.buf == text.LINE_END)
        cut = np.union1d(cut, w.bounds[1:-1] - 1)          # a text's end ends its last line
        ends = np.searchsorted(w.start, cut)
        line = np.repeat(np.arange(len(cut) + 1), np.diff(ends, prepend=0, append=len(w.start)))
        order = _order(line, w.hash, rank)
        h, line = w.hash[order], line[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        h, line = h[new], line[new]
        start = np.flatnonzero(np.diff(line, prepend=-1))
        size = np.diff(start, append=len(line))
        enough = size >= least
        keep = np.repeat(enough, size)
        self.hash, self.number, self.size = h[keep], line[start[enough]], size[enough]
        self.start = np.cumsum(self.size) - self.size
        # the text a line is in, and its number there
        first = np.searchsorted(cut, w.bounds[:-1])
        self.owner = np.searchsorted(first, self.number, side="right") - 1
        self.line = self.number - first[self.owner]
        self.fp = [np.add.reduceat(text.draw(self.hash, s), self.start) if len(self.start) else self.hash[:0] for s in (201, 202)]

    def buckets(self) -> np.ndarray:
        """(lines x BUCKETS) keys: the smallest hashes of a line's words under three hash functions each."""
        out = np.zeros((len(self.size), BUCKETS), dtype=np.uint64)
        for b in range(BUCKETS if len(self.size) else 0):
            low = [np.minimum.reduceat((self.hash ^ x) * y, self.start) for x, y in _SEEDS[3 * b:3 * b + 3]]
            out[:, b] = text.mix64((low[0] * np.uint64(31) + low[1]) * np.uint64(31) + low[2] + np.uint64(b))
        return out

    def parity(self) -> list[np.ndarray]:
        """The parity of each of 2 x 64 bits over the words of each line."""
        bit = np.uint64(1) << ((self.hash >> np.uint64(20)) & np.uint64(63))
        low = (self.hash >> np.uint64(26)) & np.uint64(1)
        halves = bit * low, bit * (low ^ np.uint64(1))
        return [np.bitwise_xor.reduceat(x, self.start) if len(self.start) else x for x in halves]

    def heads(self, keep: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of the first ``size`` words of the lines in ``keep``, end to end."""
        return self.hash[np.repeat(self.start[keep] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


_SEEDS = [(text.mix64(np.full(1, 300 + i))[0], text.mix64(np.full(1, 400 + i))[0] | np.uint64(1)) for i in range(3 * BUCKETS)]


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _order(line: np.ndarray, h: np.ndarray, rank: np.ndarray | None) -> np.ndarray:
    """What sorts by (line, rank of the counter, hash)."""
    place = rank[_cell(h)] if rank is not None else _cell(h)
    if len(line) and line[-1] < 1 << 20:
        # 20 bits of line, those of rank, and of the hash those that follow the counter's, down to the 20th
        rest = 44 - CELL_BITS
        key = (line.astype(np.uint64) << np.uint64(44)) | (place.astype(np.uint64) << np.uint64(rest)) | ((h >> np.uint64(20)) & np.uint64((1 << rest) - 1))
        order = np.argsort(key)
        k, x = key[order], h[order]
        if not ((k[1:] == k[:-1]) & (x[1:] != x[:-1])).any():
            return order
    return np.lexsort((h, place, line))


def _alone(size: np.ndarray, percent: int) -> np.ndarray:
    """Which sizes of a set allow no match but an equal set."""
    return 100 * size < percent * (size + 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counters of a task's words, a row for each block, in the fewest bytes that hold its largest."""
    counts = np.zeros(CELLS, dtype=np.int64)
    for batch in batches:
        for _, part in text.chunks(batch.column("text").cast(pa.binary()).to_pylist()):
            np.add.at(counts, _cell(text.words(part).hash), 1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CELLS // BLOCK), pa.int32()),
                                      pa.array([x.astype(np.min_scalar_type(x.max())).tobytes() for x in counts.reshape(-1, BLOCK)], pa.binary())],
                                     ["block", "counts"])


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK, dtype=np.int64)
    for x in pdf["counts"]:
        total += np.frombuffer(x, dtype=f"u{len(x) // BLOCK}").astype(np.int64)
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "counts": [total.tobytes()]})


def _ranks(rows: DataFrame) -> np.ndarray:
    """The place of each counter in the order of rarity; CELLS numbers whatever the input."""
    counted = rows.select("text").mapInArrow(_counts, "block int, counts binary")
    got = counted.groupBy("block").applyInPandas(_summed, "block int, counts binary").toPandas()
    counts = np.zeros((CELLS // BLOCK, BLOCK), dtype=np.int64)
    for block, x in zip(got["block"], got["counts"]):
        counts[block] = np.frombuffer(x, dtype=np.int64)
    rank = np.empty(CELLS, dtype=np.int32)
    rank[np.argsort(counts.ravel(), kind="stable")] = np.arange(CELLS, dtype=np.int32)
    return rank


def _lines(least: int, percent: int, ranks):
    """A row a line; the first of a class in a chunk that can match others has the class's bucket keys and prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        for batch in batches:
            ids, marks = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("mark").to_numpy(zero_copy_only=False)
            for first, part in text.chunks(batch.column("text").cast(pa.binary()).to_pylist()):
                x = Lines(part, least, rank)
                key = pd.DataFrame({"o": x.owner, "a": x.fp[0], "b": x.fp[1]})
                again = key.duplicated().to_numpy()
                new = np.flatnonzero(~key.duplicated(["a", "b"]).to_numpy() & ~_alone(x.size, percent))
                # one word more than may differ
                head = x.size[new] - (percent * x.size[new] + 99) // 100 + 1
                h = x.heads(new, head)
                held = np.zeros(len(again), dtype=np.int64)
                held[new] = head
                none = np.ones(len(again), dtype=bool)
                none[new] = False
                keys = (x.buckets() >> np.uint64(32)).astype(np.uint32).view(np.int32)
                bits = x.parity()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first + x.owner], pa.int64()), pa.array(marks[first + x.owner], pa.int64()), pa.array(x.line, pa.int32()),
                     pa.array(again), pa.array(text.signed(x.fp[0])), pa.array(text.signed(x.fp[1])), pa.array(x.size, pa.int32()),
                     pa.array(text.signed(bits[0])), pa.array(text.signed(bits[1])), *[pa.array(keys[:, b], mask=none) for b in range(BUCKETS)],
                     pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)), pa.int32()), pa.array(h.astype(np.uint32).view(np.int32)))],
                    schema=LINE_FIELDS)
    return run


def _place(doc_id: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The sketch's key of a line's place."""
    return text.mix64(doc_id.astype(np.int64).view(np.uint64) + text.mix64(line.astype(np.uint64))).view(np.int64)


def _sets(least: int, sketch):
    """The full sets of the lines whose places are in the sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, part in text.chunks(batch.column("text").cast(pa.binary()).to_pylist()):
                whole = b"\n".join(part)
                cut = np.flatnonzero(np.frombuffer(whole, dtype=np.uint8) == text.LINE_END)
                start, end = np.append(0, cut + 1), np.append(cut, len(whole))
                opens = np.searchsorted(start, np.cumsum([0] + [len(b) + 1 for b in part[:-1]]))   # each text's first line
                owner = np.searchsorted(opens, np.arange(len(start)), side="right") - 1
                keep = in_sketch(sketch.value, _place(ids[first + owner], np.arange(len(start)) - opens[owner]))
                x = Lines([whole[a:b] for a, b in zip(start[keep], end[keep])], least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(text.signed(x.fp[0])), pa.array(text.signed(x.fp[1])),
                     pa.array([x.hash[a:a + n].tobytes() for a, n in zip(x.start, x.size)], pa.binary())], ["fp1", "fp2", "words"])
    return run


def _similar(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["a_words"], pdf["b_words"]):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[keep, ["a1", "a2", "b1", "b2"]]
    return run


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sketch's keys, as in ``_sets``."""
    for pdf in batches:
        yield pd.DataFrame({"k": _place(pdf["doc_id"].to_numpy(), pdf["line"].to_numpy())})


def _near(percent: int):
    """Whether the sizes and the parities of a_ and b_ allow a match, and the least overlap that makes one."""
    together = F.col("a_n") + F.col("b_n")
    need = F.ceil(together * percent / F.lit(100.0 + percent) - F.lit(1e-9))
    apart = F.bit_count(F.col("a_b1").bitwiseXOR(F.col("b_b1"))) + F.bit_count(F.col("a_b2").bitwiseXOR(F.col("b_b2")))
    return (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (apart <= together - 2 * need), need


def _with_earliest(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a_c, b_c) of a class and the earliest class of one of its crowded buckets, if sizes and parities allow a match."""
    classes = classes.where(F.col(KEYS[0]).isNotNull())
    keys = F.explode(F.array(*KEYS)).alias("key")
    crowded = written(classes.select(keys).groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") >= CROWD).select("key"), "crowded")
    keyed = written(classes.select(keys, "begin", F.col("fp1").alias("a_c"), F.col("n").alias("a_n"), F.col("b1").alias("a_b1"), F.col("b2").alias("a_b2"))
                    .join(crowded, "key"), "keyed")
    head = keyed.groupBy("key").agg(F.min(F.struct("begin", "a_c", "a_n", "a_b1", "a_b2")).alias("head")).select(
        "key", F.col("head.a_c").alias("b_c"), F.col("head.a_n").alias("b_n"), F.col("head.a_b1").alias("b_b1"), F.col("head.a_b2").alias("b_b2"))
    near, _ = _near(percent)
    return written(keyed.join(head, "key").where((F.col("a_c") != F.col("b_c")) & near).select("a_c", "b_c").distinct(), "pairs")


def _losers_of(pairs: DataFrame, rows: DataFrame, classes: DataFrame, least: int, percent: int, name: str) -> DataFrame:
    """(fp1, fp2): of each pair of classes whose full sets, read from their lines again, are similar, the one that loses."""
    wanted = pairs.select(F.col("a_c").alias("c")).unionAll(pairs.select(F.col("b_c").alias("c"))).distinct()
    wanted = written(classes.select(F.col("fp1").alias("c"), "fp2", "begin").join(wanted, "c"), f"{name}-wanted")
    sketch = broadcast(rows.sparkSession, membership_sketch(wanted.select("begin.doc_id", "begin.line").mapInPandas(_placed, "k long"), "k", hashed=True))
    sets = rows.select("doc_id", "text").mapInArrow(_sets(least, sketch), "fp1 long, fp2 long, words binary")
    sets = written(sets.join(wanted.select("c"), F.col("fp1") == F.col("c"), "left_semi").dropDuplicates(["fp1", "fp2"]), f"{name}-sets")
    both = (pairs.join(sets.select(F.col("fp1").alias("a_c"), F.col("fp1").alias("a1"), F.col("fp2").alias("a2"), F.col("words").alias("a_words")), "a_c")
            .join(sets.select(F.col("fp1").alias("b_c"), F.col("fp1").alias("b1"), F.col("fp2").alias("b2"), F.col("words").alias("b_words")), "b_c"))
    links = written(both.select("a1", "a2", "b1", "b2", "a_words", "b_words").mapInPandas(
        _similar(percent), "a1 long, a2 long, b1 long, b2 long"), f"{name}-links")
    emptied(sets)
    return _losers(links, wanted.select(F.col("c").alias("fp1"), "fp2", "begin"))


def _losers(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(fp1, fp2): of two similar classes, the one that begins later loses all its lines.

    Classes that begin at one line number of one doc_id (which several rows have) are ordered by
    their fingerprints, so that the early and the late pass take the same side.
    """
    at = lambda p: classes.select(F.col("fp1").alias(f"{p}1"), F.col("fp2").alias(f"{p}2"), F.col("begin").alias(f"{p}_begin"))
    placed = links.join(at("a"), ["a1", "a2"]).join(at("b"), ["b1", "b2"])
    after = F.struct("a_begin", "a1", "a2") > F.struct("b_begin", "b1", "b2")
    later = F.when(after, F.struct(F.col("a1").alias("fp1"), F.col("a2").alias("fp2"))).otherwise(
        F.struct(F.col("b1").alias("fp1"), F.col("b2").alias("fp2")))
    return placed.select(later.alias("x")).select("x.fp1", "x.fp2").distinct()


def line_removals(docs: DataFrame, percent: int = 80, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, mark, removed): the numbers (from 0) of the lines to remove, for documents that have any.

    Lines end with a line feed.  A line is removed if an earlier line, by (doc_id, line number),
    has a word set of Jaccard similarity >= ``percent`` / 100; words are ``[^\\x20\\x09-\\x0D]+``,
    A-Z lower-cased.  Whether that earlier line is itself removed does not matter.  Lines of
    fewer than ``least`` distinct words (so empty ones too) always stay.

    ``mark`` is a hash of the text.  Null and empty texts have no lines; documents with a null
    doc_id neither lose lines nor cost others theirs.  Rows repeating a doc_id are one document: of
    similar lines with one number, the one with the least fingerprint stays.  An empty table
    gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text")).where("doc_id IS NOT NULL")
    order = broadcast(spark, _ranks(rows))
    with plain_hashes(spark):
        found = written(rows.select("doc_id", "mark", "text").mapInArrow(_lines(least, percent, order), LINES), "found")
        classes = written(found.where("NOT again").groupBy("fp1", "fp2").agg(
            F.min(F.struct("doc_id", "line")).alias("begin"), F.count("*").alias("texts"), *[F.max(x).alias(x) for x in ("n", "b1", "b2", *KEYS, "prefix")]), "classes")
    lines = written(found.select("doc_id", "mark", "line", "again", "fp1", "fp2"), "lines")
    emptied(found)
    early = written(_losers_of(_with_earliest(classes, percent), rows, classes, least, percent, "early"), "early")
    gone = early.select(F.col("fp1").alias("c"), F.lit(True).alias("lost"))
    prefix = classes.where(F.size("prefix") > 0).select(F.col("fp1").alias("c"), "n", "b1", "b2", "prefix").join(gone, "c", "left")
    prefix = prefix.select("c", "n", "b1", "b2", "lost", F.posexplode("prefix").alias("i", "word"))
    # none of these is ever null; said here, as the join would else say it below one side's shuffle alone
    prefix = prefix.select("word", "c", "n", "i", "b1", "b2", "lost").where(
        " AND ".join(f"{x} IS NOT NULL" for x in ("word", "c", "n", "b1", "b2"))).repartition("word")
    a, b = (prefix.select("word", *[F.col(x).alias(f"{p}_{x}") for x in ("c", "n", "i", "b1", "b2", "lost")]) for p in "ab")
    near, need = _near(percent)
    # the side of the smaller set needs the words alone that may be the first shared with a set no smaller;
    # rand() is below 1 and not below 0, and keeps the filter above the shuffle, which both sides then share
    most = F.col("b_n") - F.ceil(F.col("b_n") * 2 * percent / F.lit(100.0 + percent) - F.lit(1e-9))
    b = b.where(F.rand(0) < F.when(F.col("b_i") <= most, 1.0).otherwise(0.0))
    smaller = (F.col("a_n") > F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_c") < F.col("b_c")))
    # the first word that two similar sets share is early in both
    first = (F.col("a_i") <= F.col("a_n") - need) & (F.col("b_i") <= F.col("b_n") - need)
    after = F.least(F.col("a_n") - F.col("a_i"), F.col("b_n") - F.col("b_i"))
    near = smaller & near & first & (F.least("a_i", "b_i") + after >= need) & (F.col("a_lost").isNull() | F.col("b_lost").isNull())
    pairs = written(a.join(b, "word").where(near).select("a_c", "b_c").distinct(), "pairs")
    late = _losers_of(pairs, rows, classes, least, percent, "late")
    losers = written(early.unionAll(late).distinct().withColumn("lost", F.lit(True)), "losers")
    # classes of one text that keep their lines settle nothing
    fate = classes.select("fp1", "fp2", F.col("begin.doc_id").alias("first"), "texts").join(losers, ["fp1", "fp2"], "left")
    fate = written(fate.where("lost OR texts > 1").select("fp1", "fp2", "first", "lost"), "fates")
    emptied(classes)
    gone = lines.join(fate, ["fp1", "fp2"], "left").where("again OR lost OR doc_id <> first")
    return gone.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def _joined(docs: DataFrame, options: dict) -> DataFrame:
    gone = line_removals(docs, **options).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("removed").alias("__removed"))
    here = F.xxhash64(F.col("text").cast("string"))
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col("__id")) & (here == F.col("__mark")), "left")


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines and removed (the line numbers that go, an empty array for none) of each row."""
    here = F.col("text").cast("string")
    sized = docs.select("doc_id", F.xxhash64(here).alias("mark"),
                        F.coalesce(F.octet_length(here) - F.octet_length(F.replace(here, F.lit("\n"), F.lit(""))) + 1, F.lit(1)).alias("n_lines"))
    gone = line_removals(docs, **options).select(F.col("doc_id").alias("g_id"), F.col("mark").alias("g_mark"), "removed")
    return sized.join(gone, (F.col("doc_id") == F.col("g_id")) & (F.col("mark") == F.col("g_mark")), "left").select(
        "doc_id", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame, drop_emptied: bool = False, **options) -> DataFrame:
    """``docs`` with the lines of ``line_removals`` taken out of ``text``; all columns stay.

    ``n_chars``, where there is such a column, is counted anew for the texts that changed.
    With ``drop_emptied``, rows that lost lines and have no word left go; else all rows stay.
    """
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__removed", i)), "\n")
    out = _joined(docs, options).withColumn("text", F.when(F.col("__removed").isNull(), F.col("text")).otherwise(rest))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    if drop_emptied:
        out = out.where(F.col("__removed").isNull() | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return out.select(*docs.columns)
