"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find groups.

A document is the set of its distinct k-word shingles.  Documents with equal sets collapse
into one class by a 128-bit set fingerprint before anything else, so thousands of copies cost
one signature row.  SuperMinHash (Ertl 2017) gives every shingle a random permutation of the
m slots and a fresh random value at each of its ranks; a slot keeps the smallest rank + value
it met, and a document stops at the rank that can no longer lower any slot - after one or two
ranks for a long text.  Bands of slots propose links, links are confirmed on the full sets,
and confirmed links are grouped.

A bucket never emits all its pairs.  Its members are first tested against its smallest one;
members that are then in the same component need no further test.  Only buckets still holding
several components go on, testing further members against those of other
components, until no untested pair of different components is left in any bucket.  Most of
these pairs are near misses; the parity of each of 1024 hash bits over a set, which differs in
no more places than the sets differ in shingles, rules them out before sets are intersected.
The new links of a round join components; the links of earlier rounds are not gone over again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text
from .components import connected_components
from .tables import broadcast, emptied, in_sketch, membership_sketch, written

BANDS, ROWS = 24, 4   # a pair of similarity 0.8 shares no band with probability 3e-6
# one bit of each slot, two longs: in which of the 96 slots two documents differ in that bit follows
# a binomial law of mean 9.6 at similarity 0.8; a pair of 0.8 differs in more than 25 once in 10^6
MOST_BITS_APART = 25
PARITY_WORDS = 16
SIGNATURE = "doc_id long, n_shingles long, fp1 long, fp2 long, bits1 long, bits2 long, bands array<long>"


def super_minhash(h: np.ndarray, offset: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (texts x m, uint64: rank in the high half, value in the low).

    ``h[offset[i]:offset[i + 1]]`` are the hashed elements of set ``i``; an empty set has the
    largest value in every slot.
    """
    n = len(offset) - 1
    sig = np.full(n * m, np.iinfo(np.uint64).max, dtype=np.uint64)
    base = np.repeat(np.arange(n, dtype=np.int64) * m, np.diff(offset))
    perm = None
    half = np.uint64(32)
    for rank in range(m):
        if not len(h):
            break
        x = text.draw(h, rank)
        pick = rank + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - rank)) >> half).astype(np.int64)
        if rank == 0:
            slot, first_pick = pick, pick
        else:
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint16), (len(h), 1))
                row = np.arange(len(h))
                perm[row, first_pick] = 0
                perm[:, 0] = first_pick
            row = np.arange(len(h))
            slot = perm[row, pick].astype(np.int64)
            perm[row, pick] = perm[:, rank]
            perm[:, rank] = slot
        np.minimum.at(sig, base + slot, (np.uint64(rank) << half) | (x >> half))
        open_ = sig.reshape(n, m).max(axis=1) >= (np.uint64(rank + 1) << half)
        go = open_[base // m]
        if not go.all():
            h, base = h[go], base[go]
            if rank == 0:
                first_pick = first_pick[go]
            else:
                perm = perm[go]
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One long per text and band; the band's number is part of it."""
    out = np.empty((len(sig), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(sig), np.uint64(b + 1), dtype=np.uint64)
        for r in range(rows):
            key = text.mix64(key * np.uint64(31) + sig[:, b * rows + r])
        out[:, b] = key
    return text.signed(out)


def _signatures(k: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy()
            for first, part in text.chunks(pdf["text"]):
                h, offset = text.shingle_sets(text.words(part), k)
                size = np.diff(offset)
                sig = super_minhash(h, offset, bands * rows)
                keys = band_keys(sig, bands, rows)
                bits = text.mix64(sig) & np.uint64(1)
                weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
                half = (bands * rows + 1) // 2
                sketch = [text.signed((x * weight[:x.shape[1]]).sum(axis=1, dtype=np.uint64)) for x in (bits[:, :half], bits[:, half:])]
                # sums of two hashes of the elements: equal sets have equal sums
                total = [np.concatenate(([0], np.cumsum(text.draw(h, s)))).astype(np.uint64) for s in (101, 102)]
                fp = [text.signed(t[offset[1:]] - t[offset[:-1]]) for t in total]
                yield pd.DataFrame({"doc_id": ids[first:first + len(part)], "n_shingles": size, "fp1": fp[0], "fp2": fp[1],
                                    "bits1": sketch[0], "bits2": sketch[1],
                                    "bands": [list(x) if s else [] for x, s in zip(keys, size)]})
    return run


def parity(h: np.ndarray) -> np.ndarray:
    """The parity of each of 1024 bits over the hashed elements of one set, as longs."""
    odd = np.bincount((h & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _candidate_sets(k: int, sketch):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[in_sketch(sketch.value, pdf["h"].to_numpy(dtype=np.int64))]
            ids = pdf["doc_id"].to_numpy()
            for first, part in text.chunks(pdf["text"]):
                h, offset = text.shingle_sets(text.words(part), k)
                yield pd.DataFrame({"node": ids[first:first + len(part)],
                                    "parity": [parity(h[a:b]) for a, b in zip(offset[:-1], offset[1:])],
                                    "shingles": [h[a:b].tobytes() for a, b in zip(offset[:-1], offset[1:])]})
    return run


def _similar(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["a_set"], pdf["b_set"]):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[keep, ["u", "v"]]
    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a_set"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b_set"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a_set", "b_set").mapInPandas(_similar(percent), "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string; other columns are ignored).

    Returns doc_id, n_shingles (size of the set of distinct ``k``-word shingles), component_id
    (the smallest doc_id reachable over links of Jaccard similarity >= ``percent`` / 100) and
    kept (doc_id = component_id).  Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, A-Z
    lower-cased; a text of fewer than ``k`` words is one shingle.

    Null, empty and wordless texts have no shingles and are linked with nothing.  A null
    doc_id has a null component_id, links nothing and is kept.  Rows repeating a doc_id are
    copies of one document if their sets are equal, and otherwise share the id alone; each
    row is returned.  An empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = written(docs.mapInPandas(_signatures(k, bands, rows), SIGNATURE), "signatures")
    classes = written(sig.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("fp1", "fp2")
                      .agg(F.min("doc_id").alias("rep")), "classes")
    lead = written(sig.join(classes.select(F.col("rep").alias("doc_id"), "fp1", "fp2"), ["doc_id", "fp1", "fp2"], "left_semi")
                   .select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bits1", "bits2", "bands")
                   .dropDuplicates(["node"]), "lead")
    groups = _groups(docs, lead, k, percent)
    return (sig.join(classes, ["fp1", "fp2"], "left").join(groups, F.col("rep") == F.col("node"), "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep"))
                    .otherwise(F.col("doc_id")).alias("c"))
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"),
                    F.coalesce(F.col("doc_id") == F.col("c"), F.lit(True)).alias("kept")))


def _groups(docs: DataFrame, lead: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component): what the confirmed links among documents sharing a bucket connect."""
    spark = docs.sparkSession
    slots = lead.select(F.explode("bands").alias("key"), "node")
    shared = written(slots.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("size"))
                     .where("size > 1"), "buckets")
    members = written(slots.join(shared, "key").select("key", "node", "first", "size"), "members")
    profile = lead.select("node", "n", "bits1", "bits2")

    def plausible(pairs: DataFrame) -> DataFrame:
        """Pairs (u, v), once each, whose sizes and signature bits allow a link."""
        a = profile.select(F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("bits1").alias("u1"), F.col("bits2").alias("u2"))
        b = profile.select(F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("bits1").alias("v1"), F.col("bits2").alias("v2"))
        return pairs.distinct().join(a, "u").join(b, "v").where(_close(percent)).select("u", "v")

    sketch = broadcast(spark, membership_sketch(members, "node"))
    wanted = members.select("node").distinct()
    sets = (docs.withColumn("h", F.xxhash64("doc_id")).mapInPandas(_candidate_sets(k, sketch), "node long, parity array<long>, shingles binary")
            .join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    sets = written(sets, "sets")
    pairs = plausible(members.where("node > first").select(F.col("node").alias("u"), F.col("first").alias("v")))
    links = written(_confirmed(written(pairs, "pairs"), sets, percent), "links")
    rest = members.where("size > 2").join(profile, "node").select("key", "node", "n", "bits1", "bits2")
    parities = sets.select("node", "parity")
    rest = rest.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("node")) - 1)
    groups, tested = written(connected_components(links), "groups"), 1
    while True:
        rest = rest.drop("c").join(groups, "node", "left").select(
            "key", "node", "n", "bits1", "bits2", "rank", F.coalesce("component", "node").alias("c"))
        # a bucket goes on while it holds several components and members that were no pivot yet
        several = rest.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("rank").alias("last"),
                                          F.min_by("c", "rank").alias("head")).where(
            (F.col("lo") < F.col("hi")) & (F.col("last") > tested)).select("key", "head")
        rest = written(rest.join(several, "key").withColumn("main", F.col("c") == F.col("head")).drop("head"), "rest")
        if rest.isEmpty():
            emptied(sets)
            return groups
        more = 8 * tested + 1
        full = rest.join(parities, "node")
        # members of the first member's component, mostly nearly all, never meet each other
        sides = F.when(F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
        pivot = full.where((F.col("rank") >= tested) & (F.col("rank") < more)).select(
            "key", F.explode(sides).alias("main"), F.col("node").alias("v"), F.col("rank").alias("v_rank"), F.col("c").alias("v_c"),
            F.col("n").alias("n_v"), F.col("bits1").alias("v1"), F.col("bits2").alias("v2"),
            F.col("parity").alias("p_v"))
        other = full.select("key", "main", F.col("node").alias("u"), "rank", "c", F.col("n").alias("n_u"),
                            F.col("bits1").alias("u1"), F.col("bits2").alias("u2"), F.col("parity").alias("p_u"))
        pairs = other.join(pivot, ["key", "main"]).where((F.col("rank") > F.col("v_rank")) & (F.col("c") != F.col("v_c"))
                                              & _close(percent) & _parities(percent))
        # a written table has a size: few pairs are sent to the sets, which then stay where they are
        pairs = written(pairs.select("u", "v").distinct(), "pairs")
        tested = more
        if not pairs.isEmpty():
            found = written(_confirmed(pairs, sets, percent), "links")
            if not found.isEmpty():
                groups = written(_merged(groups, found), "groups")


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (node, component) after ``links`` (u, v) between its nodes or nodes of no group."""
    for end in ("u", "v"):
        at = groups.select(F.col("node").alias(end), "component")
        links = links.join(at, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    moved = connected_components(links).select(F.col("node").alias("old"), F.col("component").alias("new"))
    return groups.join(moved, F.col("component") == F.col("old"), "full").select(
        F.coalesce("node", "old").alias("node"), F.coalesce("new", "component").alias("component"))


def _close(percent: int):
    """Whether the set sizes (exactly) and the signature bits (but for once in 10^6) allow a link."""
    small, large = F.least("n_u", "n_v"), F.greatest("n_u", "n_v")
    apart = F.bit_count(F.col("u1").bitwiseXOR(F.col("v1"))) + F.bit_count(F.col("u2").bitwiseXOR(F.col("v2")))
    return (100 * small >= percent * large) & (apart <= MOST_BITS_APART)


def _parities(percent: int):
    """Whether the parities differ in no more places than sets of such sizes and this overlap can."""
    apart = F.lit(0)
    for i in range(PARITY_WORDS):
        apart = apart + F.bit_count(F.col("p_u")[i].bitwiseXOR(F.col("p_v")[i]))
    # of u + v elements, an overlap of o leaves u + v - 2 * o; similar sets have (100 + percent) * o >= percent * (u + v)
    return (100 + percent) * apart <= (100 - percent) * (F.col("n_u") + F.col("n_v"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that have a smaller near duplicate; columns unchanged."""
    gone = near_duplicates(docs, **options).where("NOT kept").select(F.col("doc_id").alias("__gone_id"))
    return docs.join(gone, docs["doc_id"] == F.col("__gone_id"), "left_anti")
