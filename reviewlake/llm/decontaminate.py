"""Benchmark decontamination: test n-gram windows, found by their rarest-looking word, verified word by word.

Every 13-word window of a benchmark item is found through one anchor, its longest word (the
first of equals): the anchors of all windows form the hash table that training words are
looked up in.  A training word that is an anchor is lined up with the item and the run of
equal words around it is measured; a run that holds a whole window marks its words as hit.
A passage of 50 words has four or five anchors, so a copy of it costs that many rows, not one
per window.

DataFrame expressions only.  The anchor table is joined without a hint: Spark broadcasts it
while it is small and shuffles by word otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(t: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does just that to a text of ASCII alone."""
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))


def word_array(t: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(t, F.lit(""))), NOT_WORD), "")


def anchors(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(anchor, item_id, at, item): the item positions that between them lie in every window.

    ``at`` counts from 0; ``item`` holds the item's words.  Rows are distinct, so repeated
    items cost nothing more.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), word_array(F.col("text").cast("string")).alias("item"))
    items = items.where(F.size("item") > 0).distinct()
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("item") - window, F.lit(0)))).alias("start")
    # the longest word of the window, the first of equals
    best = F.array_max(F.transform(F.slice(F.col("item"), F.col("start") + 1, window),
                                   lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"))))
    at = items.select("item_id", "item", start).select("item_id", "item", (F.col("start") - best["i"]).alias("at"))
    return at.distinct().select(F.get("item", F.col("at")).alias("anchor"), "item_id", "at", "item")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, mark, item_id, first, last, whole): runs of words equal to an item's, around an anchor.

    ``whole`` tells whether the run holds a whole window.

    ``mark`` tells rows repeating a doc_id with another text apart; positions count from 0.
    """
    words = docs.select(F.col("doc_id"), F.xxhash64("text").alias("mark"), word_array(F.col("text")).alias("words"))
    at = words.select("doc_id", "mark", "words", F.posexplode("words").alias("pos", "word"))
    hit = at.join(anchors(benchmark, window), F.col("word") == F.col("anchor"))

    # only the words around the anchor leave the join; a document's words stay in its row
    start = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    hit = hit.select("doc_id", "mark", "item_id", "at", "item", "pos", (F.col("pos") - start).alias("rel"),
                     F.slice("words", start + 1, F.col("pos") - start + window).alias("around"))

    def run(step: int) -> Column:
        """How many words next to the anchor, one way, are equal; at most a window less one."""
        same = F.transform(F.sequence(F.lit(1), F.lit(window - 1)), lambda o: F.when(
            F.get("around", F.col("rel") + step * o) == F.get("item", F.col("at") + step * o), F.lit("1")).otherwise(F.lit("0")))
        return F.length(F.substring_index(F.concat(F.array_join(same, ""), F.lit("0")), "0", 1))

    # the test is a column: as a filter it would move into the join, which then leaves generated
    # code and copies a document's words for each of them
    return (hit.select("doc_id", "mark", "item_id", "pos", run(-1).alias("back"), run(1).alias("on"), F.size("item").alias("n"))
            .select("doc_id", "mark", "item_id", (F.col("pos") - F.col("back")).alias("first"), (F.col("pos") + F.col("on")).alias("last"),
                    (F.col("back") + F.col("on") + 1 >= F.least(F.col("n"), F.lit(window))).alias("whole")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text).

    Returns doc_id, n_words, n_hit (words inside an occurrence of a window), n_items (items
    with occurring windows), items_sha256 (their ids, sorted as strings and comma-joined),
    contaminated (n_hit > 0 and 20 * n_hit >= n_words), spans (array of the first and last word
    of the runs hit) and mark (a hash of the text).  An item of fewer than ``window`` words is one window; an item
    without words is none.

    Null and empty texts have no words and are clean; a null doc_id is a row like others.
    Repeated rows each get the same result.  No items, or no documents, is no hit and no row.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = occurrences(docs, benchmark, window).groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_set(F.when(F.col("whole"), F.struct("first", "last")))).alias("spans"),
        F.collect_set(F.when(F.col("whole"), F.col("item_id"))).alias("items"))
    # length of the union of the runs, which are in the order of their starts
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("upto")), lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(acc["upto"] + 1, s["first"]) + 1)).alias("n"),
        F.greatest(acc["upto"], s["last"]).alias("upto")))["n"]
    found = found.select(F.col("doc_id").alias("f_id"), F.col("mark").alias("f_mark"), covered.alias("hit"), "items", "spans")
    sized = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.size(word_array(F.col("text"))).alias("n_words"))
    n_hit = F.coalesce(F.col("hit"), F.lit(0)).cast("long")
    joined = sized.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("mark") == F.col("f_mark")), "left")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return joined.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "spans", "mark")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that ``contamination`` marks; columns unchanged."""
    marked = F.xxhash64(F.col("text").cast("string"))
    bad = contamination(docs, benchmark, window).where("contaminated").select(
        F.col("doc_id").alias("__bad_id"), F.col("mark").alias("__bad_mark")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__bad_id")) & (marked == F.col("__bad_mark")), "left_anti")
