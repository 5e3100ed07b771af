"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Documents are summed once to cells (source, language, topic) with their tokens.  The cells'
weights are raked: scaled to one margin's targets after the other until every margin agrees.
A document is then drawn with the probability its cell's weight asks for, by a hash of its
id, so a rerun on other executors draws the same documents.

DataFrame expressions only.  Raking works on the cell table, whose size is the number of
combinations that occur, not the number of documents; a margin is summed with map-side
combining, and each sweep's result is written, so a plan never grows with the sweeps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

SWEEPS = 60
TOLERANCE = 1e-9
SPACE = r"[ \t-\r]+"
#: (topic, pattern), the first that a text holds; texts with none are "prose"
TOPICS = (
    ("licence", "[Ll]icen[sc]ed under|Released under"),
    ("contact", "[a-z0-9.]+@[a-z0-9]+[.]"),
    ("list", "(?m)^(?:[-*]|[0-9]+[.]) "),
)


def token_count(t: Column) -> Column:
    """Words of the whole text; null and blank texts have none."""
    return F.size(F.array_remove(F.split(F.coalesce(t, F.lit("")), SPACE), "")).cast("long")


def topic_of(t: Column, topics: Sequence[tuple[str, str]] = TOPICS) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(topics):
        out = F.when(t.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def flattened_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(margin, target): each value's share of the tokens, to ``power``, made to sum to one.

    Powers below one lift rare values, 1 keeps the corpus as it is, 0 asks for equal shares.
    Values without tokens have no target and are not drawn.
    """
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("n")).where("n > 0")
    raised = sums.select(margin, F.pow(F.col("n").cast("double"), F.lit(power)).alias("r"))
    total = raised.agg(F.sum("r")).first()[0] or 1.0
    return raised.select(margin, (F.col("r") / total).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (margins..., tokens) with ``share``: the raked weight of each cell, summing to one.

    ``targets`` has a table (margin, target) for each margin; values are compared null-safe, and
    a null is a value like others.  Cells without tokens, or with a value that has no target,
    get share 0; the targets of values without tokens are spread over the rest by the raking.
    Ends after ``sweeps`` sweeps, or once no cell moves by more than ``tolerance`` of itself.
    """
    margins = list(targets)
    w = cells.where("tokens > 0")
    for m, t in targets.items():
        w = w.join(t.select(F.col(m).alias("t_value"), F.col("target").alias(f"t_{m}")), F.col(m).eqNullSafe(F.col("t_value")), "left").drop("t_value")
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    w = w.select(*margins, *[F.coalesce(f"t_{m}", F.lit(0.0)).alias(f"t_{m}") for m in margins],
                 (F.col("tokens") / F.lit(total)).alias("share"))
    w = written(w, "raked")
    for _ in range(sweeps):
        before = w.withColumn("was", F.col("share"))
        for m in margins:
            sums = before.groupBy(F.col(m).alias("value")).agg(F.sum("share").alias("have"))
            before = before.join(sums, F.col(m).eqNullSafe(F.col("value"))).withColumn(
                "share", F.when(F.col("have") > 0, F.col("share") * F.col(f"t_{m}") / F.col("have")).otherwise(F.lit(0.0))).drop("value", "have")
        after = written(before, "raked")
        moved = after.where("was > 0").agg(F.max(F.abs(F.col("share") / F.col("was") - 1))).first()[0]
        w = after.drop("was")
        if moved is None or moved <= tolerance:
            break
    total = w.agg(F.sum("share")).first()[0] or 1.0
    shares = w.select(*[F.col(m).alias(f"w_{m}") for m in margins], (F.col("share") / total).alias("share"))
    same = None
    for m in margins:
        c = F.col(m).eqNullSafe(F.col(f"w_{m}"))
        same = c if same is None else same & c
    return cells.join(shares, same, "left").select(*cells.columns, F.coalesce("share", F.lit(0.0)).alias("share"))


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the md5 of the key as text; a null key has its own."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, powers: Mapping[str, float], fraction: float, topics: Sequence[tuple[str, str]] = TOPICS,
        sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` (doc_id, text, source, lang) with tokens, topic, rate and copies.

    ``powers`` gives each margin (source, lang, topic) the power of ``flattened_targets``.
    ``rate`` is how often a document of its cell is drawn on average so that the drawn tokens
    are ``fraction`` of all tokens and have the raked margins; ``copies`` is the number drawn:
    the whole part of the rate, and one more with the probability of the rest.

    Null source, lang and topic are values of their own; null and blank texts have no tokens
    and no weight, and are drawn at their cell's rate (0 if the cell has no tokens).  Repeated
    rows count and are drawn each, alike.  An empty table gives an empty table; other columns
    pass unchanged, but for those named as the four new ones, which are replaced.
    """
    margins = list(powers)
    sized = docs.drop("rate", "copies").withColumns({"tokens": token_count(F.col("text")), "topic": topic_of(F.col("text"), topics)})
    cells = written(sized.groupBy(*margins).agg(F.sum("tokens").alias("tokens")), "cells")
    raked = rake(cells, {m: flattened_targets(cells, m, p) for m, p in powers.items()}, sweeps, tolerance)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    rates = written(raked.select(
        *[F.col(m).alias(f"__{m}") for m in margins],
        F.when(F.col("tokens") > 0, F.lit(fraction) * F.col("share") * total / F.col("tokens"))
        .otherwise(F.lit(0.0)).alias("rate")), "rates")
    same = None
    for m in margins:
        c = F.col(m).eqNullSafe(F.col(f"__{m}"))
        same = c if same is None else same & c
    whole = F.floor("rate")
    return (sized.join(rates, same, "left").drop(*[f"__{m}" for m in margins])
            .withColumn("copies", (whole + F.when(uniform(F.col("doc_id")) < F.col("rate") - whole, 1).otherwise(0)).cast("long")))
