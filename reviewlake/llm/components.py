"""Connected components of an edge table: union-find forests per task, then star contraction.

Edges never reach the driver.  Each round first lets every task replace its own edges by
the forest its union-find keeps (at most one edge per node and task), then moves every node
to its smallest neighbour with two joins; it ends when every component is a star.  Rounds grow
with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def _find(parent: dict[int, int], x: int) -> int:
    root = x
    while (up := parent.get(root, root)) != root:
        root = up
    while (up := parent.get(x, x)) != root:
        parent[x] = root
        x = up
    return root


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, smallest node joined to it within this batch) for the edges of each batch."""
    for pdf in batches:
        parent: dict[int, int] = {}
        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            x, y = _find(parent, a), _find(parent, b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        roots = [_find(parent, x) for x in nodes]
        yield pd.DataFrame({"u": np.array(nodes, dtype=np.int64), "v": np.array(roots, dtype=np.int64)})


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v longs): the smallest node reachable.

    Edges with a null end and loops are ignored, repeated edges count once; no edges give an
    empty table.
    """
    e = (edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
         .mapInPandas(_forest, "u long, v long").where("u > v").distinct())
    e = written(e, "edges")
    while not _stars(e):
        # large star: every node's larger neighbours point to its smallest
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.join(least, "u").where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")), "edges")
        # small star: a node and its smaller neighbours point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                                F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        e = written(small.where("u > v").distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether every node has one edge down, to a node that has none."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("root")).unionAll(
        e.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("root")))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("root").alias("root")).where(
        "down > 1 OR (down = 1 AND root = 1)").isEmpty()
