"""Exact top-k inner-product search: columnar branch-and-bound over blocks of vectors.

Vectors are dealt into blocks of bounded size by a hash of their id, and so are the queries.
Each pair of a vector block and a query block is one group: the vectors lie dimension by
dimension (vertical layout), the scores of a tile of queries are accumulated a few dimensions
at a time, the weightiest first, and after each step the candidates whose score so far plus
the most that the remaining mass can add (Cauchy-Schwarz) stays below every query's k-th best
are dropped and the survivors compacted.  Groups report their k best of each query; a ranked window keeps
the k best of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_VECTORS = 4096
BLOCK_QUERIES = 2048
TILE = 32     # queries that go through a block together
STEP = 16     # dimensions accumulated between two cuts
_EXACT = float(1 << 53)


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.int64) for v in vectors], dtype=np.int64)


def search_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the k best rows of one block for each query of a tile, ties to the smaller id.

    ``vectors`` is dimension by dimension (d x n), as doubles where every product sum stays
    exact in them; rows of a query's own id take no part.  ``ids`` ascend.
    """
    d, n = vectors.shape
    alive = np.arange(n)
    if vectors.dtype == np.int64:        # products may leave the exact range of doubles: no cuts
        score = queries @ vectors
    else:
        order = np.argsort(-(queries * queries).sum(axis=0), kind="stable")
        left, q = vectors[order], queries[:, order]
        rest_q = np.sqrt(np.concatenate((np.cumsum((q * q)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(q), 1))), axis=1))
        # a first bar: the k-th best full score of a few vectors, one more in case a query is among them
        few = min(n, max(4 * k, 64))
        bar = np.partition(q @ left[:, :few], -(k + 1), axis=1)[:, -(k + 1)] if few > k else np.full(len(q), -np.inf)
        score, mass = np.zeros((len(q), n)), (left * left).sum(axis=0)
        for s in range(0, d, STEP):
            part = left[s:s + STEP]
            score += q[:, s:s + STEP] @ part
            mass = mass - (part * part).sum(axis=0)
            if s + STEP < d:
                reach = score + rest_q[:, s + STEP, None] * np.sqrt(np.maximum(mass, 0.0)) * (1 + 1e-9) + 1e-3
                stay = (reach >= bar[:, None]).any(axis=0)
                if stay.mean() < 0.8:    # compact the survivors of the tile
                    alive, score, mass, left = alive[stay], score[:, stay], mass[stay], left[:, stay]
    out = []
    for row, mine in zip(score, own):
        at = np.flatnonzero(ids[alive] != mine)
        x = row[at]
        if len(x) > k:
            at = at[x >= np.partition(x, -k)[-k]]
        best = at[np.lexsort((ids[alive[at]], -row[at]))[:k]]
        out.append((ids[alive[best]], row[best].astype(np.int64)))
    return out


def _search(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        left = left.sort_values("vec_id")
        ids = left["vec_id"].to_numpy(dtype=np.int64)
        v, q = _matrix(left["v"]), _matrix(right["v"])
        d = v.shape[1]
        most = float(np.abs(v.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * max(d, 1)
        if most < _EXACT:
            v, q = v.astype(np.float64), q.astype(np.float64)
        v = np.ascontiguousarray(v.T)
        own = right["vec_id"].to_numpy(dtype=np.int64)
        out = [o for t in range(0, len(q), TILE) for o in search_block(v, ids, q[t:t + TILE], own[t:t + TILE], k)]
        return pd.DataFrame({"query_id": np.repeat(own, [len(o[0]) for o in out]),
                             "vec_id": np.concatenate([o[0] for o in out]), "score": np.concatenate([o[1] for o in out])})
    return run


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, dim, v): ``v`` holds floor(256 * x) of each component, x as double.

    Rows with a null id, a null vector, or a null or non-finite component take no part.  Rows
    repeating an id count once, as the smallest of their vectors.  Components beyond the range
    of a long divided by 256 are taken as its ends.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    most = F.lit(float(1 << 62))
    v = F.transform(x, lambda c: F.floor(F.greatest(F.least(F.lit(256.0) * c, most), -most)))
    valid = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok)
    one = valid.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    return one.select("vec_id", F.size("v").alias("dim"), "v")


def top_k(embeddings: DataFrame, is_query, k: int = 5, block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The ``k`` highest integer inner products of each query: query_id, rank, vec_id, score.

    ``embeddings`` has vec_id and embedding (an array of numbers; other columns are ignored);
    ``is_query`` is a Column telling which rows are queries, over vec_id.  Candidates are all rows but the
    query's own, of its dimension; all of them if there are fewer than ``k``.  Ties go to the
    smaller vec_id.  Scores beyond a long wrap, as long arithmetic does.  ``quantised`` says
    which rows take part; an empty table gives an empty table.
    """
    rows = quantised(embeddings)
    n, n_q = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks, query_blocks = max(1, math.ceil(n / block_vectors)), max(1, math.ceil(n_q / block_queries))
    own = F.xxhash64("vec_id")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    vectors = rows.select("dim", F.pmod(own, F.lit(blocks)).cast("int").alias("b"), "vec_id", "v", every(query_blocks).alias("qb"))
    queries = rows.where(is_query).select(
        "dim", every(blocks).alias("b"), "vec_id", "v", F.pmod(own, F.lit(query_blocks)).cast("int").alias("qb"))
    found = vectors.groupBy("dim", "b", "qb").cogroup(queries.groupBy("dim", "b", "qb")).applyInPandas(
        _search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
