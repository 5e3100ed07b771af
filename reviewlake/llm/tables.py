"""Written intermediate tables and fixed-size membership sketches."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table below the shared checkpoint folder, read again.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def plain_hashes(spark: SparkSession) -> Iterator[None]:
    """Tables written inside have no dictionaries, which do not shorten columns of hashes and take time to build."""
    name = "parquet.enable.dictionary"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def emptied(table: DataFrame) -> None:
    """Frees the disk of a table made by ``written``, which no frame that is still to run may read."""
    spark = table.sparkSession
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        spark.range(0).write.mode("overwrite").parquet(path)


SKETCH_BITS = 1 << 23


def probes(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two bit numbers for each 64-bit key."""
    u = keys.view(np.uint64)
    return [(u >> np.uint64(40)) % np.uint64(bits), (u & np.uint64(0xFFFFFFFF)) % np.uint64(bits)]


def membership_sketch(keys: DataFrame, column: str, bits: int = SKETCH_BITS, hashed: bool = False) -> np.ndarray:
    """A Bloom filter of the xxhash64 of ``column`` (or its own values, if ``hashed``): uint64 words, ``bits`` / 8 bytes at any input size.

    It only saves work: a filter that has filled up lets every row through to the exact join
    behind it.  Its words are built by a map-side combined ``bit_or``, so the driver receives
    at most ``bits`` / 64 rows.
    """
    h = F.col(column) if hashed else F.xxhash64(column)
    first = F.pmod(F.shiftrightunsigned(h, 40), F.lit(bits))
    second = F.pmod(h.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(bits))
    bit = F.explode(F.array(first, second))
    got = (keys.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("word"))
           .agg(F.expr("bit_or(shiftleft(1L, CAST(b & 63 AS INT)))").alias("mask")).toPandas())
    out = np.zeros((bits + 63) // 64, dtype=np.uint64)
    if len(got):
        out[got["word"].to_numpy(dtype=np.int64)] = got["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def in_sketch(sketch: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the xxhash64 values may be among the keys of the sketch."""
    hit = np.ones(len(hashes), dtype=bool)
    for b in probes(hashes, len(sketch) * 64):
        hit &= (sketch[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1
    return hit


def broadcast(spark: SparkSession, value):
    """A broadcast of driver-made values; callers state the size bound."""
    return spark.sparkContext.broadcast(value)
