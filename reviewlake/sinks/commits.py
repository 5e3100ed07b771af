"""Commit markers: an append-only table of one-row files that says which folders of a sink count.

A marker is written after the folder it names and becomes visible as a whole (Spark's file
committer renames one finished file), so a reader sees a folder whole or not at all, whatever
became of the job that wrote it. Markers need no locks and no file-system handles.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER_SCHEMA = "name string, number long, committed_at timestamp"


def read_or_none(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The Parquet table at ``path``, or None if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def commit(spark: SparkSession, base: str, name: str, number: int = 0) -> None:
    """Make the folder ``name`` of the sink at ``base`` count from now on."""
    row = spark.range(1, numPartitions=1).select(F.lit(name).alias("name"), F.lit(number).cast("long").alias("number"),
                                                 F.current_timestamp().alias("committed_at"))
    row.write.mode("append").parquet(f"{base}/commits")


def committed(spark: SparkSession, base: str) -> DataFrame:
    """One row per committed folder: name, number, committed_at (the first, if it was committed again)."""
    markers = read_or_none(spark, f"{base}/commits", MARKER_SCHEMA)
    if markers is None:
        markers = spark.createDataFrame([], MARKER_SCHEMA)
    return markers.groupBy("name").agg(F.max("number").alias("number"), F.min("committed_at").alias("committed_at"))
