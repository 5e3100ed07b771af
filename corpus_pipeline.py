"""A training-data pipeline over the documents: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents.  All but the last return the columns of documents.

Null and empty texts are documents like others up to the last stage, which draws none without
words.  Repeated rows go through every stage as they are, but for line dedup, which takes rows
of one doc_id for one document, and near dedup, which keeps one row of a group.  Rows with a
null doc_id lose no lines and pass near dedup.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import decontaminate, line_dedup, mixing, near_dup, toxicity
from reviewlake.llm.registry import MIX_FRACTION, MIX_POWERS
from reviewlake.llm.tables import written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half; learns from the labels of the documents that are here."""
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = scored.where("score >= 0.5").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__mark"))
    return docs.join(bad, same, "left_anti")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are like an earlier line, however short; those with no word left after that go."""
    return line_dedup.dedup_lines(docs, drop_emptied=True, least=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates, and all that are in none."""
    return near_dup.keep_first(docs, k=5, percent=80)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than a trace of the benchmark."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target weights, with their rate and number of copies; none without words."""
    return mixing.mix(docs, MIX_POWERS, MIX_FRACTION).where("copies > 0 AND tokens > 0")


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", near_dedup),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
]

#: no SQL: the toxicity and near-duplicate stages are beyond it; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
