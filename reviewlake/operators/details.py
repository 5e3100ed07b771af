"""PR details: P1 and the five-way fan-in J1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.operators.common import DEFAULT_BUCKET_ROWS, keys_list, pos_bucket, sorted_items
from reviewlake.operators.feedback import agg_timeline, union_feedback, with_timeline_placeholder
from reviewlake.operators.files import FILE_COLUMNS, project_files


def project_pr(df: DataFrame, keys) -> DataFrame:
    """Flatten a PR record; ``description`` is the body or ``''``."""
    return df.select(*keys_list(keys), "title",
                     F.coalesce(F.nullif(F.col("body"), F.lit("")), F.lit("")).alias("description"),
                     F.col("base_ref").alias("base_branch"), F.col("head_ref").alias("head_branch"),
                     "author", "commits", "additions", "deletions", "changed_files")


def collect_files(files: DataFrame, keys, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Files of each PR as an ordered ``ARRAY<STRUCT>``, built in two levels."""
    k = keys_list(keys)
    fields = {c: F.col(c) for c in FILE_COLUMNS if c in files.columns}
    lvl1 = (files.withColumn("_b", pos_bucket("pos", bucket_rows))
            .repartition(*[F.col(c) for c in k], F.col("_b"))
            .groupBy(*k, "_b")
            .agg(sorted_items([F.col("pos")], fields).alias("_items")))
    return (lvl1.groupBy(*k)
            .agg(F.array_sort(F.collect_list(F.struct("_b", "_items"))).alias("_p"))
            .select(*k, F.flatten(F.transform("_p", lambda p: F.transform(
                p["_items"], lambda x: F.struct(*[x[c].alias(c) for c in fields])))).alias("files")))


def assemble_pr_details(prs: DataFrame, files: DataFrame, reviews: DataFrame | None,
                        review_comments: DataFrame | None, issue_comments: DataFrame | None,
                        keys, mode: str = "all") -> DataFrame:
    """PR record + ordered file list + feedback timeline, one row per PR.

    Each child is aggregated by the PR key before joining (no fan-out), and
    the joins are left joins: a PR without files gets an empty list, one
    without feedback the placeholder text.
    """
    k = keys_list(keys)
    pr = project_pr(prs, k)
    fl = collect_files(project_files(files, k), k)
    out = pr.join(fl, k, "left").withColumn(
        "files", F.coalesce(F.col("files"), F.array().cast(fl.schema["files"].dataType)))
    fb = union_feedback(reviews, review_comments, issue_comments, k, mode)
    if fb is not None:
        out = out.join(agg_timeline(fb, k, mode).select(*k, F.col("timeline").alias("reviews")), k, "left")
    else:
        out = out.withColumn("reviews", F.lit(None).cast("string"))
    return with_timeline_placeholder(out, "reviews")
