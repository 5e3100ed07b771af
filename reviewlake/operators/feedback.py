"""Feedback operators: P3 P4 U1 O1 A4 A6 (renderers F6 F7 live in functions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake import constants as C
from reviewlake.functions.feedback import render_feedback
from reviewlake.functions.text import js_trim
from reviewlake.operators.common import (DEFAULT_BUCKET_ROWS, join_field, keys_list, pos_bucket,
                                         sorted_items)

UNIFIED = ["type", "kind_rank", "pos", "author", "state", "content", "file", "line", "submitted_at"]
KIND_RANK = {k: i for i, k in enumerate(C.FEEDBACK_KINDS)}


def _author(c: str = "author") -> Column:
    return F.coalesce(F.col(c), F.lit(C.GHOST_AUTHOR))


def _typed(kind: str) -> list[Column]:
    return [F.lit(kind).alias("type"), F.lit(KIND_RANK[kind]).alias("kind_rank")]


def project_reviews(df: DataFrame, keys, mode: str = "all") -> DataFrame:
    k = keys_list(keys)
    if mode == "all":
        content = F.coalesce(F.col("body"), F.lit(""))
        src = df
    else:
        trimmed = F.coalesce(js_trim(F.col("body")), F.lit(""))
        src = df.where(~F.col("state").eqNullSafe("COMMENTED") | (trimmed != ""))
        content = trimmed
    return src.select(*k, *_typed("review_decision"), F.col("pos").cast("bigint").alias("pos"),
                      _author().alias("author"), F.col("state"), content.alias("content"),
                      F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"),
                      F.col("submitted_at"))


def project_review_comments(df: DataFrame, keys, mode: str = "all") -> DataFrame:
    k = keys_list(keys)
    if mode == "all":
        content, line, src = F.coalesce(F.col("body"), F.lit("")), F.col("line"), df
    else:
        trimmed = F.coalesce(js_trim(F.col("body")), F.lit(""))
        src = df.where(trimmed != "")
        content = trimmed
        line = F.coalesce(F.nullif(F.col("line"), F.lit(0)), F.col("position"))
    return src.select(*k, *_typed("review_comment"), F.col("pos").cast("bigint").alias("pos"),
                      _author().alias("author"), F.lit(None).cast("string").alias("state"),
                      content.alias("content"), F.col("path").alias("file"),
                      line.cast("int").alias("line"), F.col("created_at").alias("submitted_at"))


def project_issue_comments(df: DataFrame, keys, mode: str = "all") -> DataFrame:
    k = keys_list(keys)
    if mode == "all":
        content, src = F.coalesce(F.col("body"), F.lit("")), df
    else:
        trimmed = F.coalesce(js_trim(F.col("body")), F.lit(""))
        src, content = df.where(trimmed != ""), trimmed
    return src.select(*k, *_typed("issue_comment"), F.col("pos").cast("bigint").alias("pos"),
                      _author().alias("author"), F.lit(None).cast("string").alias("state"),
                      content.alias("content"), F.lit(None).cast("string").alias("file"),
                      F.lit(None).cast("int").alias("line"), F.col("created_at").alias("submitted_at"))


def project_feedback(df: DataFrame, kind: str, keys, mode: str = "all") -> DataFrame:
    """P3 (mode ``all``) / P4 (mode ``non_empty``) for one feedback kind."""
    fn = {"review_decision": project_reviews, "review_comment": project_review_comments,
          "issue_comment": project_issue_comments}[kind]
    return fn(df, keys, mode)


def union_feedback(reviews: DataFrame | None, review_comments: DataFrame | None,
                   issue_comments: DataFrame | None, keys, mode: str = "all") -> DataFrame | None:
    """UNION ALL of the three projected kinds; a missing input counts as empty."""
    parts = []
    for df, kind in ((reviews, "review_decision"), (review_comments, "review_comment"),
                     (issue_comments, "issue_comment")):
        if df is not None:
            parts.append(project_feedback(df, kind, keys, mode))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def feedback_sort_key() -> list[Column]:
    """O1: time ascending, nulls last, then kind order, then API order."""
    return [F.col("submitted_at").isNull(), F.col("submitted_at"), F.col("kind_rank"), F.col("pos")]


def rendered(feedback: DataFrame, mode: str = "all") -> Column:
    return render_feedback("type", "author", "state", "content", "file", "line", mode=mode)


def agg_timeline(feedback: DataFrame, keys, mode: str = "all",
                 bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """A4: rendered feedback in time order joined by blank lines, per PR.

    Two levels: (keys, piece) then keys, so the items of a PR with a huge
    history are rendered and sorted over many tasks. A piece is a prefix of
    the sort key (time, kind, position bucket): the order survives and no
    piece exceeds ``bucket_rows`` items, even if all share one timestamp. The
    last level holds a PR's finished pieces, the text that is its output. PRs
    without feedback are absent here; the placeholder is added after the left
    join that assembles PR details.
    """
    k = keys_list(keys)
    piece = F.struct(F.col("submitted_at").isNull().alias("n"), F.col("submitted_at").alias("t"),
                     F.col("kind_rank").alias("r"), pos_bucket("pos", bucket_rows).alias("b"))
    lvl1 = (feedback.withColumn("_sb", piece)
            .repartition(*[F.col(c) for c in k], F.col("_sb"))
            .groupBy(*k, "_sb")
            .agg(sorted_items([F.col("pos")], {"t": rendered(feedback, mode)}).alias("_items"),
                 F.count(F.lit(1)).alias("_n"))
            .select(*k, "_sb", join_field(F.col("_items"), "t", C.FEEDBACK_JOINER).alias("_text"), "_n"))
    return (lvl1.groupBy(*k)
            .agg(sorted_items([F.col("_sb")], {"t": F.col("_text")}).alias("_p"),
                 F.sum("_n").cast("bigint").alias("feedback_count"))
            .select(*k, join_field(F.col("_p"), "t", C.FEEDBACK_JOINER).alias("timeline"),
                    "feedback_count"))


def with_timeline_placeholder(df: DataFrame, col: str = "timeline") -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(C.NO_FEEDBACK_TEXT)))


def agg_feedback_counts(feedback: DataFrame, keys) -> DataFrame:
    """Feedback rows per kind per PR (map-side combined)."""
    k = keys_list(keys)
    return feedback.groupBy(*k).agg(
        F.count_if(F.col("type") == "review_decision").alias("n_reviews"),
        F.count_if(F.col("type") == "review_comment").alias("n_review_comments"),
        F.count_if(F.col("type") == "issue_comment").alias("n_issue_comments"))
