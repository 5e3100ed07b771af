"""Page visits: P5 P6 W1 and the batch Q7 (stream version in ``streaming``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake import constants as C
from reviewlake.functions.text import col

SESSION = ["tab_id", "page_load_id"]


def url_path(url="url") -> Column:
    return F.try_parse_url(col(url), F.lit("PATH"))


def url_host(url="url") -> Column:
    return F.try_parse_url(col(url), F.lit("HOST"))


def is_pr_page(url="url") -> Column:
    """P5: forge host and a path containing ``/pull/``; unparsable URLs are not PR pages."""
    return F.coalesce((url_host(url) == C.FORGE_HOST) & F.contains(url_path(url), F.lit("/pull/")),
                      F.lit(False))


def filter_pr_pages(df: DataFrame, url: str = "url") -> DataFrame:
    return df.where(is_pr_page(url))


def parse_pr_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Path split on ``/``: owner = part 1, repo = part 2, number = part 4 (text)."""
    parts = F.split(url_path(url), "/", -1)
    return df.withColumns({
        "path": url_path(url),
        "owner": F.try_element_at(parts, F.lit(2)),
        "repo": F.try_element_at(parts, F.lit(3)),
        "pr_number": F.try_element_at(parts, F.lit(5)),
    })


def detect_pr_changes(visits: DataFrame, session=SESSION, bucket_seconds: int | None = 3600) -> DataFrame:
    """Keep a PR visit only when its path differs from the last PR path of
    the same page session. Non-PR pages are removed first, so leaving to one
    does not reset the memory.

    Skew-safe segmented scan: the previous path is found inside (session,
    time bucket) groups; the first visit of a bucket takes the last path of
    the session's previous non-empty bucket from a per-bucket summary (one
    row per bucket). A session with a huge number of visits spreads over its
    buckets. ``bucket_seconds=None`` runs the plain per-session window.
    """
    pr = parse_pr_url(filter_pr_pages(visits))
    if bucket_seconds is None:
        w = Window.partitionBy(*session).orderBy("ts", "seq")
        return (pr.withColumn("_prev", F.lag("path").over(w))
                .where(~F.col("path").eqNullSafe(F.col("_prev"))).drop("_prev"))
    b = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(bucket_seconds * 1_000_000))
    pr = pr.withColumn("_b", F.coalesce(b, F.lit(-(1 << 62))))
    wb = Window.partitionBy(*session, "_b").orderBy("ts", "seq")
    rows = (pr.withColumn("_prev", F.lag("path").over(wb))
            .withColumn("_first", F.row_number().over(wb) == 1))
    summary = (rows.groupBy(*session, "_b")
               .agg(F.max_by("path", F.struct("ts", "seq")).alias("_last")))
    ws = Window.partitionBy(*session).orderBy("_b")
    carry = summary.select(*session, "_b", F.lag("_last").over(ws).alias("_carry"))
    out = rows.join(carry, [*session, "_b"], "left")
    prev = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    return (out.where(~F.col("path").eqNullSafe(prev))
            .drop("_prev", "_first", "_carry", "_b"))


def pr_visit_feed(visits: DataFrame, session=SESSION) -> DataFrame:
    """Q7: PR detections with their coordinates, in session order."""
    return detect_pr_changes(visits, session).select(
        *session, "seq", "ts", "url", "path", "owner", "repo", "pr_number")
