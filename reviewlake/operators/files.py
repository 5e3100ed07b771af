"""Changed-file operators: P2 P7 P8 J2 A1 A2 A3 A10."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake import constants as C
from reviewlake.functions.text import (file_extension, matches_ignore, render_diff_block,
                                       render_file_line)
from reviewlake.operators.common import (DEFAULT_BUCKET_ROWS, join_field,
                                         keys_list, pos_bucket, sorted_items)

FILE_COLUMNS = ["name", "status", "additions", "deletions", "patch", "blob_url"]


def project_files(df: DataFrame, keys: Sequence[str] | str, with_blob_url: bool = True) -> DataFrame:
    """The file columns kept downstream, ``filename`` renamed to ``name``."""
    cols = keys_list(keys) + [
        F.col("pos"), F.col("filename").alias("name"), "status", "additions", "deletions", "patch"]
    if with_blob_url:
        cols.append("blob_url")
    return df.select(*cols)


def is_ignored(name: Column | str, patterns: Column | Sequence[str]) -> Column:
    """True when any pattern matches; an empty or missing list ignores nothing."""
    n = F.col(name) if isinstance(name, str) else name
    pats = patterns if isinstance(patterns, Column) else F.array(*[F.lit(p) for p in patterns]) \
        if len(patterns) else F.array().cast("array<string>")
    return F.coalesce(F.exists(pats, lambda p: matches_ignore(n, p)), F.lit(False))


def filter_ignored_files(df: DataFrame, patterns: Column | Sequence[str] | str,
                         name_col: str = "name") -> DataFrame:
    """Drop files matched by an ignore pattern (array column or literal list)."""
    pats = F.col(patterns) if isinstance(patterns, str) else patterns
    return df.where(~is_ignored(name_col, pats))


def anti_join_ignored(files: DataFrame, patterns: DataFrame, tenant_col: str = "tenant",
                      name_col: str = "name", pattern_col: str = "pattern") -> DataFrame:
    """Relational form of P7 against a (tenant, pattern) table.

    Equi on tenant plus the pattern test as residual: a hash join, never a
    nested loop. No hint: Spark broadcasts the pattern side by its measured bytes.
    """
    p = patterns.select(F.col(tenant_col).alias("_pt"), F.col(pattern_col).alias("_pat"))
    cond = (F.col(tenant_col) == F.col("_pt")) & matches_ignore(F.col(name_col), F.col("_pat"))
    return files.join(p, cond, "left_anti")


def agg_file_texts(files: DataFrame, keys: Sequence[str] | str,
                   bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """A1 + A2 + A3 + file count in one skew-safe two-level aggregation.

    Level 1 groups by (keys, pos div bucket_rows): a PR with millions of files
    spreads over many tasks, each sorting at most ``bucket_rows`` rows. Level 2
    joins the pre-rendered pieces in bucket order; its group holds one row per
    bucket. The rows are repartitioned on (keys, bucket) first, so the split
    holds even when the input is already partitioned by the keys alone (a
    collect needs no map-side combine, so this is the aggregate's own shuffle).
    Output columns: keys, files_list, diffs, languages, file_count.
    """
    k = keys_list(keys)
    lvl1 = (files
            .withColumn("_b", pos_bucket("pos", bucket_rows))
            .repartition(*[F.col(c) for c in k], F.col("_b"))
            .groupBy(*k, "_b")
            .agg(sorted_items([F.col("pos")], {
                "line": render_file_line("name", "status", "additions", "deletions"),
                "diff": render_diff_block("name", "patch"),
                "ext": file_extension("name"),
            }).alias("_items"), F.count(F.lit(1)).alias("_n"))
            .select(*k, "_b",
                    join_field(F.col("_items"), "line", C.FILES_JOINER).alias("_files"),
                    join_field(F.col("_items"), "diff", C.DIFFS_JOINER).alias("_diffs"),
                    F.array_distinct(F.filter(F.transform("_items", lambda x: x["ext"]),
                                              lambda e: e != F.lit(""))).alias("_exts"),
                    "_n"))
    parts = sorted_items([F.col("_b")], {"f": F.col("_files"), "d": F.col("_diffs"),
                                         "e": F.col("_exts")})
    return (lvl1.groupBy(*k)
            .agg(parts.alias("_p"), F.sum("_n").alias("file_count"))
            .select(*k,
                    join_field(F.col("_p"), "f", C.FILES_JOINER).alias("files_list"),
                    join_field(F.col("_p"), "d", C.DIFFS_JOINER).alias("diffs"),
                    F.array_join(F.array_distinct(F.flatten(F.transform("_p", lambda x: x["e"]))),
                                 C.LANGUAGES_JOINER).alias("languages"),
                    F.col("file_count").cast("bigint").alias("file_count")))


def agg_files_list(files: DataFrame, keys, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """A1 alone."""
    return agg_file_texts(files, keys, bucket_rows).select(*keys_list(keys), "files_list")


def agg_diffs(files: DataFrame, keys, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """A2 alone."""
    return agg_file_texts(files, keys, bucket_rows).select(*keys_list(keys), "diffs")


def agg_languages(files: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    """A3 alone: distinct non-empty extensions in first-seen order.

    Pre-aggregates (key, extension) -> first position with a map-side
    combine, so a hot PR ships one row per extension per map task.
    """
    k = keys_list(keys)
    firsts = (files.withColumn("_ext", file_extension("name"))
              .groupBy(*k, "_ext").agg(F.min("pos").alias("_first")))
    nonempty = F.when(F.col("_ext") != "", F.struct(F.col("_first"), F.col("_ext")))
    return (firsts.groupBy(*k)
            .agg(F.array_sort(F.collect_list(nonempty)).alias("_e"))
            .select(*k, F.array_join(F.transform("_e", lambda x: x["_ext"]),
                                     C.LANGUAGES_JOINER).alias("languages")))


def agg_ignore_stats(files: DataFrame, keys: Sequence[str] | str,
                     patterns: Column | Sequence[str] | str) -> DataFrame:
    """A10: total, kept and ignored file counts per PR."""
    k = keys_list(keys)
    pats = F.col(patterns) if isinstance(patterns, str) else patterns
    ign = is_ignored("name", pats)
    return (files.groupBy(*k)
            .agg(F.count(F.lit(1)).alias("total_files"),
                 F.count_if(~ign).alias("kept_files"),
                 F.count_if(ign).alias("ignored_files")))
