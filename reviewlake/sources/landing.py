"""Land derived tables in the code-hosting API's export shape.

Used to exercise the S1-S5 readers on data Spark derives from the
driver's tables: each list endpoint becomes one JSON document per PR with
its items in API order. Files are written gzipped below the session's shared
checkpoint folder, each export once per data folder and process and only when asked for.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.session import scratch_path, sized_shuffles
from reviewlake.sources import fixtures as fx

EXPORT_NAMES = ("pull_requests", "changed_files", "reviews", "review_comments", "issue_comments")
_LANDED: dict[tuple[str, str], dict[str, str]] = {}


def _iso(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _as_list(df: DataFrame, coords: DataFrame, item) -> DataFrame:
    rows = df.join(coords, "pr_number")
    return (rows.groupBy("owner", "repo", "pr_number")
            .agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("_p"), item.alias("it"))))
                 .alias("_s"))
            .select("owner", "repo", "pr_number", F.transform("_s", lambda x: x["it"]).alias("items")))


def _exports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five API exports of ``sf_dir`` as they are written, not run yet."""
    prs = fx.derived(spark, sf_dir, "pull_requests")
    coords = prs.select("pr_number", "owner", "repo")
    user = lambda c="author": F.struct(F.col(c).alias("login"))
    return {
        "pull_requests": prs.select(
            "owner", "repo", "pr_number", "title", "body",
            F.struct(F.col("base_ref").alias("ref")).alias("base"),
            F.struct(F.col("head_ref").alias("ref")).alias("head"), user().alias("user"),
            "commits", "additions", "deletions", "changed_files"),
        "changed_files": _as_list(fx.derived(spark, sf_dir, "changed_files"), coords, F.struct(
            "filename", "status", "additions", "deletions", "patch", "blob_url")),
        "reviews": _as_list(fx.derived(spark, sf_dir, "reviews"), coords, F.struct(
            user().alias("user"), "state", "body", _iso("submitted_at").alias("submitted_at"))),
        "review_comments": _as_list(fx.derived(spark, sf_dir, "review_comments"), coords, F.struct(
            user().alias("user"), "body", "path", "line", "position",
            _iso("created_at").alias("created_at"))),
        "issue_comments": _as_list(fx.derived(spark, sf_dir, "issue_comments"), coords, F.struct(
            user().alias("user"), "body", _iso("created_at").alias("created_at"))),
    }


def land_api_exports(spark: SparkSession, sf_dir: str, names: Iterable[str] = EXPORT_NAMES) -> dict[str, str]:
    """Write the API exports ``names`` for ``sf_dir``; returns name -> path."""
    ckpt = spark.sparkContext.getCheckpointDir() or ""
    paths = _LANDED.setdefault((os.path.abspath(sf_dir), ckpt), {})
    wanted = list(names)
    missing = [n for n in wanted if n not in paths]
    if missing:
        exports, base = _exports(spark, sf_dir), scratch_path(spark, "api-exports")
        rows = max(fx.base_table(spark, sf_dir, t).count() for t in ("lineitem", "orders", "events"))
        with sized_shuffles(spark, rows):
            for name in missing:
                p = os.path.join(base, name)
                _write_json(exports[name], p)
                paths[name] = p
    return {n: paths[n] for n in wanted}


def _write_json(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "gzip").json(path)


def land_settings_docs(spark: SparkSession, flat: DataFrame) -> str:
    """Write flat settings back as stored settings documents (secrets as stand-in strings)."""
    docs = flat.select(
        "tenant", F.when(F.col("has_token"), F.concat(F.lit("tok-"), "tenant")).otherwise(F.lit(""))
        .alias("githubToken"), F.col("ai_service").alias("aiService"),
        F.struct(F.when(F.col("has_openai_key"), F.concat(F.lit("key-a-"), "tenant")).alias("apiKey"),
                 F.col("openai_endpoint").alias("apiEndpoint"), F.col("openai_model").alias("model"))
        .alias("openaiSettings"),
        F.struct(F.when(F.col("has_anthropic_key"), F.concat(F.lit("key-b-"), "tenant")).alias("apiKey"),
                 F.col("anthropic_model").alias("model")).alias("anthropicSettings"),
        F.struct(F.col("review_prompt").alias("reviewPrompt"), F.col("max_tokens").alias("maxTokens"),
                 F.col("ignore_files").alias("ignoreFiles")).alias("reviewSettings"))
    path = scratch_path(spark, "settings-docs")
    _write_json(docs, path)
    return path


def land_cut_off(spark: SparkSession, path: str, key: str) -> str:
    """A copy of landed documents in which those whose ``key`` ends in 3 break off halfway, as a failed fetch leaves them."""
    lines = spark.read.text(path)
    number = F.regexp_extract(F.get_json_object("value", f"$.{key}"), r"\d+$", 0).cast("long")
    cut = F.when(number % 10 == 3, F.substring("value", F.lit(1), (F.length("value") / 2).cast("int"))).otherwise(F.col("value"))
    to = scratch_path(spark, "cut-off")
    lines.select(cut.alias("value")).write.mode("overwrite").option("compression", "gzip").text(to)
    return to
