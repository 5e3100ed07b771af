"""Sources S1-S8: landed exports read with explicit schemas.

List endpoints land as one JSON document per fetched response (PR
coordinates + ``items`` array in API order); readers ``posexplode`` them,
keeping the API position as ``pos``. Per-row timestamps are parsed with
``try_to_timestamp`` (bad text becomes null). Secrets in stored settings
are turned into presence flags in the first projection.

No landed document is lost without a trace: one that is not JSON of its
schema (cut off by a failed fetch, say), or that names no PR or tenant, is left out
by its reader and returned by ``read_quarantine``. Good and quarantined documents
together are the documents that landed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake import schemas as SC
from reviewlake.functions.text import parse_ts

KEYS = ["owner", "repo", "pr_number"]
CORRUPT, NO_KEY = "CORRUPT_DOCUMENT", "NO_KEY"
_BAD = "_corrupt"

#: schema and key columns of the documents of each export
EXPORTS: dict[str, tuple[T.StructType, list[str]]] = {
    "pull_requests": (SC.PULL_REQUEST_EXPORT, KEYS),
    "changed_files": (SC.list_export(SC.FILE_ITEM), KEYS),
    "reviews": (SC.list_export(SC.REVIEW_ITEM), KEYS),
    "review_comments": (SC.list_export(SC.REVIEW_COMMENT_ITEM), KEYS),
    "issue_comments": (SC.list_export(SC.ISSUE_COMMENT_ITEM), KEYS),
    "settings": (SC.SETTINGS_EXPORT, ["tenant"]),
}


def _documents(spark: SparkSession, path: str, export: str, fmt: str) -> DataFrame:
    """One row per landed document: its fields as ``doc``, what is wrong with it as ``error_code``, its text, its file."""
    schema, keys = EXPORTS[export]
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(f"doc.{k}").isNull()
    if fmt == "json":
        with_bad = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
        lines = spark.read.text(path).where(F.trim("value") != "")
        docs = lines.select(F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("doc"),
                            F.col("value").alias("document"), F.col("_metadata.file_path").alias("file"))
        corrupt: Column = F.col("doc").isNull() | F.col(f"doc.{_BAD}").isNotNull()
    else:
        rows = spark.read.schema(schema).format(fmt).load(path)
        whole = F.struct(*schema.names)
        docs = rows.select(whole.alias("doc"), F.to_json(whole).alias("document"), F.col("_metadata.file_path").alias("file"))
        corrupt = F.lit(False)
    return docs.withColumn("error_code", F.when(corrupt, CORRUPT).when(no_key, NO_KEY))


def _good(spark: SparkSession, path: str, export: str, fmt: str) -> DataFrame:
    return _documents(spark, path, export, fmt).where("error_code IS NULL").select("doc.*")


def read_quarantine(spark: SparkSession, path: str, export: str, fmt: str = "json") -> DataFrame:
    """The documents that the export's reader leaves out: export, error_code, document, file.

    ``export`` is a name of ``EXPORTS``. ``error_code``: ``CORRUPT_DOCUMENT`` or ``NO_KEY``. A
    settings document is kept as it is, secrets included: store it where the landed one is.
    """
    return _documents(spark, path, export, fmt).where("error_code IS NOT NULL").select(
        F.lit(export).alias("export"), "error_code", "document", "file")


def read_pull_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """One row per PR, nested API fields flattened to the landed table."""
    df = _good(spark, path, "pull_requests", fmt)
    return df.select(*KEYS, "title", "body", F.col("base.ref").alias("base_ref"),
                     F.col("head.ref").alias("head_ref"), F.col("user.login").alias("author"),
                     "commits", "additions", "deletions", "changed_files")


def _items(spark, path, export, fmt) -> DataFrame:
    df = _good(spark, path, export, fmt)
    return df.select(*KEYS, F.posexplode("items").alias("pos", "it")).withColumn(
        "pos", F.col("pos").cast("int"))


def read_changed_files(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """One row per changed file with its API position."""
    return _items(spark, path, "changed_files", fmt).select(
        *KEYS, "pos", "it.filename", "it.status", "it.additions", "it.deletions", "it.patch",
        "it.blob_url")


def read_reviews(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """S3: review decisions."""
    return _items(spark, path, "reviews", fmt).select(
        *KEYS, "pos", F.col("it.user.login").alias("author"), "it.state", "it.body",
        parse_ts("it.submitted_at").alias("submitted_at"))


def read_review_comments(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Line comments."""
    return _items(spark, path, "review_comments", fmt).select(
        *KEYS, "pos", F.col("it.user.login").alias("author"), "it.body", "it.path", "it.line",
        "it.position", parse_ts("it.created_at").alias("created_at"))


def read_issue_comments(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """General PR comments."""
    return _items(spark, path, "issue_comments", fmt).select(
        *KEYS, "pos", F.col("it.user.login").alias("author"), "it.body",
        parse_ts("it.created_at").alias("created_at"))


def read_settings(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Stored settings to the flat table; secrets become flags right here."""
    df = _good(spark, path, "settings", fmt)
    present = lambda c: F.coalesce(F.length(F.col(c)) > 0, F.lit(False))
    return df.select(
        "tenant", present("githubToken").alias("has_token"),
        present("openaiSettings.apiKey").alias("has_openai_key"),
        present("anthropicSettings.apiKey").alias("has_anthropic_key"),
        F.col("aiService").alias("ai_service"),
        F.col("openaiSettings.apiEndpoint").alias("openai_endpoint"),
        F.col("openaiSettings.model").alias("openai_model"),
        F.col("anthropicSettings.model").alias("anthropic_model"),
        F.col("reviewSettings.reviewPrompt").alias("review_prompt"),
        F.col("reviewSettings.maxTokens").try_cast("int").alias("max_tokens"),
        F.coalesce(F.col("reviewSettings.ignoreFiles"), F.array().cast("array<string>"))
        .alias("ignore_files"))


def read_stream_chunks(spark: SparkSession, path: str, fmt: str = "parquet",
                       stream: bool = False, max_files_per_trigger: int | None = None) -> DataFrame:
    """Response chunks, as a batch table or a file stream (Kafka-compatible columns)."""
    r = spark.readStream if stream else spark.read
    r = r.schema(SC.STREAM_CHUNK).format(fmt)
    if stream and max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def read_page_visits(spark: SparkSession, path: str, fmt: str = "parquet",
                     stream: bool = False, max_files_per_trigger: int | None = None) -> DataFrame:
    """Navigation events, batch or stream."""
    r = spark.readStream if stream else spark.read
    r = r.schema(SC.PAGE_VISIT).format(fmt)
    if stream and max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)
