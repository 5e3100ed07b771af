"""Sinks K1-K4.

Writes are idempotent so a retried job (lost executors, restarted
driver) never duplicates output: K1 overwrites its own path, K2 and K3 write
folders of their own that count once their commit marker is there, K4
overwrites the folders of its micro-batch.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from reviewlake import schemas as SC
from reviewlake.operators.requests import request_lines
from reviewlake.session import held_setting
from reviewlake.sinks.commits import commit, committed, read_or_none

OUTBOX_KEY = ["owner", "repo", "pr_number", "body_sha256"]
#: hex digits of the key's hash that name an outbox folder (256 of them)
BUCKET_DIGITS = 2
#: services whose files a task of K1 keeps open; with more it sorts the rest of its lines by service
OPEN_SERVICES = 16


def write_requests(requests: DataFrame, path: str, compression: str = "gzip") -> str:
    """K1: request bodies as JSON lines, one folder per service, for offline batch inference.

    Files are compressed (``compression="none"`` leaves them plain). A task writes the files of
    up to ``OPEN_SERVICES`` services side by side, so its lines are not sorted by service first.
    """
    with held_setting(requests.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_SERVICES)):
        (request_lines(requests).withColumnRenamed("ai_service", "service")
         .write.mode("overwrite").option("compression", compression).partitionBy("service").text(path))
    return path


def _outbox_key(columns: list[str], key: list[str] | None) -> list[str]:
    return key or [c for c in OUTBOX_KEY if c in columns]


def _bucketed(submissions: DataFrame, key: list[str]) -> DataFrame:
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    return submissions.withColumn("bucket", F.substring(F.sha2(text, 256), 1, BUCKET_DIGITS))


def _committed_rows(spark: SparkSession, outbox: str, schema) -> DataFrame | None:
    """Every row of every committed batch, with batch, bucket and committed_at."""
    stored = T.StructType([*schema.fields, T.StructField("batch", T.StringType()), T.StructField("bucket", T.StringType())])
    rows = read_or_none(spark, f"{outbox}/data", stored)
    if rows is None:
        return None
    marks = committed(spark, outbox).select(F.col("name").alias("batch"), "committed_at")
    return rows.join(marks, "batch")


def read_outbox(spark: SparkSession, outbox: str, schema, key: list[str] | None = None) -> DataFrame:
    """The submissions of all committed batches, each key once.

    Of a key that several batches hold (writers that ran side by side), the row of the batch
    that was committed first counts. Only such keys are looked up by a join; the other rows
    are read as they are. ``schema``: that of the submissions.
    """
    rows = _committed_rows(spark, outbox, schema)
    if rows is None:
        return spark.createDataFrame([], schema)
    k = _outbox_key(schema.names, key)
    order = F.struct("committed_at", "batch")
    same = rows.select(*k, "batch", "bucket", "committed_at").groupBy(*k, "bucket").agg(
        F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last")
    s = same.select(*[F.col(c).alias(f"s_{c}") for c in k], F.col("bucket").alias("s_bucket"), F.col("first.batch").alias("s_batch"))
    match = (F.col("bucket") == F.col("s_bucket")) & (F.col("batch") != F.col("s_batch"))
    for c in k:
        match = match & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    return rows.join(s, match, "left_anti").select(*schema.names)


def write_submissions(spark: SparkSession, submissions: DataFrame, outbox: str,
                      key: list[str] | None = None, batch: str | None = None) -> DataFrame:
    """K2: append review submissions not already in the outbox; returns the outbox.

    Rows are keyed by PR and body hash and stored by a prefix of the key's hash
    (``data/batch=../bucket=..``). Of what is there, only the key columns of the buckets that this
    batch touches are read (at most 16 ^ ``BUCKET_DIGITS`` bucket names go through the driver).
    The batch counts once its commit marker is written: a job that dies before leaves nothing that
    a reader sees. Writing a ``batch`` again replaces it. Two writers may run side by side; if both
    bring a key, ``read_outbox`` returns the row of the one that committed first.
    """
    k = _outbox_key(submissions.columns, key)
    name = batch or uuid.uuid4().hex
    # read for its buckets, then for its rows: held, so that it is not worked out twice
    held = _bucketed(submissions.dropDuplicates(k), k).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        new, there = held, _committed_rows(spark, outbox, submissions.schema)
        if there is not None:
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]
            old = there.where(F.col("bucket").isin(touched) & (F.col("batch") != name)).select(
                F.col("bucket").alias("o_bucket"), *[F.col(c).alias(f"o_{c}") for c in k])
            match = F.col("bucket") == F.col("o_bucket")
            for c in k:
                match = match & F.col(c).eqNullSafe(F.col(f"o_{c}"))
            new = new.join(old, match, "left_anti")
        # a bucket goes to one task: one file a bucket, however many tasks there are
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{outbox}/data/batch={name}")
    finally:
        held.unpersist()
    commit(spark, outbox, name)
    return read_outbox(spark, outbox, submissions.schema, key)


def write_settings(settings: DataFrame, base: str) -> int:
    """K3: persist merged settings as the next version; returns its number.

    The rows go to a folder of their own (never in place); the version becomes the current one when
    its commit marker is written. Writers side by side may take the same number; the one that
    commits later is then the current one.
    """
    spark = settings.sparkSession
    number = (committed(spark, base).agg(F.max("number")).first()[0] or 0) + 1
    name = f"{number:08d}-{uuid.uuid4().hex[:8]}"
    settings.write.mode("overwrite").parquet(f"{base}/data/{name}")
    commit(spark, base, name, number)
    return number


def read_settings_version(spark: SparkSession, base: str, schema, number: int | None = None) -> DataFrame:
    """The current version of stored settings, or version ``number``; no rows if there is none."""
    marks = committed(spark, base)
    if number is not None:
        marks = marks.where(F.col("number") == number)
    last = marks.orderBy(F.desc("number"), F.desc("committed_at"), F.desc("name")).first()
    if last is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/data/{last['name']}")


def _start(writer, checkpoint: str, available_now: bool, query_name: str | None) -> StreamingQuery:
    w = writer.option("checkpointLocation", checkpoint).outputMode("append")
    if query_name:
        w = w.queryName(query_name)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")).start()


def write_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                 query_name: str | None = None) -> StreamingQuery:
    """Rows of a stream to Parquet with exactly-once file output (T5 responses, T6 detections)."""
    return _start(stream.writeStream.format("parquet").option("path", path), checkpoint, available_now, query_name)


def delta_rows(rows: DataFrame) -> DataFrame:
    """The published deltas (``schemas.DELTA``): ``{content, done: false}`` per delta, ``{'', done: true}`` at the end."""
    return rows.where(F.col("kind").isin("delta", "done")).select(
        "request_id", "line_no", "content", (F.col("kind") == "done").alias("done"))


def dead_letter_rows(rows: DataFrame) -> DataFrame:
    """What could not be delivered (``schemas.DEAD_LETTER``): malformed lines, and where silent responses were given up."""
    return rows.where(F.col("kind").isin("malformed", "abandoned")).select("request_id", "line_no", "kind", "line")


def publish_batch(rows: DataFrame, batch_id: int, deltas: str, dead_letters: str) -> None:
    """One micro-batch to both tables, each in the batch's own folder: a batch that runs again replaces what it wrote."""
    held = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        delta_rows(held).write.mode("overwrite").parquet(f"{deltas}/batch={batch_id}")
        dead_letter_rows(held).write.mode("overwrite").parquet(f"{dead_letters}/batch={batch_id}")
    finally:
        held.unpersist()


def write_delta_batches(stream: DataFrame, deltas: str, dead_letters: str, checkpoint: str,
                        available_now: bool = True, query_name: str | None = None) -> StreamingQuery:
    """K4 + T3: the rows of ``streaming.delta_stream`` as two tables, deltas and dead letters, from one query.

    The stateful step runs once a micro-batch for both. The tables belong to the checkpoint, whose
    batch numbers name their folders.
    """
    writer = stream.writeStream.foreachBatch(lambda rows, batch_id: publish_batch(rows, batch_id, deltas, dead_letters))
    return _start(writer, checkpoint, available_now, query_name)


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SC.DELTA).parquet(path).select(*SC.DELTA.names)


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SC.DEAD_LETTER).parquet(path).select(*SC.DEAD_LETTER.names)
