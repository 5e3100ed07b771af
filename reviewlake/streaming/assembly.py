"""Structured Streaming: T1 T4 T5 (response streams) and T6 (PR visits).

Response chunks are keyed by ``request_id``. Complete lines leave the state as
rows; the last chunk closes the key with a ``done`` row; a key that stays
silent past the timeout closes with ``abandoned``. State per key is bounded by
one unfinished line plus out-of-order chunks, and a response is bounded by its
output token cap. A chunk that is delivered again is ignored, also after the
end: a closed key keeps a small marker, for ``marker_ttl_ms`` if that is given
and for good otherwise.

Line parsing and delta extraction after the state step are the same
built-in expressions as in batch (``operators.streams``), so batch and
stream agree by construction.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.stream import with_line_parse
from reviewlake.functions.text import estimate_tokens
from reviewlake.operators.visits import SESSION, is_pr_page, parse_pr_url
from reviewlake.session import use_rocksdb
from reviewlake.streaming import processors as P

# The driver's helper process of a state query doesn't get files added to the session, so
# processors travel whole instead of as names of this package.
cloudpickle.register_pickle_by_value(P)

#: the first second of year 1
BEFORE_ALL = -62135596800


def _time_mode(timeout_ms: int | None, marker_ttl_ms: int | None) -> str:
    return "processingTime" if timeout_ms or marker_ttl_ms else "none"


def assemble_stream(chunks: DataFrame, flush_tail: bool = False, timeout_ms: int | None = None,
                    marker_ttl_ms: int | None = None) -> DataFrame:
    """T1 + T4: chunk stream -> complete lines, then one ``done`` (or ``abandoned``) row.

    ``timeout_ms`` closes silent streams as ``abandoned``; ``marker_ttl_ms`` lets
    Spark forget closed ones (a chunk delivered again later than that would open
    the response anew). Both need processing time: Spark then schedules a batch on
    every trigger, so set them only for continuously triggered queries; an
    ``availableNow`` run would never finish.
    """
    use_rocksdb(chunks.sparkSession)
    return (chunks.select("request_id", "seq", "service", "payload", "is_last")
            .groupBy("request_id")
            .transformWithState(P.LineAssembler(flush_tail, timeout_ms, marker_ttl_ms), P.LINE_SCHEMA,
                                "append", _time_mode(timeout_ms, marker_ttl_ms)))


def delta_stream(chunks: DataFrame, flush_tail: bool = False, timeout_ms: int | None = None,
                 marker_ttl_ms: int | None = None) -> DataFrame:
    """T2 + T3 + T4 on a stream: deltas, ends and malformed lines as rows of one stream.

    One stateful step, then one projection (no second branch of the state
    output). Output: request_id, line_no, kind (``delta`` | ``done`` |
    ``abandoned`` | ``malformed``), content, line (kept for dead letters only).
    ``sinks.write_delta_batches`` parts them into the two published tables.
    """
    lines = with_line_parse(assemble_stream(chunks, flush_tail, timeout_ms, marker_ttl_ms), "_kind", "_delta")
    kind = (F.when(F.col("kind") != "line", F.col("kind"))
            .when(F.col("_kind") == "malformed", F.lit("malformed"))
            .when((F.col("_kind") == "data") & (F.col("_delta") != ""), F.lit("delta")))
    out = lines.select("request_id", "line_no", kind.alias("kind"), F.coalesce(F.col("_delta"), F.lit("")).alias("content"),
                       F.when(F.col("_kind") == "malformed", F.col("line")).alias("line"))
    return out.where(F.col("kind").isNotNull())


def accumulate_responses(deltas: DataFrame, timed: bool = False) -> DataFrame:
    """T5: the stream of ``delta_stream`` -> one row per ended response with its final text.

    Output: request_id, content, tokens, n_deltas, n_malformed, status (``done`` |
    ``abandoned``). ``timed`` must be true if the deltas come from a step with a
    timeout or marker lifetime: all stateful steps of a query share its time mode.
    """
    use_rocksdb(deltas.sparkSession)
    out = (deltas.select("request_id", "line_no", "kind", "content").groupBy("request_id")
           .transformWithState(P.ResponseAccumulator(), P.RESPONSE_SCHEMA, "append",
                               "processingTime" if timed else "none"))
    return out.select("request_id", "content", estimate_tokens("content").alias("tokens"), "n_deltas",
                      "n_malformed", "status")


def response_stream(chunks: DataFrame, flush_tail: bool = False, timeout_ms: int | None = None,
                    marker_ttl_ms: int | None = None) -> DataFrame:
    """T1-T5 in one query: chunk stream -> one final row per ended response."""
    deltas = delta_stream(chunks, flush_tail, timeout_ms, marker_ttl_ms)
    return accumulate_responses(deltas, bool(timeout_ms or marker_ttl_ms))


def responses_from_deltas(deltas: DataFrame) -> DataFrame:
    """T5 in batch: final content of each finished response from published delta rows.

    ``deltas``: request_id, line_no, content, done (``schemas.DELTA``).
    """
    ended = deltas.where("done").select("request_id").distinct()
    parts = (deltas.where("NOT done").join(ended, "request_id", "inner")
             .groupBy("request_id")
             .agg(F.array_sort(F.collect_list(F.struct("line_no", "content"))).alias("_d")))
    return (ended.join(parts, "request_id", "left")
            .select("request_id", F.coalesce(F.array_join(F.transform("_d", lambda x: x["content"]), ""),
                                             F.lit("")).alias("content")))


def detect_pr_changes_stream(visits: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """W1 on a stream of visits that arrive in any order within ``delay``.

    A visit is decided on when the watermark (latest visit time seen, less
    ``delay``) has passed it, in (ts, seq) order within its page session.
    Output: the visit columns and ``error_code``: null for a detected change,
    ``LATE_VISIT`` for a visit that came when a later one of its session had been
    decided on (so later than the watermark), ``NO_VISIT_TIME`` for one without a
    time. Detections equal the batch form over all rows that are not late.
    """
    use_rocksdb(visits.sparkSession)
    timed = visits.withWatermark("ts", delay)
    # visits of other pages move the watermark too: a page test that reads ``ts`` can't be moved below it
    page = F.when(F.col("ts") < F.timestamp_seconds(F.lit(BEFORE_ALL)), F.lit("")).otherwise(F.col("url"))
    pr = parse_pr_url(timed.where(is_pr_page(page)))
    # the computed copy of ``ts`` carries no watermark, so late rows reach the state step instead of being dropped
    keyed = pr.select(*SESSION, "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "url", "path",
                      "owner", "repo", "pr_number")
    out = keyed.groupBy(*SESSION).transformWithStateInPandas(P.VisitOrder(), P.VISIT_SCHEMA, "append", "eventTime")
    return out.select(*SESSION, "seq", F.timestamp_micros("ts_us").alias("ts"), "url", "path", "owner", "repo",
                      "pr_number", "error_code")
