"""Request tables: Q3 and the completion hook X1."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.requests import (build_request_body, header_names, message_audit,
                                           resolve_endpoint, resolve_model, uses_default_endpoint,
                                           uses_default_model)
from reviewlake.operators.settings import error_message


def build_requests(prompts: DataFrame) -> DataFrame:
    """Q3: a request row per reviewable run (F20, F19), plus an audit view.

    Runs already in error keep their code; a service with no request
    dialect gets ``UNSUPPORTED_SERVICE`` and no body.
    """
    svc = F.col("ai_service")
    supported = F.coalesce(svc.isin("openai", "anthropic"), F.lit(False))
    err = F.coalesce(F.col("error_code"),
                     F.when(~supported, F.lit("UNSUPPORTED_SERVICE")))
    ok = err.isNull()
    return (prompts
            .withColumn("error_code", err)
            .withColumn("error_message", error_message("error_code"))
            .withColumn("endpoint", F.when(ok, resolve_endpoint()))
            .withColumn("model", F.when(ok, resolve_model()))
            .withColumn("body", F.when(ok, build_request_body("ai_service", "model", "prompt",
                                                              "max_tokens")))
            .withColumn("header_names", F.when(ok, header_names("ai_service")))
            .withColumn("messages_audit", F.when(ok, message_audit("ai_service", "prompt")))
            .withColumn("use_default_endpoint", uses_default_endpoint())
            .withColumn("use_default_model", uses_default_model()))


COMPLETION_SCHEMA = "request_id string, completion string, error_message string"


def with_completions(requests: DataFrame, fn: Callable[[pd.DataFrame], Iterable[str | Exception]],
                     columns: tuple[str, ...] = ("request_id", "ai_service", "model", "body")) -> DataFrame:
    """Apply a caller-supplied completion function per Arrow batch.

    ``fn`` gets a pandas frame of request rows and returns (or yields) one result per row, in
    order: the completion text, or the exception of a call that failed. No row is handed
    over twice: if ``fn`` raises, or ends early, the rows that already have a result keep it and the
    others carry the error. Nothing leaves the executors.
    """
    cols = list(columns)

    def told(e: Exception) -> str:
        return f"{type(e).__name__}: {e}"

    def run(batches):
        for pdf in batches:
            got: list[tuple[str | None, str | None]] = []
            missing = "RuntimeError: no result for this row"
            try:
                for result in fn(pdf):
                    got.append((None, told(result)) if isinstance(result, Exception) else (result, None))
            except Exception as e:  # noqa: BLE001 - becomes the remaining rows' error
                missing = told(e)
            got = got[:len(pdf)] + [(None, missing)] * (len(pdf) - len(got))
            yield pd.DataFrame({"request_id": pdf["request_id"].to_numpy(), "completion": [g[0] for g in got],
                                "error_message": [g[1] for g in got]})

    return requests.select(*cols).mapInPandas(run, COMPLETION_SCHEMA)


def request_lines(requests: DataFrame) -> DataFrame:
    """K1 payload: one JSON object per request for offline batch inference.

    The body text is spliced in verbatim, keeping its key order and types.
    """
    head = F.to_json(F.struct(F.col("request_id").alias("custom_id"), F.col("endpoint").alias("url")))
    return requests.where(F.col("body").isNotNull()).select(
        "ai_service",
        F.concat(F.substring(head, F.lit(1), F.length(head) - 1),
                 F.lit(',"body":'), F.col("body"), F.lit("}")).alias("value"))
