"""Composite jobs Q1-Q8 (public API) and end-to-end batch drivers.

Each job is one lazy DataFrame plan; the drivers add the sources and
sinks. Keys default to ``(owner, repo, pr_number)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from reviewlake.constants import DEFAULT_KEYS
from reviewlake.operators import details, prompts, requests, results, settings, streams, visits
from reviewlake.operators.feedback import union_feedback
from reviewlake.operators.files import project_files
from reviewlake.sinks import writers
from reviewlake.sources import readers

KEYS = list(DEFAULT_KEYS)


def build_pr_details(prs, files, reviews, review_comments, issue_comments,
                     keys: Sequence[str] = KEYS, mode: str = "all") -> DataFrame:
    """Q1: P1 + P2 + U1 + A4 + J1."""
    return details.assemble_pr_details(prs, files, reviews, review_comments, issue_comments,
                                       list(keys), mode)


def build_review_prompts(runs, settings_flat, files, reviews, review_comments, issue_comments,
                         keys: Sequence[str] = KEYS, template_mode: str = "safe",
                         feedback_mode: str = "all") -> DataFrame:
    """Q2: J3 + P11 + P7 + A1-A3 + A4 + F9 + F8 (+ A7 stats)."""
    k = list(keys)
    fb = union_feedback(reviews, review_comments, issue_comments, k, feedback_mode)
    return prompts.build_review_prompts(runs, settings_flat, project_files(files, k), fb, k,
                                        mode=template_mode, feedback_mode=feedback_mode)


def build_requests(prompt_rows: DataFrame) -> DataFrame:
    """Q3: F20 + F19 (+ F21, F22 audit columns)."""
    return requests.build_requests(prompt_rows)


def assemble_responses(chunks: DataFrame, flush_tail: bool = False) -> DataFrame:
    """Q4 (batch twin of T1-T5)."""
    return streams.assemble_responses(chunks, flush_tail)


def run_results(runs, completions, prs, files, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per run, failed ones included (``results.run_results``)."""
    return results.run_results(runs, completions, prs, project_files(files, list(keys)), list(keys))


def build_review_results(completions, runs, prs, files, keys: Sequence[str] = KEYS,
                         escape_html: bool = False) -> DataFrame:
    """Q5: Q4, J4, A8, W2, F10, F25."""
    return results.build_review_results(completions, runs, prs, project_files(files, list(keys)), list(keys), escape_html)


def build_submissions(review_results, prs, keys: Sequence[str] = KEYS) -> DataFrame:
    """Q6: J5 (outbox rows; K2 writes them)."""
    return results.build_submissions(review_results, prs, list(keys))


def pr_visit_feed(page_visits: DataFrame) -> DataFrame:
    """Q7: P5 + P6 + W1 (T6 is the stream form)."""
    return visits.pr_visit_feed(page_visits)


def migrate_settings(stored: DataFrame, reason_col: str = "reason") -> DataFrame:
    """Q8: M1 + M2 on stored layered settings (K3 writes the result)."""
    return settings.merge_settings(stored, reason_col)


def run_request_batch(spark: SparkSession, exports: dict[str, str], settings_path: str,
                      runs: DataFrame, out_path: str) -> DataFrame:
    """Landed exports + stored settings + runs -> request lines (K1).

    Returns the per-run table (prompts, error codes, request bodies).
    """
    prs_files = readers.read_changed_files(spark, exports["changed_files"])
    prompt_rows = build_review_prompts(
        runs, readers.read_settings(spark, settings_path), prs_files,
        readers.read_reviews(spark, exports["reviews"]),
        readers.read_review_comments(spark, exports["review_comments"]),
        readers.read_issue_comments(spark, exports["issue_comments"]))
    reqs = build_requests(prompt_rows)
    writers.write_requests(reqs, out_path)
    return reqs


def run_results_batch(spark: SparkSession, chunks_path: str, runs: DataFrame, settings_flat: DataFrame,
                      prs: DataFrame, files: DataFrame, outbox: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Response chunks + runs -> latest review per PR -> outbox (K2, idempotent).

    A response that was cut off counts with what there is of it, as in ``run_results``.
    """
    chunks = readers.read_stream_chunks(spark, chunks_path)
    done = assemble_responses(chunks).select("request_id", "content", "tokens", "ended")
    flagged = settings.flag_review_eligibility(settings.resolve_run_settings(runs, settings_flat))
    res = build_review_results(done, flagged, prs, files, keys)
    return writers.write_submissions(spark, build_submissions(res, prs, keys), outbox)
