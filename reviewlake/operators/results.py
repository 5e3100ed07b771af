"""Review results and submissions: J4 J5 A8 W2 F24 F25 Q5 Q6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake import constants as C
from reviewlake.functions.requests import api_endpoint
from reviewlake.functions.text import col, or_default, render_review_html
from reviewlake.operators.common import keys_list
from reviewlake.operators.details import collect_files
from reviewlake.operators.files import is_ignored
from reviewlake.operators.settings import error_message


def pr_summary_text(owner="owner", repo="repo", number="pr_number", title="title",
                    file_count="file_count") -> Column:
    """repo, ``#number``, title and file count; falsy values show the loading text."""
    n = F.nullif(col(file_count), F.lit(0)).cast("string")
    return F.concat(
        F.lit(C.SUMMARY_REPO), F.coalesce(col(owner), F.lit("undefined")), F.lit("/"),
        F.coalesce(col(repo), F.lit("undefined")),
        F.lit(C.SUMMARY_NUMBER), F.coalesce(col(number).cast("string"), F.lit("undefined")),
        F.lit(C.SUMMARY_TITLE), or_default(title, C.LOADING_TEXT),
        F.lit(C.SUMMARY_FILES), F.coalesce(n, F.lit(C.LOADING_TEXT)), F.lit(C.SUMMARY_FILES_UNIT))


def review_stats_text(reviewed="reviewed_files", additions="additions", deletions="deletions",
                      tokens="tokens") -> Column:
    """reviewed file count, ``+a``, ``-d``, tokens (0 or missing shows N/A)."""
    t = F.coalesce(F.nullif(col(tokens), F.lit(0)).cast("string"), F.lit(C.NOT_AVAILABLE_TEXT))
    return F.concat(
        F.lit(C.STATS_REVIEWED), col(reviewed).cast("string"),
        F.lit(C.STATS_ADDITIONS), col(additions).cast("string"),
        F.lit(C.STATS_DELETIONS), col(deletions).cast("string"),
        F.lit(C.STATS_TOKENS), t)


# Repository coordinates of a PR (path parts of its API endpoints).
COORDS = ("owner", "repo")


def _kept(files: DataFrame, runs: DataFrame, k: list[str]) -> DataFrame:
    """The files of the runs' PRs that each tenant's ignore list leaves, once per (PR, tenant)."""
    pairs = runs.select(*k, "tenant", "ignore_files").dropDuplicates([*k, "tenant"])
    return files.join(pairs, k).where(~is_ignored("name", F.col("ignore_files"))).drop("ignore_files")


def run_results(runs: DataFrame, completions: DataFrame, prs: DataFrame, files: DataFrame, keys,
                served_only: bool = False) -> DataFrame:
    """J4 + A8: one row per run, as the original hands it to its caller.

    ``runs``: request_id, keys, tenant, run_ts, ai_service, ignore_files and ``error_code`` of the
    eligibility checks (``settings.flag_review_eligibility``). ``completions``: request_id,
    content, tokens, and if there are such columns ``ended`` and ``error_message`` of a failed model call.
    ``files``: projected files (P2). ``prs``: keys and the unfiltered totals.

    Output: request_id, keys, run_ts, success, error_code, error_message, review, ended, files (kept
    files in order), reviewed_files, summary (total_files, additions, deletions), token_usage, and owner
    / repo if ``prs`` has them. A run that failed has its code and message and nothing else: not
    eligible, no files left, unsupported service, failed call, or no response. A response that was cut
    off is a result like any other, with what there is of it and ``ended`` false. ``served_only`` returns the
    runs that have a completion and looks at no others' files.
    """
    k = keys_list(keys)
    by = [*k, "tenant"]
    has = lambda c: F.col(c) if c in completions.columns else F.lit(None)
    done = completions.select("request_id", F.col("content").alias("_content"), F.col("tokens").alias("_tokens"),
                              has("ended").cast("boolean").alias("_ended"), has("error_message").cast("string").alias("_failed"),
                              F.lit(True).alias("_answered"))
    r = runs.select("request_id", *by, "run_ts", "ai_service", "ignore_files", "error_code").join(
        done, "request_id", "inner" if served_only else "left")
    eligible = r.where(F.col("error_code").isNull())
    arrays = collect_files(_kept(files, eligible.where("_answered"), k), by)
    r = r.join(arrays, by, "left")
    count = F.coalesce(F.size("files"), F.lit(0))
    if not served_only:
        counts = _kept(files, eligible, k).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        r = r.join(counts, by, "left")
        count = F.coalesce(F.col("_n"), F.lit(0))
    supported = F.coalesce(F.col("ai_service").isin("openai", "anthropic"), F.lit(False))
    code = F.coalesce(F.col("error_code"), F.when(count == 0, "NO_FILES"),
                      F.when(F.col("_failed").isNotNull(), "MODEL_CALL_FAILED"),
                      F.when(F.col("_content").isNull(), F.when(supported, "NO_RESPONSE").otherwise("UNSUPPORTED_SERVICE")))
    coords = [c for c in COORDS if c in prs.columns and c not in k]
    p = prs.select(*k, F.struct(F.col("changed_files").alias("total_files"), "additions", "deletions").alias("_summary"), *coords)
    r = r.join(p, k, "left").withColumn("_code", code).withColumn("_count", count.cast("bigint"))
    ok = F.col("_code").isNull()
    return r.select("request_id", *k, "run_ts", ok.alias("success"), F.col("_code").alias("error_code"),
                    F.coalesce(F.when(F.col("_code") == "MODEL_CALL_FAILED", F.col("_failed")), error_message("_code")).alias("error_message"),
                    *[F.when(ok, F.col(c)).alias(n) for c, n in (
                        ("_content", "review"), ("_ended", "ended"), ("files", "files"), ("_count", "reviewed_files"),
                        ("_summary", "summary"), ("_tokens", "token_usage"))], *coords)


def latest_review(results: DataFrame, keys) -> DataFrame:
    """The newest result per PR replaces earlier ones.

    A ranking window kept at its first row: Spark limits each task's rows to one per PR before they
    are exchanged (``WindowGroupLimit``), so a PR with very many runs never lands whole in one
    task, no text sits in an aggregate's buffer, and the results are computed once.
    """
    k = keys_list(keys)
    w = Window.partitionBy(*k).orderBy(F.col("run_ts").desc(), F.col("request_id").desc())
    return results.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def build_review_results(completions: DataFrame, runs: DataFrame, prs: DataFrame, files: DataFrame, keys,
                         escape_html: bool = False) -> DataFrame:
    """Q5: latest successful result per PR with HTML rendering (F10) and the stats text.

    Inputs as for ``run_results``; only the files of runs that have a response are looked at.
    """
    k = keys_list(keys)
    coords = [c for c in COORDS if c in prs.columns and c not in k]
    res = latest_review(run_results(runs, completions, prs, files, k, served_only=True).where("success"), k)
    return res.select("request_id", *k, "run_ts", "review", "reviewed_files", "summary.*",
                      F.col("token_usage").alias("tokens"), "files", "ended", *coords).withColumns({
                          "review_html": render_review_html("review", escape=escape_html),
                          "stats_text": review_stats_text()})


def build_submissions(results: DataFrame, prs: DataFrame, keys) -> DataFrame:
    """J5 + Q6: one outbox row per result: endpoint, body, event, body hash."""
    k = keys_list(keys)
    coords = [c for c in COORDS if c not in k]
    base = results.select("request_id", *k, *[c for c in coords if c in results.columns],
                          F.col("review").alias("body"))
    if not all(c in results.columns for c in coords):
        # results built without the PR coordinates: look them up (a shuffle join on the keys)
        base = base.select("request_id", *k, "body").join(prs.select(*k, *coords), k, "inner")
    return (base
            .select("request_id", *k, "owner", "repo",
                    api_endpoint("submit_review").alias("endpoint"),
                    "body", F.lit(C.SUBMIT_EVENT).alias("event"),
                    F.sha2(F.col("body"), 256).alias("body_sha256")))
