"""Prompt building: F8 F9 A7 O2 X2 and the Q2 composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake import constants as C
from reviewlake.functions.feedback import history_section
from reviewlake.functions.template import fill_template
from reviewlake.functions.text import js_length
from reviewlake.operators.common import DEFAULT_BUCKET_ROWS, keys_list
from reviewlake.operators.feedback import agg_timeline
from reviewlake.operators.files import agg_file_texts, is_ignored
from reviewlake.operators.settings import eligibility_error, error_message, resolve_run_settings


def prompt_columns(template: Column | str, mode: str = "safe") -> dict[str, Column]:
    """Columns computed from files_list, diffs, languages, timeline (+ template)."""
    tpl = F.col(template) if isinstance(template, str) else template
    history = history_section(F.coalesce(F.col("timeline"), F.lit(C.NO_FEEDBACK_TEXT)))
    return {
        "history": history,
        "prompt": fill_template(tpl, F.col("files_list"), F.col("diffs"), F.col("languages"),
                                history, mode=mode),
    }


def with_prompt_stats(df: DataFrame) -> DataFrame:
    """Files count, diff length, languages, history length, prompt length (UTF-16 units)."""
    return df.withColumns({
        "diff_length": js_length("diffs"),
        "reviews_length": js_length("history"),
        "total_length": js_length("prompt"),
    })


def build_review_prompts(runs: DataFrame, settings: DataFrame, files: DataFrame,
                         feedback: DataFrame, keys, mode: str = "safe",
                         feedback_mode: str = "all",
                         bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Q2: one row per run: resolved settings, error code, prompt and stats.

    Plan: J3 -> P11 checks. Files are paired with the distinct (PR, tenant) of eligible
    runs - a PR-sized side, so no hint: AQE turns the join into a broadcast
    only when the measured side is small, else both sides shuffle on the PR
    key and AQE splits a skewed PR partition. Files are then filtered by the
    tenant's ignore list (P7, a narrow higher-order filter); the file
    aggregation repartitions them on (PR, tenant, position bucket), so its
    first level is salted: a PR with millions of files spreads over many tasks. Runs then
    join the timeline on the PR key and the file texts on (PR, tenant), by which these are
    already partitioned: the diffs, the longest texts, are not shuffled again for a join.
    """
    k = keys_list(keys)
    rs = resolve_run_settings(runs, settings).withColumn("error_code", eligibility_error())
    pairs = (rs.where(F.col("error_code").isNull())
             .select(*k, "tenant", "ignore_files").dropDuplicates(k + ["tenant"]))
    joined = files.join(pairs, k, "inner").where(~is_ignored("name", F.col("ignore_files")))
    fa = agg_file_texts(joined, k + ["tenant"], bucket_rows)
    tl = agg_timeline(feedback, k, feedback_mode).select(*k, "timeline")
    out = rs.join(tl, k, "left").join(fa, k + ["tenant"], "left")
    out = (out.select(*[c for c in out.columns if c != "timeline"], "timeline")
           .withColumn("error_code", F.coalesce(
               F.col("error_code"),
               F.when(F.coalesce(F.col("file_count"), F.lit(0)) == 0, F.lit("NO_FILES")))))
    cols = prompt_columns("review_prompt", mode)
    ok = F.col("error_code").isNull()
    out = out.withColumns({n: F.when(ok, c) for n, c in cols.items()})
    out = with_prompt_stats(out).withColumn("error_message", error_message("error_code"))
    return out
