"""End-to-end drivers over landed API exports (keys owner, repo, pr_number)."""

import datetime as dt

from pyspark.sql import functions as F

from reviewlake import registry as R
from reviewlake.operators import requests, results
from reviewlake.plans import jobs
from reviewlake.session import scratch_path
from reviewlake.sources import landing

SF = "/root/testdata/sf0.001"


def test_request_batch_matches_fixture_pipeline(spark):
    t = R.Tables(spark, SF)
    exports = landing.land_api_exports(spark, SF)
    settings_path = landing.land_settings_docs(spark, t.settings)
    runs = t.runs.join(t.pull_requests.select("pr_number", "owner", "repo"), "pr_number")
    out = scratch_path(spark, "req-lines")
    reqs = jobs.run_request_batch(spark, exports, settings_path, runs, out)
    cols = ["request_id", "error_code", "endpoint", "model", "body"]
    a = sorted(tuple(r) for r in reqs.select(*cols).collect())
    b = sorted(tuple(r) for r in R._requests(spark, SF).select(*cols).collect())
    assert a == b
    lines = spark.read.text(out)
    assert lines.count() == sum(1 for r in a if r[4] is not None)


RUN = "request_id string, pr_number long, tenant string, run_ts timestamp, ai_service string, ignore_files array<string>, error_code string"


def _runs(spark):
    t = dt.datetime(2024, 1, 1)
    h = dt.timedelta(hours=1)
    rows = [("done", 1, "t", t, "openai", ["*.md"], None), ("cut", 1, "t", t + h, "openai", ["*.md"], None),
            ("denied", 1, "u", t, "openai", [], "NO_FORGE_TOKEN"), ("silent", 2, "u", t, "anthropic", [], None),
            ("other", 2, "u", t, "other", [], None), ("nofiles", 2, "t", t, "openai", ["*.py"], None),
            ("failed", 1, "u", t, "openai", [], None), ("stray", 9, "t", t, "openai", [], None)]
    files = [(1, 0, "a.py"), (1, 1, "b.md"), (1, 2, "c"), (2, 0, "z.py")]
    prs = [(1, "o", "r", 3, 10, 4), (2, "o", "r", 1, 1, 1)]
    answers = [("done", "first", 2, True, None), ("cut", "half an ans", 3, False, None), ("nofiles", "x", 1, True, None),
               ("denied", "y", 1, True, None), ("failed", None, None, None, "Timeout: 30 s")]
    return (spark.createDataFrame(rows, RUN), spark.createDataFrame(answers, "request_id string, content string, tokens long, ended boolean, error_message string"),
            spark.createDataFrame(prs, "pr_number long, owner string, repo string, changed_files int, additions int, deletions int"),
            spark.createDataFrame(files, "pr_number long, pos int, name string").select(
                "*", F.lit("added").alias("status"), F.lit(1).alias("additions"), F.lit(0).alias("deletions"), F.lit("@@").alias("patch")))


def test_one_result_row_per_run(spark):
    runs, answers, prs, files = _runs(spark)
    got = {r.request_id: r for r in results.run_results(runs, answers, prs, files, ["pr_number"]).collect()}
    assert {k: r.error_code for k, r in got.items()} == {
        "done": None, "cut": None, "denied": "NO_FORGE_TOKEN", "silent": "NO_RESPONSE", "other": "UNSUPPORTED_SERVICE",
        "nofiles": "NO_FILES", "failed": "MODEL_CALL_FAILED", "stray": "NO_FILES"}
    ok = got["cut"]
    assert ok.success and ok.review == "half an ans" and ok.ended is False and ok.token_usage == 3 and ok.reviewed_files == 2
    assert [f.name for f in ok.files] == ["a.py", "c"] and ok.files[0].patch == "@@"
    assert tuple(ok.summary) == (3, 10, 4) and (ok.owner, ok.repo) == ("o", "r")
    assert got["failed"].error_message == "Timeout: 30 s" and got["denied"].error_message == "GitHub Token未配置"
    for name in ("denied", "silent", "failed", "nofiles"):
        r = got[name]
        assert not r.success and [r.review, r.files, r.summary, r.token_usage, r.ended, r.reviewed_files] == [None] * 6


def test_latest_result_is_the_newest_that_succeeded(spark):
    runs, answers, prs, files = _runs(spark)
    got = results.build_review_results(answers, runs, prs, files, ["pr_number"]).collect()
    assert [(r.pr_number, r.request_id, r.review, r.ended, r.reviewed_files, r.total_files) for r in got] == [(1, "cut", "half an ans", False, 2, 3)]
    newest_fails = answers.where("request_id <> 'cut'")
    assert [r.request_id for r in results.build_review_results(newest_fails, runs, prs, files, ["pr_number"]).collect()] == ["done"]


def test_results_batch_to_outbox(spark):
    t = R.Tables(spark, SF)
    path, outbox = scratch_path(spark, "job-chunks"), scratch_path(spark, "job-outbox")
    R._chunks(spark, SF).write.parquet(path)
    run = lambda: jobs.run_results_batch(spark, path, t.runs, t.settings, t.pull_requests, t.changed_files, outbox, ["pr_number"])
    cols = ["request_id", "pr_number", "owner", "repo", "endpoint", "body", "event", "body_sha256"]
    want = sorted(tuple(r) for r in R.QUERIES["q6_submissions"](spark, SF).select(*cols).collect())
    assert sorted(tuple(r) for r in run().select(*cols).collect()) == want and want
    assert sorted(tuple(r) for r in run().select(*cols).collect()) == want


def test_completions_are_never_asked_for_twice(spark):
    df = spark.createDataFrame([(f"r{i:02d}", "openai", "m", "{}") for i in range(12)], "request_id string, ai_service string, model string, body string").coalesce(1)

    def asked(pdf):
        for rid in pdf["request_id"]:
            if rid == "r03":
                yield ValueError("this one")
            elif rid == "r07":
                raise RuntimeError("gone")
            else:
                yield f"text of {rid}"

    got = {r.request_id: (r.completion, r.error_message) for r in requests.with_completions(df, asked).collect()}
    assert got["r02"] == ("text of r02", None) and got["r03"] == (None, "ValueError: this one") and got["r04"] == ("text of r04", None)
    assert all(got[f"r{i:02d}"] == (None, "RuntimeError: gone") for i in range(7, 12))
    short = {r.request_id: r.error_message for r in requests.with_completions(df, lambda pdf: ["a", "b"]).collect()}
    assert short["r01"] is None and short["r02"] == "RuntimeError: no result for this row" and len(short) == 12
