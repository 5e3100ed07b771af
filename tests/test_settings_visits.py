"""Settings layering (M1-M5, J3, P11, P12) and PR visit detection."""

import datetime as dt

from pyspark.sql import functions as F

from reviewlake import constants as C
from reviewlake.operators.settings import (flag_settings_quality, flatten_settings, merge_settings,
                                           resolve_run_settings)
from reviewlake.operators.visits import pr_visit_feed
from reviewlake.session import scratch_path
from reviewlake.sources.readers import read_page_visits
from reviewlake.streaming.assembly import detect_pr_changes_stream

STORED = ("tenant string, reason string, top map<string,string>, openai map<string,string>, "
          "anthropic map<string,string>, review map<string,string>")


def test_merge_each_reason(spark):
    top = {"aiService": "anthropic", "githubToken": "ref-1", "theme": "dark"}
    oa = {"apiKey": "", "model": "m-1"}
    an = {"apiKey": "ref-2"}
    rv = {"maxTokens": "2000"}
    rows = [(r, r, top, oa, an, rv) for r in
            ("install", "update", "chrome_update", "shared_module_update")]
    df = merge_settings(spark.createDataFrame(rows, STORED), "reason")
    got = {r["tenant"]: r for r in df.collect()}
    d = C.INSTALL_DEFAULTS
    ins = got["install"]
    assert ins["top"] == {"aiService": "openai", "githubToken": "ref-1", "theme": "dark"}
    assert ins["openai"]["model"] == d["openai"]["model"] and ins["openai"]["apiKey"] == ""
    assert ins["review"]["maxTokens"] == "1000"
    up = got["update"]
    assert up["top"]["aiService"] == "anthropic" and up["top"]["theme"] == "dark"
    assert up["openai"] == {"apiKey": "", "apiEndpoint": d["openai"]["apiEndpoint"], "model": "m-1"}
    assert up["anthropic"] == {"apiKey": "ref-2", "model": d["anthropic"]["model"]}
    assert up["review"]["maxTokens"] == "2000"
    assert up["review"]["reviewPrompt"] == d["review"]["reviewPrompt"]
    for r in ("chrome_update", "shared_module_update"):
        assert got[r]["top"] == top and got[r]["openai"] == oa and got[r]["review"] == rv
    flat = {r["tenant"]: r for r in flatten_settings(df).collect()}
    assert flat["update"]["has_anthropic_key"] and not flat["update"]["has_openai_key"]
    assert flat["update"]["max_tokens"] == 2000


def test_run_override_and_eligibility(spark):
    settings = spark.createDataFrame(
        [("t1", True, True, False, "openai", "P", 1000, [])],
        "tenant string, has_token boolean, has_openai_key boolean, has_anthropic_key boolean, "
        "ai_service string, review_prompt string, max_tokens int, ignore_files array<string>")
    runs = spark.createDataFrame(
        [("a", "t1", None, None), ("b", "t1", "", ""), ("c", "t1", "anthropic", "Q"), ("d", "t9", None, None)],
        "request_id string, tenant string, temp_ai_service string, temp_review_prompt string")
    from reviewlake.operators.settings import eligibility_error
    out = resolve_run_settings(runs, settings).withColumn("err", eligibility_error())
    got = {r["request_id"]: (r["ai_service"], r["review_prompt"], r["err"]) for r in out.collect()}
    assert got == {"a": ("openai", "P", None), "b": ("openai", "P", None),
                   "c": ("anthropic", "Q", "NO_ANTHROPIC_KEY"), "d": (None, None, "NO_FORGE_TOKEN")}


def test_key_quality_drops_raw_key(spark):
    df = spark.createDataFrame([("anthropic", "sk-" + "x" * 17), ("anthropic", "x" * 25),
                                ("openai", "y" * 19), ("openai", "y" * 20), ("other", "z" * 30)],
                               "ai_service string, api_key string")
    out = flag_settings_quality(df)
    assert "api_key" not in out.columns
    assert [r["key_error"] for r in out.collect()] == [
        None, "INVALID_ANTHROPIC_KEY", "INVALID_OPENAI_KEY", None, "UNSUPPORTED_SERVICE"]


VISITS = "tab_id long, page_load_id long, seq long, ts timestamp, url string"


def _visits(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 0, 1, t, "https://github.com/o/r/pull/1"),
            (1, 0, 2, t, "https://github.com/o/r/issues/2"),
            (1, 0, 3, t, "https://github.com/o/r/pull/1"),          # same PR after leaving: no row
            (1, 0, 4, t, "https://github.com/o/r/pull/1/files"),    # another path: row
            (1, 1, 5, t, "https://github.com/o/r/pull/1"),          # new page load: row again
            (2, 0, 6, t, "https://example.com/o/r/pull/1")]
    return spark.createDataFrame(rows, VISITS)


def test_visit_changes_batch(spark):
    got = [r["seq"] for r in pr_visit_feed(_visits(spark)).orderBy("seq").collect()]
    assert got == [1, 4, 5]


def test_visit_changes_stream(spark):
    base = scratch_path(spark, "test-visits")
    v = _visits(spark)
    for i, lo in enumerate((1, 3, 5)):
        v.where((F.col("seq") >= lo) & (F.col("seq") < lo + 2)).coalesce(1).write.parquet(f"{base}/b={i}")
    # a later visit of no PR page moves the watermark past all others
    v.limit(1).select("tab_id", "page_load_id", "seq", F.expr("ts + INTERVAL 30 DAYS").alias("ts"),
                      F.lit("https://github.com/").alias("url")).write.parquet(f"{base}/b=9")
    stream = read_page_visits(spark, base + "/*", stream=True, max_files_per_trigger=1)
    out, ck = scratch_path(spark, "test-visit-out"), scratch_path(spark, "test-visit-ck")
    q = (detect_pr_changes_stream(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(out).collect()) == [1, 4, 5]
