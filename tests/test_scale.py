"""Skew and plan shape: hot keys split, one exchange per child, pushdown."""

import datetime as dt

from pyspark.sql import functions as F

from reviewlake.operators.feedback import agg_timeline, union_feedback
from reviewlake.operators.files import agg_file_texts, anti_join_ignored, filter_ignored_files
from reviewlake.operators.prompts import build_review_prompts
from reviewlake.operators.requests import request_lines
from reviewlake.operators.settings import fixture_settings
from reviewlake.sinks.writers import OPEN_SERVICES, write_requests


def _files(spark, n_hot=5000, n_cold=50):
    """One hot PR (number 1) with ``n_hot`` files and ``n_cold`` PRs with one file each."""
    ids = spark.range(n_hot + n_cold)
    hot = F.col("id") < n_hot
    df = ids.select(F.when(hot, F.lit(1)).otherwise(F.col("id") - n_hot + 2).cast("long").alias("pr_number"),
                    F.when(hot, F.col("id")).otherwise(F.lit(0)).cast("int").alias("pos"))
    return df.select("pr_number", "pos",
                     F.concat(F.lit("d/f"), F.col("pos").cast("string"),
                              F.when(F.col("pos") % 3 == 0, F.lit(".py")).otherwise(F.lit(".js")))
                     .alias("name"),
                     F.lit("modified").alias("status"), F.lit(1).alias("additions"),
                     F.lit(0).alias("deletions"), F.lit("@@").alias("patch"))


def test_hot_pr_bucketed_equals_unbucketed(spark):
    files = _files(spark)
    small = {r["pr_number"]: tuple(r) for r in agg_file_texts(files, ["pr_number"], bucket_rows=97).collect()}
    whole = {r["pr_number"]: tuple(r) for r in agg_file_texts(files, ["pr_number"], bucket_rows=1 << 30).collect()}
    assert small == whole
    hot = small[1]
    assert hot[4] == 5000 and hot[3] == "py, js"
    assert hot[1].split("\n")[:2] == ["d/f0.py (modified: +1 -0)", "d/f1.js (modified: +1 -0)"]


def test_first_level_groups_by_bucket(spark):
    plan = agg_file_texts(_files(spark), ["pr_number"], bucket_rows=97)._jdf.queryExecution() \
        .executedPlan().toString()
    # two aggregation levels: (key, bucket) then key
    assert plan.count("Exchange hashpartitioning") == 2


def test_hot_pr_timeline_split_by_time(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, i, f"u{i % 5}", "APPROVED", f"b{i}", t0 + dt.timedelta(minutes=7 * i)) for i in range(600)]
    r = spark.createDataFrame(rows, "pr_number long, pos int, author string, state string, body string, "
                                    "submitted_at timestamp")
    fb = union_feedback(r, None, None, ["pr_number"])
    a = agg_timeline(fb, ["pr_number"], bucket_rows=7).first()["timeline"]
    b = agg_timeline(fb, ["pr_number"], bucket_rows=1 << 30).first()["timeline"]
    assert a == b and a.count("批准了PR") == 600


def test_p7_equals_j2(spark):
    # a real tenant column (a literal would be folded away, leaving no equi key)
    files = _files(spark, 300, 30).withColumn(
        "tenant", F.when(F.col("pr_number") > 0, F.lit("t")).otherwise(F.lit("u")))
    pats = spark.createDataFrame([("t", "*.py"), ("t", "d/f1.js")], "tenant string, pattern string")
    a = filter_ignored_files(files, ["*.py", "d/f1.js"]).select("pr_number", "pos")
    b = anti_join_ignored(files, pats).select("pr_number", "pos")
    assert sorted(a.collect()) == sorted(b.collect())
    plan = anti_join_ignored(files, pats)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan


def test_parquet_pushdown(spark):
    from reviewlake import registry as R
    df = R.Tables(spark, "/root/testdata/sf0.001").runs
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)" in plan


def test_visits_bucketed_equals_window(spark):
    from reviewlake import registry as R
    from reviewlake.operators.visits import detect_pr_changes
    v = R.Tables(spark, "/root/testdata/sf0.001").page_visits
    cols = ["tab_id", "page_load_id", "seq"]
    a = sorted(detect_pr_changes(v, bucket_seconds=600).select(*cols).collect())
    b = sorted(detect_pr_changes(v, bucket_seconds=None).select(*cols).collect())
    assert a == b and len(a) > 0


def test_latest_review_agg_equals_window(spark):
    from pyspark.sql import Window

    from reviewlake.operators.results import latest_review
    rows = [(1, f"r{i}", dt.datetime(2024, 1, 1 + i % 3), f"t{i}") for i in range(50)] + \
           [(2, "a", dt.datetime(2024, 1, 1), "x"), (2, "b", dt.datetime(2024, 1, 1), "y")]
    df = spark.createDataFrame(rows, "pr_number long, request_id string, run_ts timestamp, review string")
    a = sorted(latest_review(df, ["pr_number"]).select("pr_number", "request_id", "review").collect())
    w = Window.partitionBy("pr_number").orderBy(F.col("run_ts").desc(), F.col("request_id").desc())
    b = sorted(df.withColumn("n", F.row_number().over(w)).where("n = 1").select("pr_number", "request_id", "review").collect())
    assert a == b
    # each task keeps one row per PR before the exchange
    plan = latest_review(df, ["pr_number"])._jdf.queryExecution().executedPlan().toString()
    before = plan.split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in before and "Partial" in before and "Aggregate" not in plan


def _no_broadcast(spark):
    """Session settings under which no join may become a broadcast."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    return old


def _restore(spark, old):
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_shuffled_joins_equal_broadcast_with_hot_tenant(spark):
    """Settings and ignore patterns too large to broadcast: the joins shuffle on the
    tenant, a tenant holding a third of the runs included, and give the same rows."""
    from reviewlake.operators.settings import resolve_run_settings
    n = 3000
    tenant = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("u"), (F.col("id") % 200).cast("string")))
    runs = spark.range(n).select(
        F.col("id").cast("string").alias("request_id"), tenant.alias("tenant"),
        F.when(F.col("id") % 7 == 0, F.lit("anthropic")).alias("temp_ai_service"),
        F.when(F.col("id") % 11 == 0, F.lit("T")).alias("temp_review_prompt"))
    settings = spark.range(201).select(
        F.when(F.col("id") == 200, F.lit("hot")).otherwise(
            F.concat(F.lit("u"), F.col("id").cast("string"))).alias("tenant"),
        (F.col("id") % 5 != 0).alias("has_token"), F.lit(True).alias("has_openai_key"),
        (F.col("id") % 2 == 0).alias("has_anthropic_key"),
        F.when(F.col("id") % 2 == 0, F.lit("openai")).otherwise(F.lit("anthropic")).alias("ai_service"),
        F.concat(F.lit("P"), F.col("id").cast("string")).alias("review_prompt"),
        F.lit(1000).alias("max_tokens"), F.array(F.lit("*.py")).alias("ignore_files"))
    files = _files(spark, 300, 30).withColumn(
        "tenant", F.when(F.col("pr_number") == 1, F.lit("hot")).otherwise(
            F.concat(F.lit("u"), (F.col("pr_number") % 200).cast("string"))))
    pats = settings.select("tenant", F.explode("ignore_files").alias("pattern"))

    def run():
        r = resolve_run_settings(runs, settings)
        a = anti_join_ignored(files, pats)
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (r, a)]
        return sorted(r.collect()), sorted(a.select("pr_number", "pos").collect()), plans

    hinted_r, hinted_a, hinted_plans = run()
    old = _no_broadcast(spark)
    try:
        shuffled_r, shuffled_a, plans = run()
    finally:
        _restore(spark, old)
    assert all("BroadcastHashJoin" in p for p in hinted_plans)
    assert all("BroadcastHashJoin" not in p and "BroadcastNestedLoopJoin" not in p for p in plans)
    assert shuffled_r == hinted_r and shuffled_a == hinted_a
    # every run kept; the hot PR keeps its 200 non-.py files, each cold PR's one file is d/f0.py
    assert len(shuffled_r) == n and len(shuffled_a) == 200


def test_bucket_split_holds_on_key_partitioned_input(spark):
    """Input already hash-partitioned by the PR alone (as after a per-PR window) must
    still be split by (PR, bucket) before the first level, and give the same texts."""
    files = _files(spark)
    pre = files.repartition("pr_number")
    agg = agg_file_texts(pre, ["pr_number"], bucket_rows=97)
    plan = agg._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning(pr_number#" in line and ", _b#" in line
               for line in plan.splitlines() if "Exchange" in line)
    whole = agg_file_texts(files, ["pr_number"], bucket_rows=1 << 30)
    assert sorted(map(tuple, agg.collect())) == sorted(map(tuple, whole.collect()))


def test_files_list_lines_equal_kept_file_count(spark):
    """Property: one A1 line per kept file, for every PR of the fixture tables."""
    from reviewlake.registry import KEYS, Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    kept = filter_ignored_files(t.files, ["*.test.js", "*.min.js", "package-lock.json"])
    texts = agg_file_texts(kept, KEYS, bucket_rows=3)
    counts = kept.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    j = texts.join(counts, KEYS, "full_outer")
    lines = F.size(F.split("files_list", "\n"))
    bad = j.where(F.col("n").isNull() | F.col("file_count").isNull()
                  | (lines != F.col("n")) | (F.col("file_count") != F.col("n")))
    assert bad.count() == 0 and counts.count() > 0


def test_hot_pr_timeline_in_one_bucket_is_split(spark):
    """All of a hot PR's feedback at one timestamp (one time bucket): the bucket is split
    by (time, kind, position bucket) and the text equals the unsplit one."""
    t0 = dt.datetime(2024, 1, 1)
    rev = [(1, i, f"u{i % 5}", "APPROVED", f"r{i}", t0) for i in range(400)]
    rev += [(2, 0, "u", "COMMENTED", "cold", t0)]
    com = [(1, i, "u", f"c{i}", t0) for i in range(200)]
    r = spark.createDataFrame(rev, "pr_number long, pos int, author string, state string, body string, "
                                   "submitted_at timestamp")
    c = spark.createDataFrame(com, "pr_number long, pos int, author string, body string, created_at timestamp")
    fb = union_feedback(r, None, c, ["pr_number"])
    split = {x["pr_number"]: x for x in agg_timeline(fb, ["pr_number"], bucket_rows=7).collect()}
    whole = {x["pr_number"]: x for x in agg_timeline(fb, ["pr_number"], bucket_rows=1 << 30).collect()}
    assert split == whole and split[1]["feedback_count"] == 600
    text = split[1]["timeline"]
    assert text.index("r0") < text.index("r399") and text.count("批准了PR") == 400


def test_checkpoint_folder_does_not_nest(spark):
    from reviewlake.session import checkpoint_dir, prepare
    first = checkpoint_dir(spark)
    for _ in range(150):
        prepare(spark)
    assert checkpoint_dir(spark) == first


def test_details_split_a_hot_pr_on_key_partitioned_input(spark):
    from reviewlake.operators.details import collect_files
    files = _files(spark, 3, 3000).repartition(4, "pr_number")
    whole = {r["pr_number"]: r["files"] for r in collect_files(files, ["pr_number"], bucket_rows=1 << 20).collect()}
    split = collect_files(files, ["pr_number"], bucket_rows=64)
    assert {r["pr_number"]: r["files"] for r in split.collect()} == whole
    assert "hashpartitioning(pr_number" in split._jdf.queryExecution().executedPlan().toString()
    assert "_b#" in split._jdf.queryExecution().executedPlan().toString().split("hashpartitioning", 1)[1]


def _prompt_inputs(spark, n=40):
    """Runs of ``n`` PRs (every other one with a second tenant), settings, files and feedback of their own."""
    pr = spark.range(1, n + 1).withColumnRenamed("id", "pr_number")
    both = pr.withColumn("tenant", F.lit("a")).unionAll(pr.where("pr_number % 2 = 0").withColumn("tenant", F.lit("b")))
    runs = both.select(F.concat_ws("-", "pr_number", "tenant").alias("request_id"), "pr_number", "tenant",
                       F.lit(dt.datetime(2024, 1, 1)).alias("run_ts"), F.lit(None).cast("string").alias("temp_ai_service"),
                       F.lit(None).cast("string").alias("temp_review_prompt"))
    stored = fixture_settings(spark.createDataFrame(
        [("a", "openai", "gpt-4o", "1000", "*.md", True, True, "update"), ("b", "anthropic", "m-b", "50", "*.py", True, True, "update")],
        "tenant string, ai_service string, model string, max_tokens string, ignore_files string, has_token boolean, has_key boolean, reason string"))
    files = pr.select("pr_number", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("pos")).select(
        "pr_number", "pos", F.concat(F.lit("f"), "pos", F.when(F.col("pos") % 2 == 0, ".py").otherwise(".js")).alias("name"),
        F.lit("modified").alias("status"), F.lit(1).alias("additions"), F.lit(0).alias("deletions"), F.lit("@@ diff").alias("patch"))
    reviews = pr.where("pr_number % 3 = 0").select("pr_number", F.lit(0).alias("pos"), F.lit("u").alias("author"), F.lit("APPROVED").alias("state"),
                                                   F.concat(F.lit("note "), "pr_number").alias("body"), F.lit(dt.datetime(2024, 1, 2)).alias("submitted_at"))
    return runs, stored, files, union_feedback(reviews, None, None, ["pr_number"])


def test_file_texts_are_not_shuffled_for_the_timeline(spark):
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        out = build_review_prompts(*_prompt_inputs(spark), ["pr_number"])
        plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # the last join is that of the file texts, by the key they are aggregated by
    last = next(x for x in plan if "Join" in x)
    assert "tenant" in last, last
    names = out.columns
    assert names[:2] == ["pr_number", "tenant"] and names.index("languages") < names.index("file_count") < names.index("timeline") < names.index("history")
    got = {r.request_id: r for r in out.collect()}
    assert len(got) == 60
    for key, r in got.items():
        n, tenant = key.split("-")
        assert r.error_code is None and r.file_count == (4 if tenant == "a" else 2) and r.languages == ("py, js" if tenant == "a" else "js")
        assert (f"note {n}" in r.prompt) == (int(n) % 3 == 0)


def test_request_files_are_compressed_and_hold_every_line(spark, tmp_path):
    services = [f"s{i:02d}" for i in range(OPEN_SERVICES + 4)] + [None]
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    reqs = spark.range(4200).select(
        F.concat(F.lit("r"), "id").alias("request_id"), F.lit("https://x/y").alias("endpoint"),
        F.get(F.lit(services), (F.col("id") % len(services)).cast("int")).alias("ai_service"),
        F.when(F.col("id") % 100 != 7, F.concat(F.lit('{"prompt":"'), F.repeat(F.lit("the same words again "), 40), F.lit('\\n"}'))).alias("body")).repartition(2)
    path = write_requests(reqs, str(tmp_path / "gz"))
    assert spark.conf.get(key, None) == before
    want = {(r.ai_service, r.value) for r in request_lines(reqs).collect()}
    assert len(want) == 4158
    back = spark.read.option("basePath", path).text(path).select(F.col("service").cast("string"), "value")
    assert {tuple(r) for r in back.collect()} == want and back.count() == len(want)
    files = [x for x in (tmp_path / "gz").rglob("part-*")]
    # one file a service and task, each packed
    assert len(files) <= 2 * len(services) and all(x.name.endswith(".gz") for x in files)
    assert sum(x.stat().st_size for x in files) < sum(len(v) for _, v in want) / 5
    plain = write_requests(reqs, str(tmp_path / "plain"), compression="none")
    assert {r.value for r in spark.read.text(plain).collect()} == {v for _, v in want}
    assert all(x.name.endswith(".txt") for x in (tmp_path / "plain").rglob("part-*"))
