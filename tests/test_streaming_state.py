"""State of the streaming operators: final responses, lifetimes, visit order, and sinks that may run a batch again."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewlake.operators.streams import assemble_responses
from reviewlake.operators.visits import pr_visit_feed
from reviewlake.session import scratch_path
from reviewlake.sinks import writers
from reviewlake.sources.readers import read_page_visits, read_stream_chunks
from reviewlake.streaming.assembly import assemble_stream, delta_stream, detect_pr_changes_stream, response_stream
from reviewlake.streaming.processors import LATE, NO_TIME, VISIT_COLUMNS, VisitOrder

from test_streams import SCHEMA, a_line, b_lines, cut

VISITS = "tab_id long, page_load_id long, seq long, ts timestamp, url string"


def land(spark, base, frames):
    for i, df in enumerate(frames):
        df.coalesce(1).write.parquet(f"{base}/b={i:03d}")
    return base


def responses(rng, n):
    rows, texts = [], {}
    for r in range(n):
        text = "".join(rng.choice("ab cdé中😀\n\"\\") for _ in range(rng.randint(0, 90)))
        mk, svc = (a_line, "openai") if r % 2 else (b_lines, "anthropic")
        wire = ("\n\n".join([mk(text[i:i + 7]) for i in range(0, len(text), 7)] + ["data: {broken"]) + "\n\ndata: [DONE]\n\n").encode()
        rows += cut(f"q{r}", svc, wire, rng.choice([1, 5, 37]))
        texts[f"q{r}"] = text
    return rows, texts


def test_final_responses_equal_the_batch_form(spark):
    """Shuffled over four batches, every chunk delivered again in a fifth: one row per response, as Q4 has it."""
    rng = random.Random(4)
    rows, texts = responses(rng, 10)
    rows += [r for r in cut("open", "openai", (a_line("x") + "\n").encode(), 3, last=False)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    base = land(spark, scratch_path(spark, "t5"), [*df.randomSplit([1.0] * 4, seed=2), df])
    out = scratch_path(spark, "t5-out")
    stream = read_stream_chunks(spark, base + "/*", stream=True, max_files_per_trigger=1)
    writers.write_stream(response_stream(stream), out, scratch_path(spark, "t5-ck")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("request_id", "content", "tokens", "n_malformed", "n_deltas", "status").collect())
    want = assemble_responses(df).where("ended").select("request_id", "content", "tokens", "n_malformed", "n_deltas", F.lit("done")).collect()
    assert got == sorted(tuple(r) for r in want)
    assert {r[0]: r[1] for r in got} == texts


def progressed(q, test, seconds=60):
    until = time.time() + seconds
    while time.time() < until:
        assert q.exception() is None
        if q.lastProgress and test(q.lastProgress):
            return True
        time.sleep(0.3)
    return False


def test_silent_response_is_abandoned_and_closed_keys_are_forgotten(spark):
    whole = (a_line("ab") + "\n\n" + a_line("cd") + "\n").encode()
    rows = cut("done", "openai", whole, 9) + cut("silent", "openai", whole, 9, last=False)
    base = land(spark, scratch_path(spark, "ttl"), [spark.createDataFrame(rows, SCHEMA)])
    out, ck = scratch_path(spark, "ttl-out"), scratch_path(spark, "ttl-ck")
    stream = read_stream_chunks(spark, base + "/*", stream=True)
    lines = assemble_stream(stream, timeout_ms=3000, marker_ttl_ms=6000)
    q = writers.write_stream(lines, out, ck, available_now=False)
    try:
        kinds = lambda rid: [r.kind for r in spark.read.parquet(out).where(F.col("request_id") == rid).orderBy("line_no").collect()]
        assert progressed(q, lambda p: p.batchId >= 1 and p.stateOperators[0].numRowsTotal > 0)
        assert progressed(q, lambda p: "abandoned" in kinds("silent"))
        # the markers of both responses go when their lifetime ends
        assert progressed(q, lambda p: p.stateOperators[0].numRowsTotal == 0)
        assert kinds("silent") == ["line", "line", "line", "abandoned"] and kinds("done") == ["line", "line", "line", "done"]
    finally:
        q.stop()


def test_abandoned_response_reaches_t5_and_the_dead_letters(spark):
    rows = cut("silent", "openai", (a_line("ab") + "\n" + "data: {x\n" + a_line("cd") + "\n").encode(), 9, last=False)
    base = land(spark, scratch_path(spark, "quiet"), [spark.createDataFrame(rows, SCHEMA)])
    out, deltas, dead = (scratch_path(spark, n) for n in ("quiet-out", "quiet-deltas", "quiet-dead"))
    stream = read_stream_chunks(spark, base + "/*", stream=True)
    both = [writers.write_stream(response_stream(stream, timeout_ms=2000), out, scratch_path(spark, "quiet-ck"), available_now=False),
            writers.write_delta_batches(delta_stream(stream, timeout_ms=2000), deltas, dead, scratch_path(spark, "quiet-ck"), available_now=False)]
    try:
        assert progressed(both[0], lambda p: spark.read.parquet(out).count() == 1)
        assert progressed(both[1], lambda p: p.batchId > 0 and writers.read_dead_letters(spark, dead).count() == 2)
    finally:
        for q in both:
            q.stop()
    assert [tuple(r) for r in spark.read.parquet(out).select("content", "n_malformed", "status").collect()] == [("abcd", 1, "abandoned")]
    assert [(r.kind, r.line) for r in writers.read_dead_letters(spark, dead).orderBy("line_no").collect()] == [("malformed", "data: {x"), ("abandoned", None)]
    assert [(r.content, r.done) for r in writers.read_deltas(spark, deltas).orderBy("line_no").collect()] == [("ab", False), ("cd", False)]


def test_a_batch_that_runs_again_adds_nothing(spark):
    rows = spark.createDataFrame([("a", 0, "delta", "x", None), ("a", 1, "malformed", "", "bad"), ("a", 2, "done", "", None)],
                                 "request_id string, line_no long, kind string, content string, line string")
    deltas, dead = scratch_path(spark, "again"), scratch_path(spark, "again-dead")
    for batch in (0, 1, 1, 0):
        writers.publish_batch(rows, batch, deltas, dead)
    assert sorted(tuple(r) for r in writers.read_deltas(spark, deltas).collect()) == sorted(
        [("a", 0, "x", False), ("a", 2, "", True)] * 2)
    assert [tuple(r) for r in writers.read_dead_letters(spark, dead).collect()] == [("a", 1, "malformed", "bad")] * 2


def visits(rng, n, sessions=3, span=20_000):
    paths = ["/o/r/pull/1", "/o/r/pull/2", "/o/r/pull/2/files", "/o/r/issues/4"]
    return [(rng.randrange(sessions), 0, i, rng.randrange(span), "https://github.com" + rng.choice(paths)) for i in range(n)]


def visit_frame(spark, rows):
    return spark.createDataFrame(rows, "tab_id long, page_load_id long, seq long, s long, url string").select(
        "tab_id", "page_load_id", "seq", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("ts"), "url")


def detected(spark, frames, delay):
    base = land(spark, scratch_path(spark, "visits"), frames)
    out = scratch_path(spark, "visits-out")
    stream = read_page_visits(spark, base + "/*", stream=True, max_files_per_trigger=1)
    writers.write_stream(detect_pr_changes_stream(stream, delay), out, scratch_path(spark, "visits-ck")).awaitTermination()
    return spark.read.parquet(out)


END = (99, 0, 0, 10_000_000, "https://github.com/")


def test_shuffled_arrivals_equal_the_batch_form(spark):
    """Each visit arrives up to 2000 s late, in batches by arrival: the same changes as in batch."""
    rng = random.Random(9)
    rows = visits(rng, 300)
    rows += rows[:20]           # delivered twice
    arrival = sorted(rows, key=lambda r: r[3] + rng.randrange(2000))
    frames = [visit_frame(spark, arrival[i:i + 40]) for i in range(0, len(arrival), 40)] + [visit_frame(spark, [END])]
    got = detected(spark, frames, "2000 seconds")
    want = pr_visit_feed(visit_frame(spark, list(dict.fromkeys(rows))))
    cols = want.columns
    assert got.where("error_code = 'LATE_VISIT'").count() <= 20     # a second delivery after the first was decided on
    first = got.where("error_code IS NULL").select(*cols).collect()
    assert sorted(tuple(r) for r in first) == sorted(tuple(r) for r in want.collect())


def test_visit_later_than_the_watermark_is_an_error_row(spark):
    pull = lambda n: f"https://github.com/o/r/pull/{n}"
    frames = [[(1, 0, 1, 100, pull(1)), (2, 0, 1, 5000, pull(7))], [(1, 0, 3, 6000, pull(2))], [(1, 0, 4, 9000, pull(3))],
              [(1, 0, 2, 50, pull(9)), (1, 0, 5, 9500, pull(3))], [END]]
    frames = [visit_frame(spark, f) for f in frames]
    untimed = spark.createDataFrame([(3, 0, 1, None, pull(1))], VISITS)
    got = detected(spark, [*frames[:3], untimed, *frames[3:]], "100 seconds")
    rows = sorted((r.tab_id, r.seq, r.pr_number, r.error_code) for r in got.collect())
    assert rows == [(1, 1, "1", None), (1, 2, "9", "LATE_VISIT"), (1, 3, "2", None), (1, 4, "3", None), (2, 1, "7", None),
                    (3, 1, "1", "NO_VISIT_TIME")]


def test_order_of_equal_times_is_by_seq(spark):
    pull = lambda n: f"https://github.com/o/r/pull/{n}"
    frames = [[(1, 0, 3, 100, pull(1)), (1, 0, 1, 100, pull(1))], [(1, 0, 2, 100, pull(2))], [END]]
    got = detected(spark, [visit_frame(spark, f) for f in frames], "10 seconds")
    assert sorted((r.seq, r.pr_number) for r in got.collect()) == [(1, "1"), (2, "2"), (3, "1")]


SUBMISSION = "request_id string, owner string, repo string, pr_number long, body string, body_sha256 string"


def submissions(spark, *ids):
    return spark.createDataFrame([(f"r{i}", "o", "r" if i % 3 else None, i, f"b{i}", f"h{i}") for i in ids], SUBMISSION)


def ids(df):
    return sorted(r.pr_number for r in df.collect())


def test_outbox_reads_only_the_buckets_it_touches(spark):
    outbox = scratch_path(spark, "outbox")
    writers.write_submissions(spark, submissions(spark, *range(60)), outbox)
    assert ids(writers.write_submissions(spark, submissions(spark, 3, 61, 3), outbox)) == [*range(60), 61]
    schema = submissions(spark, 1).schema
    touched = [r.bucket for r in writers._bucketed(submissions(spark, 3), writers.OUTBOX_KEY).select("bucket").collect()]
    plan = writers._committed_rows(spark, outbox, schema).where(F.col("bucket").isin(touched)).select("pr_number")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and f"bucket#{plan.split('bucket#')[1].split(' ')[0]}" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "body" not in plan.split("ReadSchema: ")[1].split("\n")[0]


def test_interleaved_batches_and_unfinished_ones_leave_no_duplicate(spark, monkeypatch):
    outbox = scratch_path(spark, "outbox")
    writers.write_submissions(spark, submissions(spark, 1, 2), outbox, batch="a")
    # a batch that was written but never committed is not there
    writers._bucketed(submissions(spark, 50), writers.OUTBOX_KEY).write.partitionBy("bucket").parquet(f"{outbox}/data/batch=dead")
    schema = submissions(spark, 1).schema
    assert ids(writers.read_outbox(spark, outbox, schema)) == [1, 2]
    # two writers: both have looked before either commits
    real, held = writers.commit, []
    monkeypatch.setattr(writers, "commit", lambda *a: held.append(a))
    writers.write_submissions(spark, submissions(spark, 2, 3, 4), outbox, batch="b")
    writers.write_submissions(spark, submissions(spark, 3, 4, 5).withColumn("request_id", F.lit("second")), outbox, batch="c")
    monkeypatch.setattr(writers, "commit", real)
    real(*held[1])
    real(*held[0])
    got = writers.read_outbox(spark, outbox, schema)
    assert ids(got) == [1, 2, 3, 4, 5]
    assert {r.pr_number: r.request_id for r in got.collect()}[3] == "second"      # committed first
    # a batch that is run again replaces itself
    assert ids(writers.write_submissions(spark, submissions(spark, 1, 2), outbox, batch="a")) == [1, 2, 3, 4, 5]


def test_settings_versions_are_seen_whole(spark):
    base = scratch_path(spark, "versions")
    one, two = spark.createDataFrame([("u1", 1)], "tenant string, n int"), spark.createDataFrame([("u1", 2), ("u2", 2)], "tenant string, n int")
    assert writers.read_settings_version(spark, base, one.schema).collect() == []
    assert writers.write_settings(one, base) == 1

    def failing(n):
        raise RuntimeError("lost")

    broken = two.withColumn("n", F.udf(failing, "int")("n"))
    with pytest.raises(Exception):
        writers.write_settings(broken, base)
    assert [tuple(r) for r in writers.read_settings_version(spark, base, one.schema).collect()] == [("u1", 1)]
    assert writers.write_settings(two, base) == 2
    assert sorted(tuple(r) for r in writers.read_settings_version(spark, base, one.schema).collect()) == [("u1", 2), ("u2", 2)]
    assert [tuple(r) for r in writers.read_settings_version(spark, base, one.schema, 1).collect()] == [("u1", 1)]
    assert writers.read_settings_version(spark, base, one.schema, 7).collect() == []


class _State:
    """A state variable held in memory that notes its calls."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def _note(self, call, value):
        self.calls.append(call)
        self.value = value

    def get(self):
        self._note("get", self.value)
        return self.value

    def update(self, value):
        self._note("update", value)

    def put(self, values):
        self._note("put", list(values))

    def appendList(self, values):
        self._note("append", [*(self.value or []), *values])

    def clear(self):
        self._note("clear", None)


class _Handle:
    def __init__(self):
        self.vars, self.timers = {}, set()

    def getValueState(self, name, schema):
        return self.vars.setdefault(name, _State([]))

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class _Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_fired_visit_timer_is_not_looked_up_again():
    """A session with visits left to wait sets its next timer without reading or clearing the one that fired."""
    handle, order = _Handle(), VisitOrder()
    order.init(handle)
    visit = lambda seq, ts: (seq, ts, "u", f"p{seq}", "o", "r", "1")
    frame = pd.DataFrame([visit(1, 1_000), visit(2, 9_000_000)], columns=VISIT_COLUMNS)
    assert list(order.handleInputRows((7, 0), iter([frame]), None)) == []
    assert handle.timers == {1}
    handle.timers.clear()
    handle.vars["due"].calls.clear()
    (out,) = order.handleExpiredTimer((7, 0), _Watermark(5_000), None)
    assert out[["tab_id", "page_load_id", "seq", "ts_us", "path", "error_code"]].values.tolist() == [[7, 0, 1, 1_000, "p1", None]]
    assert handle.vars["due"].calls == ["update"] and handle.timers == {9_000}
    # a frame with a visit of no time comes with float times
    frame = pd.DataFrame([visit(3, 500.0), visit(4, float("nan"))], columns=VISIT_COLUMNS)
    late, timeless = order.handleInputRows((7, 0), iter([frame]), None)
    assert late[["seq", "ts_us", "error_code"]].values.tolist() == [[3, 500, LATE]]
    assert timeless[["seq", "ts_us", "error_code"]].values.tolist() == [[4, None, NO_TIME]]
