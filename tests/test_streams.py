"""Stream reassembly: golden rows (T1-T5) and batch = stream."""

import json
import random

from pyspark.sql import functions as F

from reviewlake.operators.streams import (assemble_lines, assemble_responses, classify_lines,
                                          running_content)
from reviewlake.session import scratch_path
from reviewlake.sources.readers import read_stream_chunks
from reviewlake.sinks import writers
from reviewlake.streaming.assembly import delta_stream, response_stream, responses_from_deltas

SCHEMA = "request_id string, seq int, service string, payload binary, is_last boolean"


def a_line(text):
    return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]}, ensure_ascii=False)


def b_lines(text):
    return ("event: content_block_delta\ndata: "
            + json.dumps({"type": "content_block_delta", "delta": {"text": text}}, ensure_ascii=False))


def cut(rid, service, wire: bytes, size: int, last=True):
    n = max(1, -(-len(wire) // size))
    return [(rid, i, service, bytearray(wire[i * size:(i + 1) * size]), last and i == n - 1)
            for i in range(n)]


def content(spark, chunks, **kw):
    df = spark.createDataFrame(chunks, SCHEMA)
    return {r["request_id"]: r for r in assemble_responses(df, **kw).collect()}


def test_golden_dialect_a(spark):
    lines = [a_line("你好"), "", "data:" + a_line("x")[6:], "data: ", a_line("世界") + "xyz",
             "data: {bad json", '  ', 'data: {"id": 1}', 'data: {"choices": []}',
             a_line("!") + "\r", ": comment", "data: [DONE]", a_line("tail")]
    wire = "\n".join(lines).encode()
    for size in (1, 3, 7, 64, 10_000):
        got = content(spark, cut("r1", "openai", wire, size))["r1"]
        assert got["content"] == "你好!", size
        assert got["n_malformed"] == 3          # trailing garbage, bad json, missing choices
        assert got["ended"] is True
    flushed = content(spark, cut("r1", "openai", wire, 5), flush_tail=True)["r1"]
    assert flushed["content"] == "你好!tail"


def test_golden_dialect_b_and_events(spark):
    wire = "\n\n".join([b_lines("a"), "event: ping\ndata: {\"type\":\"ping\"}", b_lines("b"),
                        "event: message_stop\ndata: {\"type\":\"message_stop\"}"]) + "\n"
    got = content(spark, cut("r2", "anthropic", wire.encode(), 4))["r2"]
    assert got["content"] == "ab" and got["n_malformed"] == 0


def test_shuffled_and_missing_last(spark):
    wire = ("\n\n".join(a_line(f"p{i}") for i in range(30)) + "\n").encode()
    chunks = cut("r3", "openai", wire, 5)
    random.Random(3).shuffle(chunks)
    assert content(spark, chunks)["r3"]["content"] == "".join(f"p{i}" for i in range(30))
    open_ended = cut("r4", "openai", wire, 5, last=False)
    got = content(spark, open_ended)["r4"]
    assert got["ended"] is False


def test_multibyte_cut_inside_characters(spark):
    text = "çà😀中文" * 20
    wire = ("\n\n".join(a_line(text[i:i + 3]) for i in range(0, len(text), 3)) + "\n").encode()
    for size in (1, 2, 5):
        assert content(spark, cut("r5", "openai", wire, size))["r5"]["content"] == text


def test_running_content(spark):
    wire = ("\n".join(a_line(x) for x in ["a", "b", "c"]) + "\n").encode()
    df = spark.createDataFrame(cut("r6", "openai", wire, 4), SCHEMA)
    lines = classify_lines(assemble_lines(df))
    deltas = lines.where((F.col("kind") == "data") & (F.col("content") != "")).select(
        "request_id", "line_no", "content")
    shown = [r["shown"] for r in running_content(deltas).orderBy("line_no").collect()]
    assert shown == ["a", "ab", "abc"]


def test_batch_equals_stream(spark):
    rng = random.Random(11)
    rows = []
    texts = {}
    for r in range(12):
        text = "".join(rng.choice("ab cdé中😀\n\"\\") for _ in range(rng.randint(0, 120)))
        texts[f"q{r}"] = text
        svc = "openai" if r % 2 else "anthropic"
        parts = [text[i:i + 7] for i in range(0, len(text), 7)]
        mk = a_line if svc == "openai" else b_lines
        wire = ("\n\n".join(mk(p) for p in parts) + "\n\ndata: [DONE]\n\n").encode()
        rows += cut(f"q{r}", svc, wire, rng.choice([1, 5, 37]))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    batch = {r["request_id"]: r["content"] for r in assemble_responses(df).collect()}
    assert batch == texts
    again = {r["request_id"]: (r["content"], r["ended"]) for r in assemble_responses(df.unionAll(df)).collect()}
    assert again == {k: (t, True) for k, t in texts.items()}

    base = scratch_path(spark, "test-chunks")
    # the last file set delivers every chunk again
    for i, part in enumerate([*df.randomSplit([1.0, 1.0, 1.0], seed=5), df]):
        part.coalesce(1).write.parquet(f"{base}/b={i}")
    stream = read_stream_chunks(spark, base + "/*", stream=True, max_files_per_trigger=1)
    out, ck = scratch_path(spark, "test-deltas"), scratch_path(spark, "test-ckpt")
    q = (delta_stream(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    deltas = writers.delta_rows(spark.read.parquet(out))
    streamed = {r["request_id"]: r["content"] for r in responses_from_deltas(deltas).collect()}
    assert streamed == texts
    assert deltas.where("done").count() == len(texts)


def test_strict_json_payloads(spark):
    from reviewlake.functions.stream import is_strict_json
    cases = {
        'garbage': False, '{"a":1}xyz': False, '{"a":1}{"b":2}': False, '{"a":1},{"b":2}': False,
        '': False, "{'a':1}": False, '{"a":1,}': False, '{"a":01}': False, '{"a":NaN}': False,
        '{"a":': False, '{"a":1}': True, '[1,2]': True, '"s"': True, '{"choices":[{"delta":{}}]}': True,
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = dict(df.select("p", is_strict_json("p")).collect())
    assert got == cases


def test_input_order_never_matters(spark):
    wire = ("\n\n".join(a_line(f"w{i}") for i in range(40)) + "\n").encode()
    rows = cut("r7", "openai", wire, 3)
    a = content(spark, rows)["r7"]["content"]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).sortWithinPartitions(F.rand(1))
    b = assemble_responses(df).first()["content"]
    assert a == b == "".join(f"w{i}" for i in range(40))


def test_restart_from_checkpoint_is_exactly_once(spark):
    """A query stopped after the first half of every response (a lost driver, say) and
    restarted on the same checkpoint finishes every response once: the unfinished line
    and the early chunks live in the checkpointed state, the sink commits each batch once."""
    rng = random.Random(23)
    texts, first, second = {}, [], []
    for r in range(8):
        text = "".join(rng.choice("ab cé中😀\n") for _ in range(rng.randint(20, 90)))
        texts[f"s{r}"] = text
        svc = "openai" if r % 2 else "anthropic"
        mk = a_line if svc == "openai" else b_lines
        wire = ("\n\n".join(mk(text[i:i + 5]) for i in range(0, len(text), 5))
                + "\n\ndata: [DONE]\n\n").encode()
        rows = cut(f"s{r}", svc, wire, 4)
        half = len(rows) // 2
        first += rows[:half]
        second += rows[half:]
    base = scratch_path(spark, "restart-chunks")
    out, ck = scratch_path(spark, "restart-responses"), scratch_path(spark, "restart-ckpt")
    deltas, dead, ck2 = (scratch_path(spark, n) for n in ("restart-deltas", "restart-dead", "restart-ckpt"))

    def run_once():
        stream = read_stream_chunks(spark, base + "/*", stream=True)
        writers.write_stream(response_stream(stream), out, ck).awaitTermination()
        writers.write_delta_batches(delta_stream(stream), deltas, dead, ck2).awaitTermination()

    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(f"{base}/b=0")
    run_once()
    assert spark.read.parquet(out).count() == 0
    assert writers.read_deltas(spark, deltas).where("done").count() == 0
    spark.createDataFrame(second, SCHEMA).coalesce(1).write.parquet(f"{base}/b=1")
    run_once()
    run_once()  # nothing new: no batch, no duplicate rows
    got = spark.read.parquet(out).collect()
    assert sorted((r.request_id, r.content, r.status) for r in got) == sorted((k, t, "done") for k, t in texts.items())
    rows = writers.read_deltas(spark, deltas)
    assert rows.count() == rows.distinct().count() == rows.select("request_id", "line_no").distinct().count()
    assert {r.request_id: r.content for r in responses_from_deltas(rows).collect()} == texts
    assert writers.read_dead_letters(spark, dead).count() == 0


def test_null_payload_chunk_counts_but_adds_no_text(spark):
    wire = ("\n\n".join(a_line(w) for w in ["ab", "cd", "ef"]) + "\n\ndata: [DONE]\n\n").encode()
    rows = cut("n1", "openai", wire, 6)
    rows.insert(3, ("n1", 3, "openai", None, False))
    rows = [(r[0], i, r[2], r[3], i == len(rows) - 1) for i, r in enumerate(rows)]
    got = content(spark, rows)["n1"]
    assert got["content"] == "abcdef" and got["ended"]
    assert got["chunk_count"] == len(rows) and got["total_bytes"] == len(wire)
    assert got["n_malformed"] == 0 and got["n_deltas"] == 3


def test_null_event_is_malformed_and_falsy_content_is_no_delta(spark):
    from reviewlake.functions.stream import extract_delta, line_kind
    oa, an = '{"choices":[{"delta":{"content":%s}}]}', '{"type":"content_block_delta","delta":{"text":%s}}'
    values = [("0", ""), ("false", ""), ("0.0", ""), ("null", ""), ('""', ""), ('"0"', "0"), ('"false"', "false"), ("5", "5"), ('"a"', "a")]
    rows = [(s, "data: " + f % v, "data", want) for s, f in (("openai", oa), ("anthropic", an)) for v, want in values]
    rows += [("openai", "data: null", "malformed", ""), ("anthropic", "data: null", "malformed", ""), ("anthropic", "data: 5", "data", "")]
    got = spark.createDataFrame(rows, "service string, line string, kind string, delta string").select(
        "service", "line", "kind", "delta", line_kind("service", "line").alias("got_kind"), extract_delta("service", "line").alias("got_delta"))
    assert [r for r in got.collect() if (r.kind, r.delta) != (r.got_kind, r.got_delta)] == []


def _odd_responses():
    rng = random.Random(31)
    rows = []
    for r in range(6):
        svc, mk = ("openai", a_line) if r % 2 else ("anthropic", b_lines)
        lines = [mk("".join(rng.choice("ab é中😀\n") for _ in range(rng.randint(0, 40)))) for _ in range(8)]
        lines.insert(3, "data: {cut " + "x" * 60)
        lines.insert(5, "")
        rows += cut(f"o{r}", svc, ("\n".join(lines) + ("\n" if r % 3 else "")).encode(), rng.choice([1, 3, 200]))
    rows = [r for r in rows if not (r[0] == "o4" and r[1] in (0, 1, 7))]        # lost chunks
    return rows + rows[::5] + [("none", 0, "openai", None, True), ("one", 0, "openai", bytearray(b"\n"), True)]


def test_segments_give_the_same_lines_and_responses(spark):
    df = spark.createDataFrame(_odd_responses(), SCHEMA).repartition(5)
    for flush in (False, True):
        lines = [sorted(tuple(r) for r in assemble_lines(df, flush, segment=s).collect()) for s in (1, 3, 10, 1 << 20)]
        assert lines[0] == lines[1] == lines[2] == lines[3]
        whole = [sorted(tuple(r) for r in assemble_responses(df, flush, segment=s).collect()) for s in (1, 2, 7, 1 << 20)]
        assert whole[0] == whole[1] == whole[2] == whole[3]
        parsed = classify_lines(assemble_lines(df, flush)).groupBy("request_id").agg(
            F.count_if(F.col("kind") == "malformed").alias("bad"),
            F.count_if((F.col("kind") == "data") & (F.col("content") != "")).alias("n")).collect()
        by_lines = {r.request_id: (r.n, r.bad) for r in parsed}
        assert {r[0]: (r[4], r[5]) for r in whole[0] if r[4] or r[5]} == {k: v for k, v in by_lines.items() if v != (0, 0)}


def test_long_response_runs_over_many_tasks(spark):
    """60,000 chunks of one response: no task holds a large part of them, in every shuffle of chunk data."""
    chunks = spark.range(60_000).select(
        F.when(F.col("id") < 60_000, "hot").otherwise("cold").alias("request_id"), F.col("id").cast("int").alias("seq"), F.lit("openai").alias("service"),
        F.encode(F.concat(F.lit(a_line("x")), F.lit("\n")), "UTF-8").alias("payload"), (F.col("id") == 59_999).alias("is_last"))
    got = assemble_responses(chunks, segment=1000)
    r = got.first()
    assert r.content == "x" * 60_000 and r.ended and r.chunk_count == 60_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(request_id") == 2 and "_seg#" in plan.split("Exchange hashpartitioning(")[2].split(")")[0]
    spread = chunks.select(F.floor(F.col("seq") / 1000).alias("s"), "request_id").repartition(16, "request_id", "s").groupBy(
        F.spark_partition_id()).count().collect()
    assert max(x["count"] for x in spread) < 20_000


def test_chunk_statistics_count_a_redelivered_chunk_once(spark):
    from reviewlake.operators.streams import stream_status
    df = spark.createDataFrame(_odd_responses(), SCHEMA)
    cols = ["request_id", "service", "chunk_count", "total_bytes", "max_chunk_bytes", "ended"]
    want = assemble_responses(df).select(*cols).collect()
    assert sorted(tuple(r) for r in stream_status(df).select(*cols).collect()) == sorted(tuple(r) for r in want)
    assert not {r.request_id: r.ended for r in want}["o4"]


def test_frames_asked_for_only(spark):
    deltas = spark.createDataFrame([("a", 2 * i, f"é{i}😀") for i in range(50)] + [("b", 1, "x")], "request_id string, line_no long, content string")
    every = {(r.request_id, r.line_no): r.shown for r in running_content(deltas).collect()}
    frames = spark.createDataFrame([("a", 6), ("a", 98), ("b", 7)], "request_id string, line_no long")
    some = {(r.request_id, r.line_no): r.shown for r in running_content(deltas, frames).collect()}
    assert some == {k: every[k] for k in (("a", 6), ("a", 98))}
    assert every["a", 6] == "é0😀é1😀é2😀é3😀" and len(every) == 51
