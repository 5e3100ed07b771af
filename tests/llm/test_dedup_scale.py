"""What the dedup operators keep on disk, parse and write: their steps, on rows of their own."""

import random
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from reviewlake.llm import components, hmm, line_dedup, near_dup, text, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    """Groups of like texts, with a word changed in each."""
    rnd = random.Random(3)
    rows = []
    for i in range(40):
        base = [f"w{rnd.randrange(3000)}" for _ in range(60)]
        for j in range(3):
            own = base[:7 * j] + [f"new{i}x{j}"] + base[7 * j + 1:]
            rows.append((len(rows), "\n".join(" ".join(own[k:k + 20]) for k in range(0, 60, 20))))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("module,run,names", [
    (line_dedup, lambda x: line_dedup.line_report(x, least=1), {"found", "classes", "early-sets", "late-sets"}),
    (near_dup, lambda x: near_dup.near_duplicates(x, k=4), {"sets"})])
def test_superseded_tables_leave_the_disk(spark, docs, monkeypatch, module, run, names):
    made, real = {}, module.written

    def written(df, name):
        out = real(df, name)
        made[name] = (out.inputFiles()[0].rpartition("/")[0], out.count())
        return out
    monkeypatch.setattr(module, "written", written)
    assert run(docs).count() == 120
    assert names <= made.keys() and any(made[x][1] for x in names)
    assert [spark.read.parquet(made[x][0]).count() for x in sorted(names)] == [0] * len(names)


def test_hashes_of_spans_do_not_depend_on_the_way(monkeypatch):
    part = ["Ab cé \tx".encode(), b"", b"word " * 300, b"y"]
    short = text.words(part)
    assert short.hash[1] == text.words(["d cé".encode()]).hash[1]
    monkeypatch.setattr(text, "_MOST_POWERS", 1)
    assert (text.words(part).hash == short.hash).all()


def test_full_sets_come_from_their_own_lines():
    texts = ["one two\nthree four five\n", None, "\nsix one\nthree five four"]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([4, 5, 6], pa.int64()), "text": texts})
    sketch = np.zeros(1 << 12, dtype=np.uint64)
    for b in near_dup.in_sketch.__globals__["probes"](line_dedup._place(np.array([6]), np.array([2])), len(sketch) * 64):
        sketch[int(b[0]) >> 6] |= np.uint64(1) << np.uint64(int(b[0]) & 63)
    got = [r for out in line_dedup._sets(1, type("Held", (), {"value": sketch}))(iter([batch])) for r in out.to_pylist()]
    want = line_dedup.Lines([b"three four five"], 1)
    assert [(r["fp1"], r["fp2"]) for r in got] == [tuple(int(x.view(np.int64)[0]) for x in want.fp)]
    assert sorted(np.frombuffer(got[0]["words"], dtype=np.uint64)) == sorted(want.hash)


def test_order_of_words_with_equal_keys():
    """Words that the packed key can't tell apart are in order all the same."""
    h = np.array([(5 << 47) | (9 << 20) | x for x in (7, 3, 7, 1)] + [3], dtype=np.uint64)
    line = np.array([0, 0, 0, 0, 1])
    assert h[line_dedup._order(line, h, None)].tolist() == sorted(h[:4].tolist()) + [3]


def test_components_write_two_tables_a_round(spark, monkeypatch):
    names, real = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: names.append(name) or real(df, name))
    rnd = random.Random(5)
    path = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (7, 7)]
    rnd.shuffle(path)
    rounds, stars = [], components._stars
    monkeypatch.setattr(components, "_stars", lambda e: rounds.append(1) or stars(e))
    edges = spark.createDataFrame(path, "u long, v long").repartition(8)
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {90: 90, 95: 90, 100: 90}
    assert len(rounds) > 1 and len(names) == 1 + 2 * (len(rounds) - 1)


def test_sides_of_the_prefix_join_share_a_shuffle_and_the_smaller_has_fewer_rows(spark, monkeypatch):
    made, real = {}, line_dedup.written

    def written(df, name):
        made[name] = df, real(df, name)
        return made[name][1]
    monkeypatch.setattr(line_dedup, "written", written)
    # 40 words a line; lines 0 and 1 share 36 of them: 36 / 44 >= 80 %, lines 2 and 3 only 35: 35 / 45 < 80 %
    lines = [[f"w{i}x{j}" for j in range(40)] for i in range(30)]
    lines[1], lines[3] = lines[0][:36] + lines[1][36:], lines[2][:35] + lines[3][35:]
    # 20 of 25 words, the smaller set later
    lines[5] = lines[4][:20]
    lines[4] = lines[4][:25]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.removed for r in line_dedup.line_report(docs, least=1).collect()}
    assert {i for i, x in got.items() if x} == {1, 5}
    plan = made["pairs"][0]._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join"):].split("RepartitionByExpression")
    assert len(below) == 3 and "rand(" in plan
    shapes = [re.sub(r"#\d+L?", "", x.split("Relation", 1)[0]) for x in below[1:]]
    assert re.sub(r"[\s:+-]", "", shapes[0]) == re.sub(r"[\s:+-]", "", shapes[1])
    # classes of one text that keep their lines are not joined with all lines
    assert made["fates"][1].count() == 2


def test_number_of_lines_is_that_of_line_feeds(spark):
    texts = [None, "", "\n", "a", "a\n", "\n\na\n\n", "a\r\nb c\x0b", "é\n" * 3]
    got = line_dedup.line_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), least=1).collect()
    assert {r.doc_id: r.n_lines for r in got} == {i: (t or "").count("\n") + 1 for i, t in enumerate(texts)}


def test_batches_of_texts_are_held_as_distinct_words(monkeypatch):
    monkeypatch.setattr(hmm, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("At", (), {"partitionId": lambda self: 3})())}))
    monkeypatch.setattr(hmm, "WORD_ROWS", 500, raising=False)
    rnd = np.random.default_rng(5)
    texts = [" ".join(f"word{x}" for x in rnd.zipf(1.5, 4000) % 3000) for _ in range(900)] + [None, ""]
    ids = [None, *range(1, len(texts))]
    out = [i % 7 == 2 for i in range(len(texts))]
    pdf = pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "text": texts, "held_out": out})
    list(hmm._encode(iter([pdf[:2]])))
    tracemalloc.start()
    for _ in hmm._encode(iter([pdf])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    frames = list(hmm._encode(iter([pdf])))
    assert peak < 5 * sum(len(t or "") for t in texts)
    rows = pd.concat(frames)
    seqs, words = rows[rows["word"].isna()], rows[rows["word"].notna()].sort_values("local")
    assert all(len(f) <= 500 for f in frames if f["word"].notna().any()) and words["local"].tolist() == list(range(len(words)))
    assert [None if pd.isna(x) else x for x in seqs["doc_id"]] == ids and seqs["held_out"].tolist() == out
    w = text.words(text.encoded(texts))
    word = words["word"].to_numpy(dtype=np.int64)
    for i, (code, size) in enumerate(zip(seqs["codes"], seqs["size"])):
        want = w.hash[w.offset[i]:w.offset[i + 1]].view(np.int64)
        assert size == len(want) and np.array_equal(word[np.frombuffer(zlib.decompress(code), dtype=np.int32)], want)
    learnt = np.concatenate([w.hash[w.offset[i]:w.offset[i + 1]].view(np.int64) for i in range(len(texts)) if not out[i]])
    counted = dict(zip(*np.unique(learnt, return_counts=True)))
    assert dict(zip(word, words["n"])) == {x: counted.get(x, 0) for x in word}


@pytest.mark.parametrize("tasks", [1, 5])
def test_words_are_ordered_by_their_count_in_all_texts(spark, tasks):
    """Word number i stands in i texts; one of them twice in a text, one far oftener than the others."""
    words = [f"rare{i}" for i in range(60)]
    rows = [(i, f"{w} own{i}x{j}\n{w}" if i == 59 else f"{w} own{i}x{j}") for i, w in enumerate(words) for j in range(i)]
    rows += [(60, "often " * 300), (61, None), (62, "")]
    docs = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "mark long, doc_id long, text string").repartition(tasks)
    rank = line_dedup._ranks(docs)
    cells = line_dedup._cell(text.words([" ".join([*words, "often"]).encode()]).hash)
    assert sorted(rank) == list(range(line_dedup.CELLS)) and len(set(cells)) == 61
    assert (np.diff(rank[cells]) > 0).all()
    some = np.flatnonzero(rank > rank[cells[58]])
    assert set(cells[59:]) == set(some)


def test_counters_hold_any_number():
    one = pa.RecordBatch.from_pydict({"text": ["a " * 70_000 + "b " * 300 + "c"]})
    got = list(line_dedup._counts(iter([one, one])))[0].to_pydict()
    total = line_dedup._summed(pd.DataFrame({"block": 0, "counts": [got["counts"][i] for i in range(len(got["block"])) for _ in range(2)]}))
    assert np.frombuffer(total["counts"][0], dtype=np.int64).sum() == 4 * 70_301
    cells = line_dedup._cell(text.words([b"a b c"]).hash)
    for cell, n in zip(cells, (140_000, 600, 2)):
        row = got["counts"][cell // line_dedup.BLOCK]
        assert np.frombuffer(row, dtype=f"u{len(row) // line_dedup.BLOCK}")[cell % line_dedup.BLOCK] == n


def test_pipeline_orders_words_by_all_its_documents(spark, monkeypatch):
    held, real = [], line_dedup.broadcast
    monkeypatch.setattr(line_dedup, "broadcast", lambda s, value: held.append(value) or real(s, value))
    words = [f"rare{i}" for i in range(40)]
    rows = [(f"{w} own{i}x{j}", "s", "en") for i, w in enumerate(words) for j in range(i)]
    docs = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "doc_id long, text string, source string, lang string").repartition(4)
    # two words a line, one of them its own: no two lines are alike
    assert corpus_pipeline.dedup_lines(spark, docs, "").count() == len(rows)
    cells = line_dedup._cell(text.words([" ".join(words).encode()]).hash)
    assert len(set(cells)) == 40 and (np.diff(held[0][cells]) > 0).all()


def test_words_are_those_between_separators():
    rnd = random.Random(8)
    for _ in range(200):
        part = [bytes(rnd.choice([rnd.randrange(256), 32, 10, 65, 122, 13, 0]) for _ in range(rnd.choice([0, 1, 40]))) for _ in range(3)]
        for separators in (text.SPACES, toxicity.SEPARATORS):
            for lower in (True, False):
                low = [b.translate(text._LOWER) if lower else b for b in part]
                want = [re.findall(rb"[^" + re.escape(bytes(np.flatnonzero(separators).tolist())) + rb"]+", b) for b in low]
                w = text.words(part, separators, lower)
                got = [w.buf[a:b].tobytes() for a, b in zip(w.start, w.end)]
                assert [got[a:b] for a, b in zip(w.offset[:-1], w.offset[1:])] == want
