"""The training-data operators against brute force on small tables, and on odd input."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reviewlake.llm.components import connected_components
from reviewlake.llm import decontaminate, hmm, licences, line_dedup, mixing, near_dup, registry, revisits, topk, toxicity, word_pieces

DOC = "doc_id long, text string, source string, lang string, n_chars long, node string, rate string"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "te") for b in ("ra", "su", "no", "") for c in ("x", "y", "zé", "w")]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def corpus(seed=3, n=60):
    """Random texts, copies, near copies, nulls, an empty text, a null id, a repeated row and a very long text."""
    rnd = random.Random(seed)
    text = lambda k: " ".join(rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(k))
    texts = ["\n".join(text(rnd.randrange(3, 14)) for _ in range(rnd.randrange(1, 6))) for _ in range(n)]
    for i in range(0, n, 4):
        w = texts[i].split(" ")
        w[len(w) // 2] = "other"
        texts.append(" ".join(w))
        texts.append(texts[i].upper())
    texts += ["", "  \n ", None, "one two", "one two", text(5000)]
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "en" if i % 2 else "fr", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return rows + [rows[5], (None, texts[0], "s0", "en", 1, "x", "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def components(sets, percent):
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, empty, k):
    sets = {}
    for i, t, *_ in corpus():
        if i is not None:
            w = split(t)
            sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    want = components(sets, 80)
    got = near_dup.near_duplicates(docs, k=k).collect()
    assert len(got) == len(corpus())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_one_large_group(spark):
    """Copies of one text with a word changed, each unlike the others' change, form one group."""
    base = [f"w{i}" for i in range(80)]
    rows = [(j, " ".join(base[:j % 70] + [f"new{j}"] + base[j % 70 + 1:])) for j in range(300)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    sets = {j: {tuple(t.split()[i:i + 4]) for i in range(77)} for j, t in rows}
    want = components(sets, 80)
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_parity_filter_loses_no_link(spark, percent):
    rnd = random.Random(percent)
    rows, want = [], set()
    for i in range(400):
        size = rnd.choice([1, 4, 30, 200, 3000])
        u = {rnd.getrandbits(64) for _ in range(size)}
        v = set(rnd.sample(sorted(u), size - int(size * rnd.random() * 0.6))) | {rnd.getrandbits(64) for _ in range(int(size * rnd.random() * 0.3))}
        if 100 * len(u & v) >= percent * len(u | v):
            want.add(i)
        bits = [near_dup.parity(np.array(sorted(x), dtype=np.uint64)).tolist() for x in (u, v)]
        rows.append((i, len(u), len(v), *bits))
    pairs = spark.createDataFrame(rows, "i int, n_u int, n_v int, p_u array<long>, p_v array<long>")
    kept = {r.i for r in pairs.where(near_dup._parities(percent)).collect()}
    assert want <= kept and len(kept) < len(rows)


def test_merging_components_is_grouping_all_links(spark):
    rnd = random.Random(11)
    links = [(a, b) for a, b in ((rnd.randrange(90), rnd.randrange(90)) for _ in range(70)) if a != b]
    old, new = links[:40], links[40:]
    frame = lambda x: spark.createDataFrame(x, "u long, v long")
    merged = near_dup._merged(connected_components(frame(old)), frame(new))
    assert sorted(map(tuple, merged.collect())) == sorted(
        map(tuple, connected_components(frame(links)).collect()))


def test_line_dedup(docs, empty):
    rows = sorted({r[:2] for r in corpus() if r[0] is not None})
    lines = [(i, j, frozenset(split(x))) for i, t in rows for j, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= 5]
    want = {(i, j) for i, j, s in lines if any(
        (a, b) < (i, j) and 100 * len(s & o) >= 80 * len(s | o) for a, b, o in lines)}
    got = line_dedup.line_report(docs).where("doc_id IS NOT NULL").collect()
    assert {(r.doc_id, j) for r in got for j in r.removed} == want and want
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.where("doc_id IS NOT NULL").collect():
        t = dict(rows)[r.doc_id]
        assert r.text == (None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (r.doc_id, j) not in want))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_in_one_large_group(spark):
    """Lines that are copies of one line with a word changed; the lines of one text count too."""
    base = [f"w{i}" for i in range(12)]
    line = lambda j: " ".join(base[:j % 11] + [f"new{j}"] + base[j % 11 + 1:])
    rows = [(i, "\n".join(line(3 * i + j) for j in range(3))) for i in range(70)] + [(70, " ".join(base) + "\n" + line(1))]
    lines = [(i, j, frozenset(x.split())) for i, t in rows for j, x in enumerate(t.split("\n"))]
    want = {(i, j) for i, j, s in lines if any((a, b) < (i, j) and 100 * len(s & o) >= 80 * len(s | o) for a, b, o in lines)}
    got = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, j) for r in got for j in r.removed} == want and want


def test_line_dedup_of_short_lines(spark, docs, tmp_path):
    """The query and the pipeline take lines of any number of words; four words match five that hold them."""
    short = [(0, "Yes.\nall rights reserved"), (1, "a b c d\nYES.\n"), (2, "d c b a e\nAll rights\treserved\nall rights"),
             (3, "x x x x x x\nx\n\n \nno"), (4, "a b c\na b c f"), (5, "f c b a")]
    spark.createDataFrame(short, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for rows, report, out in ((short, registry.op4_line_dedup(spark, str(tmp_path)), corpus_pipeline.dedup_lines(spark, frame, "")),
                              (sorted({r[:2] for r in corpus() if r[0] is not None}), None, corpus_pipeline.dedup_lines(spark, docs, ""))):
        lines = [(i, j, frozenset(split(x))) for i, t in rows for j, x in enumerate((t or "").split("\n"))]
        want = {(i, j) for i, j, s in lines if s and any(
            (a, b) < (i, j) and 100 * len(s & o) >= 80 * len(s | o) for a, b, o in lines)}
        assert any(len(s) < 5 for i, j, s in lines if (i, j) in want)
        if report is not None:
            assert (2, 0) in want
            assert {r.doc_id: r.n_removed for r in report.collect()} == {i: sum(a == i for a, _ in want) for i, _ in rows}
        for r in out.where("doc_id IS NOT NULL").collect():
            t = dict(rows)[r.doc_id]
            assert r.text == (None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (r.doc_id, j) not in want))


def test_contamination(spark, docs, empty):
    source = corpus()[-3][1].split(" ")      # the very long text
    items = [(1, " ".join(source[100:140])), (2, " ".join(source[4000:4005])), (3, " ".join(WORDS[:20])), (4, None), (5, "...")]
    bench = spark.createDataFrame(items + [items[0]], "item_id long, text string")
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    got = decontaminate.contamination(docs, bench).collect()
    assert len(got) == len(corpus())
    texts = {i: t for i, t, *_ in corpus()}
    for r in got:
        w, hit, found = word(texts[r.doc_id]), set(), set()
        for i, t in items:
            x = word(t)
            n = min(13, len(x))
            for s in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == x[s:s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(i))
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(found))
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.remove_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_top_k(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(20)], "x") for i in range(400)]
    rows += [(400, rows[3][1], "x"), (401, None, "x"), (402, [0.1] * 19 + [None], "x"), (403, [math.inf] * 20, "x"), (None, rows[3][1], "x"), rows[50]]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    q = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows[:401]}
    got = topk.top_k(e, F.col("vec_id") % 50 == 0, k=5, block_vectors=64, block_queries=3).collect()
    for i in [x for x in q if x % 50 == 0]:
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:5]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert topk.top_k(e.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_word_pieces(docs, empty):
    begin, go_on = ["k", "ka", "kara", "l", "lo", "m", "mi", "t", "te", "o", "one", "two"], list("abcdefghijklmnopqrstuvwxyz0123456789é") + ["ra", "rax1", "su", "noz", "12"]
    a, b = set(begin), set(go_on)

    def count(w):
        at, n = 0, 0
        while at < len(w):
            end = next((e for e in range(len(w), at, -1) if w[at:e] in (b if at else a)), None)
            if end is None:
                return -1
            at, n = end, n + 1
        return n
    for r, text in zip(*[word_pieces.token_counts(docs, (begin, go_on)).orderBy("doc_id").collect(), sorted(corpus(), key=lambda r: (r[0] is not None, r[0]))]):
        c = [count(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text[1] or "")]
        assert (r.doc_id, r.n_words, r.n_tokens, r.n_unknown) == (text[0], len(c), sum(x if x >= 0 else 1 for x in c), sum(x < 0 for x in c))
    assert word_pieces.token_counts(empty, (begin, go_on)).count() == 0


def test_hmm(docs, empty):
    held = F.col("doc_id") % 5 == 2
    got = hmm.language_scores(docs, held).collect()
    train = Counter(t for i, x, *_ in corpus() if i is None or i % 5 != 2 for t in [*split(x), None])
    n, v = sum(train.values()), len(train)
    texts = {i: x for i, x, *_ in corpus()}
    for r in got:
        w = [*split(texts[r.doc_id]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(train[t] > 0 for t in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in w))
        assert math.isfinite(r.score) and r.score < 0
    assert len(got) == len(corpus()) and hmm.language_scores(empty, held).count() == 0


def test_forward_is_the_sum_over_all_paths():
    import itertools

    import numpy as np
    rnd = np.random.default_rng(0)
    m = hmm.Model.of(rnd.random(hmm.N_COUNTS) * 5)
    seqs = [np.array([3, 7, 0]), np.array([5, 0]), np.array([0])]
    for s, got in zip(seqs, hmm.forward(m, seqs)):
        p = sum(m.start[z[0]] * m.emit[s[0], z[0]] * math.prod(m.move[a, b] * m.emit[o, b] for a, b, o in zip(z, z[1:], s[1:]))
                for z in itertools.product(range(hmm.STATES), repeat=len(s)))
        assert got == pytest.approx(math.log(p))
    c = hmm.expected_counts(m, seqs)
    assert c[:hmm.STATES].sum() == pytest.approx(3) and c[hmm.STATES + hmm.STATES ** 2:].sum() == pytest.approx(6)
    better = hmm.Model.of(c)
    assert hmm.forward(better, seqs).sum() > hmm.forward(m, seqs).sum()


def test_toxicity(spark, empty):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        w = [rnd.choice(WORDS) for _ in range(30)]
        if i % 4 == 0:
            w[rnd.randrange(30)] = rnd.choice(["vileness", "vilest", "rotten"])
        rows.append((i, " ".join(w)))
        labels.append((i, i % 4 == 0))
    d = spark.createDataFrame([*rows, (None, "rotten vilest"), (401, None), rows[0]], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(y)) for i, y in labels if i % 5] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(d, lab).collect()
    assert len(got) == 403
    for r in got:
        bad = r.doc_id is None or (r.doc_id < 400 and r.doc_id % 4 == 0)
        assert (r.score >= 0.5) == bad
    assert toxicity.toxicity(empty, lab).count() == 0
    assert {r.score for r in toxicity.toxicity(d, lab.limit(0)).collect()}.__len__() == 1


def test_toxic_words_of_few_examples(spark):
    """Twenty toxic words, each in 12 of 240 toxic texts and nowhere else, with a balanced sample of a larger corpus."""
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(4000):
        w = [rnd.choice(WORDS) for _ in range(30)]
        if i < 240:
            w[rnd.randrange(30)] = f"{chr(97 + i % 20)}{chr(98 + i % 20)}vile"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i < 240)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([x for x in labels if x[0] % 6], "doc_id long, toxic int")
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.toxicity(d, lab, per_label=200).collect()}
    held = [i for i in range(240) if i % 6 == 0]
    assert sum(got[i] for i in held) >= 0.9 * len(held)
    assert sum(got[i] for i in range(240, 4000)) <= 40


def test_block_max_search_is_exact():
    import numpy as np
    rnd = np.random.default_rng(2)
    index = toxicity.Index(np.arange(50, dtype=np.uint64), np.ones(50), prior=0.1)
    vec = []
    for _ in range(300):
        t = np.sort(rnd.choice(50, 6, replace=False))
        w = rnd.random(6)
        vec.append((t, w / np.sqrt((w * w).sum())))
    index.add(vec, rnd.integers(0, 2, 300).astype(float))
    for t, w in vec[:40]:
        full = w @ index.weights[t]
        best = np.lexsort((np.arange(len(full)), -full))[:toxicity.NEIGHBOURS]
        assert index.vote(t, w)[1].tolist() == best.tolist()


def test_mixing(docs, empty):
    powers = {"source": 0.0, "lang": 0.5}
    out = mixing.mix(docs, powers, 0.5).collect()
    assert len(out) == len(corpus())
    total = sum(r.tokens for r in out)
    assert sum(r.rate * r.tokens for r in out) == pytest.approx(0.5 * total, rel=1e-6)
    for s in ("s0", "s1", "s2", None):
        assert sum(r.rate * r.tokens for r in out if r.source == s) == pytest.approx(0.5 * total / 4, rel=1e-6)
    assert all(r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in out)
    assert mixing.mix(empty, powers, 0.5).count() == 0


def test_revisits(spark):
    rec = [(1, "response", 200, "https://www.a.org/x/", 10, {"etag": '"1"', "server": "s"}, "b1"),
           (2, "revisit", 304, "http://A.org/x#f", 300_000, {"etag": 'W/"1"', "date": "d", "set-cookie": "no"}, None),
           (3, "revisit", 304, "http://a.org/x", 5, {"etag": '"1"'}, None),
           (4, "response", 200, "http://a.org/x", 400_000, None, "b2"),
           (5, "revisit", 304, "http://a.org/x", 400_000, {"etag": '"1"'}, None),
           (6, "response", 404, "http://a.org/x", 400_001, {"etag": '"9"'}, None),
           (7, "revisit", 304, None, 7, None, None), (8, "revisit", 304, "http://a.org/x", None, None, None)]
    r = spark.createDataFrame(rec, "record_id long, kind string, status int, url string, ts long, headers map<string,string>, body string")
    got = {x.record_id: x for x in revisits.resolve_revisits(r).collect()}
    assert {i: (x.response_id, x.state) for i, x in got.items()} == {
        2: (1, "resolved"), 3: (None, "orphan"), 5: (4, "unverified"), 7: (None, "orphan"), 8: (None, "orphan")}
    assert got[2].headers == {"etag": 'W/"1"', "server": "s", "date": "d"}
    assert [x.body for x in revisits.with_payloads(revisits.resolve_revisits(r), r).collect()] == ["b1"]
    assert revisits.resolve_revisits(r.limit(0)).count() == 0


def test_licences(spark):
    f = spark.createDataFrame([
        ("/a/LICENSE", "Released under the MIT License."), ("/a/b/x.py", "code\nLicensed under CC BY-NC 4.0.\ncode"),
        ("/a/b/y.py", "code"), ("/c/z.py", "no licence here at all"), ("/c/n.py", None), (None, "Released under the MIT License."), ("/a/b/y.py", "code")],
        "path string, text string")
    got = Counter((r.path, r.licence, r.origin, r.declared_in) for r in licences.scan_licences(f).collect())
    assert got == Counter({("/a/LICENSE", "MIT", "own", None): 1, ("/a/b/x.py", "CC-BY-NC-4.0", "own", None): 1,
                           ("/a/b/y.py", "MIT", "inherited", "/a"): 2, ("/c/z.py", None, "none", None): 1,
                           ("/c/n.py", None, "none", None): 1, (None, None, "none", None): 1})
    assert licences.scan_licences(f.limit(0)).count() == 0


def test_a_notice_beside_ordinary_words_weighs_alike_at_any_size(spark):
    lines = ["This project is released under the MIT License.",
             "All of the code of this project is licensed under the Apache License, Version 2.0."]
    def cosines(times):
        files = [(f"/{n}/{i}.py", "all of the code of this project is here") for n in range(times) for i in range(200)]
        files += [(f"/{n}/own{i}.py", line) for n in range(times) for i, line in enumerate(lines)]
        frame = spark.createDataFrame(files, "path string, text string")
        return {r.path: (r.licence, r.cosine) for r in licences.licence_matches(frame).where("path LIKE '/0/own%'").collect()}
    one, many = cosines(1), cosines(30)
    assert {p: x for p, (x, _) in many.items()} == {"/0/own0.py": "MIT", "/0/own1.py": "Apache-2.0"}
    for p, (licence, cosine) in one.items():
        assert many[p][0] == licence and many[p][1] == pytest.approx(cosine, abs=0.03)


def test_line_dedup_of_a_repeated_id_keeps_one(spark):
    """Rows of one id with similar lines of one number: one of them stays, in any order of the rows."""
    words = [f"w{i}" for i in range(12)]
    lines = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join([*words[:-1], "third"])]
    for rows in ([(5, x) for x in lines], [(5, x) for x in lines[::-1]], [(5, lines[0]), (5, lines[1]), (9, lines[2])]):
        out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least=1)
        left = [(r.doc_id, r.text) for r in out.collect()]
        assert len(left) == len(rows) and sum(t != "" for _, t in left) == 1 and all(t == "" for i, t in left if i == 9)


def test_emptied_rows_go_only_if_they_lost_lines(spark):
    rows = [(1, "one two three"), (2, "one two three\n"), (3, ""), (4, None), (5, " \n"), (6, "one two three\nfour five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.dedup_lines(docs, drop_emptied=True, least=1).collect()} == {1, 3, 4, 5, 6}
    assert line_dedup.dedup_lines(docs, least=1).count() == 6


def test_counts_of_a_long_text_in_blocks():
    rnd = np.random.default_rng(5)
    m = hmm.Model.of(rnd.random(hmm.N_COUNTS) * 5)
    for n in (1, 2, 7, 64, 65, 200):
        seq = rnd.integers(0, hmm.CLASSES, n).astype(np.uint16)
        whole = hmm.expected_counts(m, [seq])
        for block in (1, 3, 64, 1000):
            assert np.allclose(hmm.long_counts(m, seq, block), whole, rtol=1e-9, atol=1e-12)


def test_expected_counts_by_enumeration():
    import itertools
    rnd = np.random.default_rng(7)
    m = hmm.Model.of(rnd.random(hmm.N_COUNTS) * 3)
    seq = np.array([4, 9, 4], dtype=np.uint16)
    paths = list(itertools.product(range(hmm.STATES), repeat=3))
    p = np.array([m.start[z[0]] * m.emit[seq[0], z[0]] * m.move[z[0], z[1]] * m.emit[seq[1], z[1]] * m.move[z[1], z[2]] * m.emit[seq[2], z[2]] for z in paths])
    p /= p.sum()
    want = np.zeros(hmm.N_COUNTS)
    moves, emit = np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.CLASSES, hmm.STATES))
    for w, z in zip(p, paths):
        want[z[0]] += w
        moves[z[0], z[1]] += w
        moves[z[1], z[2]] += w
        for o, s in zip(seq, z):
            emit[o, s] += w
    want[hmm.STATES:] = np.concatenate((moves.ravel(), emit.ravel()))
    assert np.allclose(hmm.expected_counts(m, [seq]), want)


def test_groups_are_bounded_and_whole():
    import zlib
    seqs = [np.arange(n, dtype=np.uint16) for n in (5, 900, 1, 30, 30, 200, 0)]
    packed = [zlib.compress(s.tobytes()) for s in seqs]
    groups = list(hmm._groups(packed, [len(s) for s in seqs], limit=100))
    assert sorted(i for rows, _ in groups for i in rows) == list(range(len(seqs)))
    for rows, got in groups:
        assert sum(map(len, got)) <= 100 or len(got) == 1
        assert all(np.array_equal(seqs[i], g) for i, g in zip(rows, got))


def test_pipeline_draws_no_blank_documents(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert out and all(split(r.text) for r in out) and all(r.copies > 0 and r.tokens == len(r.text.split()) for r in out)
