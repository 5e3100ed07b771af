"""Periodic runs and the Merkle manifest against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import merkle, periodic_runs, registry, text

DOC = "doc_id long, text string, source string, lang string, n_chars long, runs string, hash string"
WORD = r"[^\x20\x09-\x0D]+"


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and j > i:
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(rnd):
    w = [rnd.randrange(rnd.choice([1, 2, 3, 50])) for _ in range(rnd.randrange(0, 160))]
    for _ in range(rnd.randrange(0, 4)):
        part = [rnd.randrange(rnd.choice([2, 4, 100])) for _ in range(rnd.randrange(1, 30))]
        at = rnd.randrange(len(w) + 1)
        w[at:at] = part * rnd.randrange(1, 9) + part[:rnd.randrange(len(part))]
    return w


def test_runs_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(400):
        w = repetitive(rnd)
        h = text.mix64(np.array(w, dtype=np.uint64) + np.uint64(9))
        got = [(a + s, n, q) for a, b in periodic_runs.stretches(h) for s, n, q in periodic_runs.runs_of(h[a:b])]
        assert sorted(got, key=lambda r: (r[0], r[2])) == brute_runs(w)


def test_grammar_gives_the_words_back():
    rnd = random.Random(6)
    for _ in range(50):
        w = repetitive(rnd)
        if not w:
            continue
        names, symbols = np.unique(w, return_inverse=True)
        g = periodic_runs.Grammar(symbols, len(names))
        out, todo = [], [g.root]
        while todo:
            x = todo.pop()
            if x < g.words:
                out.append(int(names[x]))
            else:
                todo += reversed(g.halves[x - g.words])
        assert out == w


def texts():
    rnd = random.Random(8)
    out = [" ".join(f"W{x}é" for x in repetitive(rnd)) for _ in range(60)]
    out += [None, "", " \t\n", "one", "aa " * 24, "aa " * 23, "Aa aa " * 20, "x\ty\nz\r" * 30, "a" * 100000,
            " ".join(f"v{i % 700}" for i in range(9000)), "z z " * 30]
    return out


def documents(spark):
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, "en", len(t or ""), "x", "y") for i, t in enumerate(texts())]
    rows += [rows[2], rows[2], (None, "aa " * 40, "s1", None, None, "x", "y"), (None, None, None, None, None, None, None)]
    return rows, spark.createDataFrame(rows, DOC).repartition(4)


def looped(doc_id, t):
    w = re.findall(WORD, t or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def run_row(doc_id, w):
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)),
            sha(brute_collapsed(w, runs)))


def test_operator_on_odd_texts(spark):
    rows, docs = documents(spark)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed)
                  for r in periodic_runs.periodic_runs(docs).collect()), key=repr)
    want = []
    for r in rows:
        w = re.findall(WORD, r[1] or "")
        runs = brute_runs(w)
        want.append((r[0] is not None, r[0] or 0, len(w), runs, brute_collapsed(w, runs)))
    assert got == sorted(want, key=repr)
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    rows, docs = documents(spark)
    docs.write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_query_equals_brute_force(spark, folder):
    path, rows = folder
    got = [tuple(r) for r in registry.op13_periodic_runs(spark, path).collect()]
    assert sorted(got, key=repr) == sorted((run_row(r[0], looped(r[0], r[1])) for r in rows), key=repr)


def test_query_on_given_documents(spark):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in registry.op13_periodic_runs(spark, path).collect()]
    assert sorted(got) == sorted(run_row(r.doc_id, looped(r.doc_id, r.text)) for r in rows)
    assert sum(r[1] > 0 for r in got) > 5


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(levels of digests from the leaves to the single top)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha(*x[i:i + 16]) for i in range(0, len(x), 16)])
    return levels


def path_of(levels, at):
    out = []
    for x in levels[:-1]:
        run = x[at // 16 * 16:at // 16 * 16 + 16]
        out.append((run[:at % 16], run[at % 16 + 1:]))
        at //= 16
    return out


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    made = []
    for doc_id, t, source, lang, n, *_ in rows:
        leaf = lambda x: sha(*[field(v) for v in (doc_id, source, lang, n, x)])
        change = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        made.append((source, doc_id, leaf(t), leaf(lower(t)) if change else leaf(t)))
    groups = sorted({m[0] for m in made}, key=lambda s: (s is not None, (s or "").encode()))
    own = {g: sorted((m for m in made if m[0] == g), key=lambda m: (m[1] is not None, m[1] or 0, m[2])) for g in groups}
    trees = {g: tree([m[2] for m in own[g]]) for g in groups}
    top = tree([trees[g][-1][0] for g in groups])
    out = []
    for k, g in enumerate(groups):
        for i, (_, doc_id, leaf, claimed) in enumerate(own[g]):
            steps = path_of(trees[g], i) + path_of(top, k)
            fold = claimed
            for before, after in steps:
                fold = sha(*before, fold, *after)
            proof = sha(*[h for before, after in steps for h in before + after])
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], proof, fold, fold == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sources, n", [(1, 1), (1, 16), (1, 17), (2, 300), (40, 90), (3, 5000)])
def test_manifest_equals_brute_force(spark, tmp_path, sources, n):
    rnd = random.Random(n)
    rows = [(i * 7 % n, f"Text {rnd.random()}" if i % 11 else None, f"s{rnd.randrange(sources)}é" if i % 6 or sources == 1 else None,
             rnd.choice(["en", None]), i, "x", "y") for i in range(n)]
    if sources == 40:
        rows += [rows[3], rows[3], (None, "Null Id", "s1é", "en", 1, "x", "y")]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in registry.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute_manifest(rows)
    if n > 100:
        assert {r[-1] for r in got} == {True, False}


def test_manifest_of_hot_group_splits_its_links(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MEETING", 2)
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("source"))
    leaf = merkle.leaf_digest(F.col("doc_id"))
    out = merkle.manifest(rows, leaf, F.when(F.col("doc_id") == 77, F.sha2(F.lit("no"), 256)).otherwise(leaf), "doc_id", "source")
    got = out.groupBy("verified").agg(F.count("*").alias("n"), F.max("doc_id").alias("m")).collect()
    assert {(r.verified, r.n) for r in got} == {(True, 2999), (False, 1)}
    assert [r.m for r in got if not r.verified] == [77]


def test_manifest_of_empty_table(spark):
    rows = spark.createDataFrame([], DOC)
    leaf = merkle.leaf_digest(F.col("text"))
    out = merkle.manifest(rows, leaf, leaf, "doc_id", "source")
    assert out.collect() == [] and out.columns == ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    assert spark.conf.get(merkle.ROW_LIMIT) != "-1"
