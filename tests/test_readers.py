"""Landed documents: good rows and quarantined documents are all that landed."""

import datetime as dt
import json
import os

import pytest

from reviewlake import registry as R
from reviewlake.session import TASK_BYTES, scratch_path, sized_shuffles
from reviewlake.sources import landing, readers

KEY = {"owner": "o", "repo": "r"}


def land(spark, lines):
    path = scratch_path(spark, "landed")
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(2).write.text(path)
    return path


def doc(n, **more):
    return json.dumps({**KEY, "pr_number": n, **more})


@pytest.mark.parametrize("export, reader, item", [
    ("changed_files", readers.read_changed_files, {"filename": "a.py", "status": "added", "additions": 1, "deletions": 2}),
    ("reviews", readers.read_reviews, {"user": {"login": "u"}, "state": "APPROVED", "body": "x", "submitted_at": "bad time"}),
    ("review_comments", readers.read_review_comments, {"user": None, "body": "x", "path": "a", "line": 3}),
    ("issue_comments", readers.read_issue_comments, {"body": "x"}),
])
def test_list_exports(spark, export, reader, item):
    lines = [doc(1, items=[item, item]), doc(2, items=[]), doc(3, items=[item])[:-9], "not json", "", doc(4, items="text"),
             json.dumps({"owner": "o", "repo": "r", "items": [item]}), doc(5, items=[item], extra={"a": 1}), '"a text"', "[1"]
    path = land(spark, lines)
    good = reader(spark, path).collect()
    assert sorted((r.pr_number, r.pos) for r in good) == [(1, 0), (1, 1), (5, 0)]
    bad = {r.document: (r.error_code, r.export) for r in readers.read_quarantine(spark, path, export).collect()}
    assert bad == {lines[i]: (code, export) for i, code in ((2, "CORRUPT_DOCUMENT"), (3, "CORRUPT_DOCUMENT"), (5, "CORRUPT_DOCUMENT"),
                                                            (6, "NO_KEY"), (8, "CORRUPT_DOCUMENT"), (9, "CORRUPT_DOCUMENT"))}
    # with the document that holds no items, every document that is not blank is accounted for
    assert len({r.pr_number for r in good}) + len(bad) + 1 == sum(1 for x in lines if x)


def test_pull_requests_and_settings(spark):
    pr = {**KEY, "pr_number": 1, "title": "t", "base": {"ref": "main"}, "user": {"login": "u"}, "commits": 2}
    lines = [json.dumps(pr), json.dumps(pr | {"pr_number": None}), json.dumps(pr)[:30]]
    path = land(spark, lines)
    assert [(r.pr_number, r.base_ref, r.head_ref) for r in readers.read_pull_requests(spark, path).collect()] == [(1, "main", None)]
    assert sorted(r.error_code for r in readers.read_quarantine(spark, path, "pull_requests").collect()) == ["CORRUPT_DOCUMENT", "NO_KEY"]
    stored = {"tenant": "t1", "githubToken": "secret", "aiService": "openai", "reviewSettings": {"maxTokens": 7, "ignoreFiles": ["*.a"]}}
    path = land(spark, [json.dumps(stored), json.dumps(stored)[:-2], json.dumps({"aiService": "openai"})])
    assert [(r.tenant, r.has_token, r.max_tokens, r.ignore_files) for r in readers.read_settings(spark, path).collect()] == [("t1", True, 7, ["*.a"])]
    assert readers.read_quarantine(spark, path, "settings").count() == 2


def test_parquet_exports(spark):
    path = scratch_path(spark, "landed")
    schema, _ = readers.EXPORTS["issue_comments"]
    rows = [("o", "r", 1, [(("u",), "x", None)]), ("o", None, 2, [])]
    spark.createDataFrame(rows, schema).write.parquet(path)
    assert readers.read_issue_comments(spark, path, "parquet").count() == 1
    assert [r.error_code for r in readers.read_quarantine(spark, path, "issue_comments", "parquet").collect()] == ["NO_KEY"]


def small_tables(spark, folder):
    """Three orders, one of them twice and one without lines, and one event on each."""
    day = dt.datetime(2024, 1, 1)
    tables = {
        "customer": ("c_custkey long, c_nationkey long, c_mktsegment string", [(1, 2, "BUILDING")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderpriority string", [(n, 1, "1-URGENT") for n in (1, 1, 2, 3)]),
        "part": ("p_partkey long, p_name string", [(1, "blue ink")]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_returnflag string, l_shipdate timestamp",
                     [(n, 1, 1, i, 1.0, 2.0, 0.1, "A", day) for n in (1, 2) for i in (1, 2)]),
        "events": ("event_id long, user_id long, event_type string, ts timestamp", [(n, n, "click", day) for n in (1, 2, 3)]),
    }
    for name, (schema, table) in tables.items():
        spark.createDataFrame(table, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_an_export_is_landed_alone_and_once(spark, tmp_path):
    sf = small_tables(spark, tmp_path)
    path = landing.land_api_exports(spark, sf, ["pull_requests"])["pull_requests"]
    base = os.path.dirname(path).removeprefix("file:")
    assert os.listdir(base) == ["pull_requests"]
    assert R.s1_read_pull_requests(spark, sf).count() == 4
    assert landing.land_api_exports(spark, sf, ["pull_requests"])["pull_requests"] == path
    # both copies of the repeated order hold both copies of its files
    assert R.s2_read_changed_files(spark, sf).count() == 6
    assert os.listdir(base) == ["pull_requests"]
    assert sorted(landing.land_api_exports(spark, sf)) == sorted(landing.EXPORT_NAMES)


def test_written_documents_are_compressed(spark, tmp_path):
    sf = small_tables(spark, tmp_path)
    path = landing.land_api_exports(spark, sf, ["changed_files"])["changed_files"]
    cut = landing.land_cut_off(spark, path, "pr_number")
    for folder in (path, cut):
        parts = [f for f in os.listdir(folder.removeprefix("file:")) if f.startswith("part-")]
        assert parts and all(f.endswith(".gz") for f in parts)
    assert readers.read_changed_files(spark, cut).count() == readers.read_changed_files(spark, path).count() == 6


def test_shuffle_partitions_grow_with_the_rows(spark):
    names = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = [spark.conf.get(n) for n in names]
    with sized_shuffles(spark, 100_000_001):
        assert [spark.conf.get(n) for n in names] == ["401", TASK_BYTES]
    with pytest.raises(KeyError), sized_shuffles(spark, 0):
        assert spark.conf.get(names[0]) == before[0]
        raise KeyError
    assert [spark.conf.get(n) for n in names] == before
