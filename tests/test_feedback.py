"""Golden rows for feedback projection, ordering and rendering."""

import datetime as dt

from reviewlake.operators.feedback import agg_timeline, union_feedback

T0 = dt.datetime(2024, 1, 1)
T1 = dt.datetime(2024, 1, 2)

REV = "pr_number long, pos int, author string, state string, body string, submitted_at timestamp"
RC = ("pr_number long, pos int, author string, body string, path string, line int, position int, "
      "created_at timestamp")
IC = "pr_number long, pos int, author string, body string, created_at timestamp"


def timeline(spark, reviews, rcs, ics, mode="all"):
    r = spark.createDataFrame(reviews, REV)
    c = spark.createDataFrame(rcs, RC)
    i = spark.createDataFrame(ics, IC)
    fb = union_feedback(r, c, i, ["pr_number"], mode)
    out = agg_timeline(fb, ["pr_number"], mode).collect()
    return {row["pr_number"]: row["timeline"] for row in out}


def test_render_all_kinds_and_order(spark):
    got = timeline(
        spark,
        [(1, 0, "ann", "APPROVED", "fine", T1), (1, 1, None, "WEIRD", None, T0)],
        [(1, 0, "bob", "nit", "a.py", 3, 9, T0), (1, 1, "bob", None, "b.py", None, 2, T0)],
        [(1, 0, "cat", "thanks", T0), (1, 1, "dan", "late", None)])
    # same time: decisions, then line comments, then issue comments; null time last
    assert got[1] == "\n\n".join([
        "ghost WEIRD",
        "bob 在文件 a.py 第 3 行评论:\nnit",
        "bob 在文件 b.py 评论:\n",
        "cat 评论:\nthanks",
        "ann 批准了PR:\nfine",
        "dan 评论:\nlate",
    ])


def test_commented_blank_body_modes(spark):
    rev = [(1, 0, "ann", "COMMENTED", "   ", T0), (1, 1, "bob", "COMMENTED", None, T0)]
    assert timeline(spark, rev, [], [], "all")[1] == "ann 评论了PR:\n   \n\nbob 评论了PR"
    assert timeline(spark, rev, [], [], "non_empty") == {}


def test_line_zero_and_position(spark):
    rc = [(1, 0, "bob", " x ", "a.py", 0, 7, T0), (1, 1, "bob", "y", "a.py", None, None, T0)]
    assert timeline(spark, [], rc, [], "all")[1] == \
        "bob 在文件 a.py 第 0 行评论:\n x \n\nbob 在文件 a.py 评论:\ny"
    assert timeline(spark, [], rc, [], "non_empty")[1] == \
        "bob 在文件 a.py 第 7 行评论:\nx\n\nbob 在文件 a.py 评论:\ny"


def test_missing_inputs_are_empty(spark):
    r = spark.createDataFrame([(1, 0, "ann", "APPROVED", "", T0)], REV)
    fb = union_feedback(r, None, None, ["pr_number"])
    assert fb.count() == 1
    assert union_feedback(None, None, None, ["pr_number"]) is None


def test_order_independent_of_input_order(spark):
    rows = [(1, p, f"u{p}", "APPROVED", f"b{p}", T0 if p % 2 else T1) for p in range(40)]
    a = timeline(spark, rows, [], [])
    b = timeline(spark, list(reversed(rows)), [], [])
    assert a == b
