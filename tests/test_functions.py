"""Golden rows for scalar functions."""

from pyspark.sql import functions as F

from reviewlake.functions.feedback import history_section, state_label
from reviewlake.functions.template import fill_template
from reviewlake.functions.text import (clamp_max_tokens, estimate_tokens, file_extension, js_length,
                                       js_trim, matches_ignore, or_default, parse_ignore_list,
                                       parse_int_prefix, preview, render_review_html)
from reviewlake.operators.files import filter_ignored_files, is_ignored
from reviewlake.operators.visits import is_pr_page, parse_pr_url


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("x")).first()["x"]


def test_file_extension(spark):
    df = spark.createDataFrame([("Makefile",), ("a/b.c/Makefile",), ("foo.",), (".gitignore",),
                                ("x/y.tar.gz",)], "name string")
    got = [r[0] for r in df.select(file_extension("name")).collect()]
    assert got == ["Makefile", "c/Makefile", "", "gitignore", "gz"]


def test_ignore_patterns(spark):
    cases = [("a/b.js", "*.js", True), ("a/b.js", "b.js", False), ("src/x.js", "src/*.js", False),
             ("src/*.js", "src/*.js", True), ("anything", "*", False), ("*", "*", True),
             ("a.min.js", "*.min.js", True), ("amin.js", "*.min.js", False)]
    df = spark.createDataFrame(cases, "name string, pat string, want boolean")
    for name, pat, want, got in df.select("*", matches_ignore("name", "pat")).collect():
        assert got == want, (name, pat)
    files = spark.createDataFrame([("a.js",), ("b.py",)], "name string")
    assert filter_ignored_files(files, []).count() == 2
    assert [r[0] for r in filter_ignored_files(files, ["*.js"]).collect()] == ["b.py"]
    nulls = spark.createDataFrame([("a.js", None)], "name string, pats array<string>")
    assert nulls.select(is_ignored("name", F.col("pats"))).first()[0] is False


def test_or_default_and_trim(spark):
    df = spark.createDataFrame([(None,), ("",), ("x",)], "v string")
    assert [r[0] for r in df.select(or_default("v", "d")).collect()] == ["d", "d", "x"]
    assert one(spark, js_trim(F.col("s")), s="  \t x y \r\n　") == "x y"


def test_template_modes(spark):
    vals = dict(files="F", diff="D", language="L", reviews="R")

    def fill(tpl, mode, **over):
        v = {**vals, **over}
        df = spark.createDataFrame([(tpl, v["files"], v["diff"], v["language"], v["reviews"])],
                                   "t string, f string, d string, l string, r string")
        return df.select(fill_template("t", "f", "d", "l", "r", mode=mode)).first()[0]

    for mode in ("safe", "sequential"):
        assert fill("no placeholders", mode) == "no placeholders"
        assert fill("{files}|{diff}|{language}|{reviews}", mode) == "F|D|L|R"
        assert fill("{files} and {files}", mode) == "F and {files}"
        assert fill("", mode) == ""
    # patterns of a value: kept in safe mode, expanded as by the original's string replacement in sequential mode
    assert fill("{diff}", "safe", diff="$& $1 \\ $$") == "$& $1 \\ $$"
    assert fill("a{diff}b", "sequential", diff="$& $1 \\ $$ $` $' $$& $") == "a{diff} $1 \\ $ a b $& $b"
    assert fill("{files}{diff}", "sequential", files="$'", diff="x") == "x{diff}"
    assert fill("{diff}", "sequential", diff="$") == "$"
    # a value holding a later placeholder: safe keeps it literal, sequential swallows it
    assert fill("{files} {diff}", "safe", files="has {diff}") == "has {diff} D"
    assert fill("{files} {diff}", "sequential", files="has {diff}") == "has D {diff}"


def test_history_and_labels(spark):
    assert one(spark, history_section(F.col("t")), t="") == ""
    assert one(spark, history_section(F.col("t")), t="x") == "\n\n=== 历史评论记录 ===\nx"
    assert one(spark, state_label(F.col("s")), s="APPROVED") == "批准了PR"
    assert one(spark, state_label(F.col("s")), s="PENDING") == "PENDING"


def test_tokens_and_lengths(spark):
    texts = ["", "a", "ab", "abcdef", "abcdefghij", "😀", "a😀b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(js_length("t"), estimate_tokens("t")).collect()
    lens = [len(t.encode("utf-16-le")) // 2 for t in texts]
    assert [r[0] for r in got] == lens
    assert [r[1] for r in got] == [int(n / 4 + 0.5) for n in lens]


def test_review_html(spark):
    cases = {
        "a\nb": "a<br>b",
        "``````": "``````",
        "```py\nx=1\n```": "<pre><code>py<br>x=1<br></code></pre>",
        "use `x` and <b>": "use <code>x</code> and <b>",
        "open ` tick": "open ` tick",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = dict(df.select("t", render_review_html("t")).collect())
    assert got == cases
    esc = df.select(render_review_html("t", escape=True)).collect()
    assert "&lt;b&gt;" in [r[0] for r in esc][3]


def test_settings_parsers(spark):
    df = spark.createDataFrame([("12abc",), ("  42",), ("x",), ("99999",), ("50",), (None,),
                                ("-7",), ("123456789012345678901",)], "s string")
    parsed = [r[0] for r in df.select(parse_int_prefix("s")).collect()]
    assert parsed == [12, 42, None, 99999, 50, None, -7, float("123456789012345678901")]
    clamped = [r[0] for r in df.select(clamp_max_tokens(parse_int_prefix("s"))).collect()]
    assert clamped == [100, 100, None, 4000, 100, None, 100, 4000]
    lst = one(spark, parse_ignore_list(F.col("t")), t="*.test.js\n *.min.js \r\n\n\tpackage-lock.json")
    assert lst == ["*.test.js", "*.min.js", "package-lock.json"]


def test_preview(spark):
    assert one(spark, preview(F.col("t"), 3), t="abcdef") == "abc..."
    assert one(spark, preview(F.col("t"), 3), t="ab") == "ab..."


def test_urls(spark):
    urls = [("https://github.com/o/r/pull/5", True, "o", "r", "5"),
            ("https://github.com/o/r/pull/5/files?x=1", True, "o", "r", "5"),
            ("https://github.com", False, None, None, None),
            ("https://github.com/o", False, "o", None, None),
            ("not a url at all", False, None, None, None),
            ("https://github.com/pull/x/y/z", True, "pull", "x", "z"),
            ("https://example.com/a/b/pull/9", False, "a", "b", "9")]
    df = spark.createDataFrame([(u[0],) for u in urls], "url string")
    got = parse_pr_url(df.withColumn("pr", is_pr_page("url"))).select(
        "url", "pr", "owner", "repo", "pr_number").collect()
    for want, g in zip(urls, got):
        assert tuple(g) == want


def test_template_parts_are_worked_out_once(spark, capsys):
    """The template is matched and the values are built once a row, not for each of its pieces."""
    schema = "t string, f string, d string, l string, r string"
    df = spark.createDataFrame([(None, "F", "D", "L", "R"), ("", "F", "D", "L", "R"), ("{diff}{files}{diff}x{language}", "{diff}", None, "L", "R")], schema)
    values = ["f", "d", "l", F.upper(F.reverse("r"))]
    for mode, last in (("safe", "{diff}{diff}xL"), ("sequential", None)):
        out = df.select(fill_template("t", *values, mode=mode).alias("p"))
        assert [r.p for r in out.collect()] == [None, "", last]
        capsys.readouterr()
        out.explain()
        plan = capsys.readouterr().out
        assert plan.count("upper(") == 1
        if mode == "safe":
            assert plan.count("regexp_extract_all(") == 1 and plan.count("split(") == 1
