"""Scalar text and number functions, all built-in Spark expressions.

Each takes and returns ``Column`` objects so it stays inside whole-stage
codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake import constants as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_default(x, default) -> Column:
    """JavaScript ``x || d`` on strings: null **and** empty give ``d``."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(col(x), F.lit("")), d)


def js_trim(x) -> Column:
    """``String.prototype.trim``: strips the JavaScript whitespace set at both ends."""
    return F.trim(col(x), F.lit(C.JS_WHITESPACE))


def js_length(x) -> Column:
    """String length in UTF-16 code units (what ``.length`` counts)."""
    return (F.octet_length(F.encode(col(x), "UTF-16BE")) / 2).cast("bigint")


def file_extension(name) -> Column:
    """text after the last ``.`` of the full path; the whole path if no dot."""
    return F.substring_index(col(name), ".", -1)


def matches_ignore(name, pattern) -> Column:
    """``*.x`` is a suffix test on ``.x``; anything else is exact equality."""
    n, p = col(name), col(pattern)
    return F.when(p.startswith("*."), n.endswith(F.substr(p, F.lit(2)))).otherwise(n == p)


def render_file_line(name, status, additions, deletions) -> Column:
    """``name (status: +a -d)``."""
    return F.concat(col(name), F.lit(" ("), col(status), F.lit(": +"),
                    col(additions).cast("string"), F.lit(" -"),
                    col(deletions).cast("string"), F.lit(")"))


def render_diff_block(name, patch) -> Column:
    """``=== name ===\\n`` followed by the patch, or nothing if the patch is absent."""
    return F.concat(F.lit(C.DIFF_HEADER_OPEN), col(name), F.lit(C.DIFF_HEADER_CLOSE),
                    F.coalesce(col(patch), F.lit("")))


def preview(x, n: int) -> Column:
    """O2: first ``n`` characters followed by ``...`` (always appended)."""
    return F.concat(F.substring(col(x), 1, n), F.lit(C.PREVIEW_SUFFIX))


def estimate_tokens(text) -> Column:
    """``round(len / 4)`` half up, length in UTF-16 units; integer arithmetic."""
    return F.floor((js_length(text) + F.lit(2)) / F.lit(C.CHARS_PER_TOKEN)).cast("bigint")


def render_review_html(text, escape: bool = False) -> Column:
    """newline to ``<br>``, fenced code to ``<pre><code>``, inline code to ``<code>``."""
    t = col(text)
    if escape:
        t = F.regexp_replace(t, "&", "&amp;")
        t = F.regexp_replace(t, "<", "&lt;")
        t = F.regexp_replace(t, ">", "&gt;")
        t = F.regexp_replace(t, '"', "&quot;")
    for pattern, shown in C.HTML_RULES:
        t = F.regexp_replace(t, pattern, shown)
    return t


def parse_ignore_list(text) -> Column:
    """one pattern per line, trimmed, blank lines dropped."""
    parts = F.split(F.coalesce(col(text), F.lit("")), "\n", -1)
    return F.filter(F.transform(parts, js_trim), lambda s: s != F.lit(""))


def parse_int_prefix(s) -> Column:
    """``parseInt(s, 10)``: leading integer after optional whitespace, else null.

    A double, as in the original: whole numbers are exact up to 2^53, longer ones rounded.
    """
    digits = F.regexp_extract(col(s), r"^\s*([+-]?\d+)", 1)
    return F.when(digits != "", digits.cast("double"))


def clamp_max_tokens(v, lo: int = C.MAX_TOKENS_MIN, hi: int = C.MAX_TOKENS_MAX) -> Column:
    """bound to [lo, hi]; null stays null (NaN compares false in the form check)."""
    x = col(v)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x))).cast("int")


def parse_ts(s) -> Column:
    """F16: ISO-8601 text to an instant; malformed gives null."""
    return F.try_to_timestamp(col(s))


def mask_secret(x) -> tuple[Column, Column]:
    """presence flag and length of a secret; never the value itself."""
    c = col(x)
    return (F.coalesce(F.length(c) > 0, F.lit(False)), F.coalesce(F.length(c), F.lit(0)))
