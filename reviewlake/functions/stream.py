"""Stream line functions: P9 P10 F17 F18 and the T3 validity test.

A data line is parsed once, into a variant (``line_variant``); its kind and its delta are read off
that. ``with_line_parse`` adds both to a table of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake import constants as C
from reviewlake.functions.text import col, js_trim


def strip_data_prefix(line) -> Column:
    """drop a leading ``data: `` and trim."""
    x = col(line)
    return js_trim(F.when(x.startswith(C.SSE_DATA_PREFIX),
                          F.substr(x, F.lit(len(C.SSE_DATA_PREFIX) + 1))).otherwise(x))


def _wrapped(payload) -> Column:
    """The payload as the only element of an array: text after a value makes it invalid."""
    return F.concat(F.lit("["), payload, F.lit("]"))


def _single(v: Column) -> Column:
    """A parsed wrapper that holds exactly one value (``a,b`` would be two, nothing none)."""
    at = lambda i: F.try_variant_get(v, f"$[{i}]", "variant")
    return at(0).isNotNull() & at(1).isNull()


def is_strict_json(text) -> Column:
    """Exactly one well-formed JSON value (trailing garbage, NaN, quotes rejected)."""
    return F.coalesce(_single(F.try_parse_json(_wrapped(col(text)))), F.lit(False))


def is_skipped(service, line) -> Column:
    """Lines that carry no data: blank, the end mark, other fields, unknown services."""
    x = col(line)
    return (~x.startswith(C.SSE_DATA_PREFIX) | (js_trim(x) == C.SSE_DONE_LINE)
            | ~col(service).isin("openai", "anthropic") | (strip_data_prefix(x) == ""))


def line_variant(service, line) -> Column:
    """The payload of a data line, parsed; null for skipped lines and for what is not JSON."""
    return F.when(~is_skipped(service, line), F.try_parse_json(_wrapped(strip_data_prefix(line))))


def kind_of(service, line, v: Column) -> Column:
    """``skip``, ``malformed`` or ``data``, given the line's variant."""
    at = lambda path: F.try_variant_get(v, path, "variant")
    missing = lambda x: x.isNull() | F.is_variant_null(x)
    bad = ~F.coalesce(_single(v), F.lit(False)) | F.when(
        col(service) == "openai", missing(at("$[0].choices"))).otherwise(F.is_variant_null(at("$[0]")))
    return F.when(is_skipped(service, line), F.lit("skip")).when(bad, F.lit("malformed")).otherwise(F.lit("data"))


def _truthy(v: Column, path: str) -> Column:
    """The value at ``path`` as text, null for the number 0 and ``false``.

    Only a text that looks like one of these is looked at again, to see whether it is quoted.
    """
    got = F.try_variant_get(v, path, "string")
    raw = F.to_json(F.try_variant_get(v, path, "variant"))
    return F.when(got.rlike(r"^(-?0(\.0+)?([eE][+-]?\d+)?|false)$"), F.when(raw.startswith('"'), got)).otherwise(got)


def delta_of(service, v: Column) -> Column:
    """F17 (+P10): delta text given the line's variant; ``''`` when it carries none.

    The number 0 and ``false`` carry none either; the texts ``"0"`` and ``"false"`` do.
    """
    s = col(service)
    a = _truthy(v, "$[0].choices[0].delta.content")
    b = F.when(F.try_variant_get(v, "$[0].type", "string") == C.ANTHROPIC_DELTA_TYPE, _truthy(v, "$[0].delta.text"))
    return F.coalesce(F.when(s == "openai", a).when(s == "anthropic", b), F.lit(""))


def line_kind(service, line) -> Column:
    """The kind of one complete line as one expression."""
    return kind_of(service, line, line_variant(service, line))


def extract_delta(service, line) -> Column:
    """The delta of one complete line as one expression."""
    return delta_of(service, line_variant(service, line))


def with_line_parse(lines: DataFrame, kind: str = "kind", content: str = "content") -> DataFrame:
    """Adds a line's kind and, for data lines, its delta; each line (service, line) is parsed once.

    The variant comes out of a generator of one row, so that a filter on the kind or the delta, which
    Spark moves towards the scan, stops above it instead of parsing every line again. A null
    line has a null kind.
    """
    v = F.col("_v")
    out = lines.withColumn("_v", F.explode(F.array(line_variant("service", "line"))))
    k = F.when(F.col("line").isNotNull(), kind_of("service", "line", v))
    return out.withColumns({kind: k, content: F.when(k == "data", delta_of("service", v))}).drop("_v")
