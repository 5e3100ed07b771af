"""F8: fill the review prompt template.

``mode='safe'`` (default) splits the *template* once into literal and token
segments and expands only the first occurrence of each placeholder, so text
inside a value is never re-scanned and values are inserted as they are.
``mode='sequential'`` reproduces the original replace chain: first occurrence of
each placeholder, in order, on the growing string (a value holding a later
placeholder swallows it), and ``$`` patterns of a value are expanded as the
original's string replacement does: ``$$`` is a dollar sign, ``$&`` the
placeholder, ``$``` and ``$'`` what stands before and after it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake import constants as C
from reviewlake.functions.text import col

_TOKEN_RE = r"\{(files|diff|language|reviews)\}"
_DOLLAR_RE = r"\$[$&`']"


def fill_template(template, files, diff, language, reviews, mode: str = "safe") -> Column:
    tpl = col(template)
    vals = [col(files), col(diff), col(language), col(reviews)]
    if mode == "safe":
        return _fill_safe(tpl, vals)
    if mode == "sequential":
        return _fill_sequential(tpl, vals)
    raise ValueError(f"unknown template mode {mode!r}")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, bound once: an expression named inside a lambda is evaluated again for every mention."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bytes_of(text: Column, start: Column, length: Column) -> Column:
    """Part of a text by byte positions (from 1), which needs no walk over its characters."""
    return F.substring(text.cast("binary"), start, length).cast("string")


def _place_of(tok: Column, s: Column) -> Column:
    """Bytes before the first ``tok`` in ``s``; all of its bytes if there is none."""
    return F.octet_length(F.call_function("substring_index", s, tok, F.lit(1)))


def _fill_safe(tpl: Column, vals: list[Column]) -> Column:
    # The template's parts and the values are bound once, as the one element of an array: an
    # expression named inside a lambda is evaluated again for every element and every mention.
    parts = F.struct(F.split(tpl, _TOKEN_RE, -1).alias("lits"), F.regexp_extract_all(tpl, F.lit(_TOKEN_RE), 0).alias("toks"),
                     *[v.alias(f"v{i}") for i, v in enumerate(vals)])

    def value_of(b: Column, tok: Column) -> Column:
        out = None
        for i, name in enumerate(C.PLACEHOLDERS):
            out = (F.when(tok == name, b[f"v{i}"]) if out is None else out.when(tok == name, b[f"v{i}"]))
        return out.otherwise(tok)

    def filled(b: Column) -> Column:
        shown = F.transform(b["toks"], lambda tok, i: F.when(F.array_position(b["toks"], tok) == i + 1, value_of(b, tok)).otherwise(tok))
        return F.array_join(F.zip_with(b["lits"], shown, lambda lit, text: F.concat(lit, F.coalesce(text, F.lit("")))), "")

    return F.element_at(F.transform(F.array(parts), filled), 1)


def _fill_sequential(tpl: Column, vals: list[Column]) -> Column:
    steps = F.array(*[F.struct(F.lit(t).alias("tok"), v.alias("value")) for t, v in zip(C.PLACEHOLDERS, vals)])
    # A fold over the four placeholders: accumulator, placeholder and value are lambda
    # variables, so each step refers to them instead of copying the tree.
    return F.aggregate(steps, tpl, lambda acc, step: _replace_first(acc, step["tok"], step["value"]))


def _replace_first(s: Column, tok: Column, value: Column) -> Column:
    def replaced(b: Column) -> Column:
        size = F.octet_length(b["s"])
        before, after = _bytes_of(b["s"], F.lit(1), b["at"]), _bytes_of(b["s"], b["at"] + F.octet_length(b["tok"]) + 1, size)
        shown = F.when(F.contains(b["value"], F.lit("$")), _expanded(b["value"], b["tok"], before, after)).otherwise(b["value"])
        return F.when(b["at"] < size, F.concat(before, shown, after)).otherwise(b["s"])

    return _let(F.struct(s.alias("s"), tok.alias("tok"), value.alias("value"), _place_of(tok, s).alias("at")), replaced)


def _expanded(value: Column, tok: Column, before: Column, after: Column) -> Column:
    """``value`` with its ``$`` patterns replaced, from left to right."""
    lits = F.split(value, _DOLLAR_RE, -1)
    marks = F.regexp_extract_all(value, F.lit(_DOLLAR_RE), 0)
    meant = lambda m: (F.when(m == "$$", F.lit("$")).when(m == "$&", tok).when(m == "$`", before)
                       .when(m == "$'", after).otherwise(F.lit("")))
    return F.array_join(F.zip_with(lits, marks, lambda t, m: F.concat(t, F.coalesce(meant(m), F.lit("")))), "")
