"""Feedback rendering functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake import constants as C
from reviewlake.functions.text import col


def _label_map() -> Column:
    items = []
    for k, v in C.STATE_LABELS.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def state_label(state) -> Column:
    """decision state to its label; an unknown state is kept as is."""
    s = col(state)
    return F.coalesce(F.element_at(_label_map(), s), s, F.lit(""))


def render_feedback(type_, author, state, content, file, line, mode: str = "all") -> Column:
    """one feedback row as text.

    ``mode='all'`` prints any non-null line number (0 included); ``'non_empty'``
    treats 0 like a missing line. A null line gives the in-file form.
    """
    t, a, c, f, ln = col(type_), col(author), col(content), col(file), col(line)
    has_line = ln.isNotNull() if mode == "all" else (ln.isNotNull() & (ln != 0))
    decision = F.concat(
        a, F.lit(" "), state_label(state),
        F.when(c != "", F.concat(F.lit(C.CONTENT_SEPARATOR), c)).otherwise(F.lit("")))
    line_comment = F.when(
        has_line,
        F.concat(a, F.lit(C.LINE_COMMENT_IN_FILE), f, F.lit(C.LINE_COMMENT_LINE),
                 ln.cast("string"), F.lit(C.LINE_COMMENT_SUFFIX), c),
    ).otherwise(F.concat(a, F.lit(C.LINE_COMMENT_IN_FILE), f, F.lit(C.FILE_COMMENT_SUFFIX), c))
    issue = F.concat(a, F.lit(C.ISSUE_COMMENT_SUFFIX), c)
    return (F.when(t == "review_decision", decision)
            .when(t == "review_comment", line_comment)
            .when(t == "issue_comment", issue))


def history_section(text) -> Column:
    """the history block appended to the prompt, or nothing for empty text."""
    x = col(text)
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit("")).otherwise(
        F.concat(F.lit(C.HISTORY_HEADER), x))
