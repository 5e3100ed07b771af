"""DuckDB SQL fragments for the oracle side of the correctness check.

Written from the semantics in the survey, independent of the Spark plan;
text labels come from the shared fixed values so both sides print the
same words.
"""

from __future__ import annotations

from reviewlake import constants as C


def q(s: str) -> str:
    """SQL string literal (newlines kept, quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"


NL = "chr(10)"

FILE_LINE = ("filename || ' (' || status || ': +' || CAST(additions AS VARCHAR) || ' -' "
             "|| CAST(deletions AS VARCHAR) || ')'")
DIFF_BLOCK = f"{q(C.DIFF_HEADER_OPEN)} || filename || {q(C.DIFF_HEADER_CLOSE)} || coalesce(patch, '')"
EXTENSION = "string_split(filename, '.')[-1]"

STATE_LABEL = ("CASE state " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in C.STATE_LABELS.items())
               + " ELSE state END")
KIND_RANK = ("CASE type WHEN 'review_decision' THEN 0 WHEN 'review_comment' THEN 1 "
             "ELSE 2 END")


def render(mode: str = "all") -> str:
    """F6 over columns type, author, state, c (content), file, line."""
    has_line = "line IS NOT NULL" if mode == "all" else "(line IS NOT NULL AND line <> 0)"
    return (
        "CASE type WHEN 'review_decision' THEN author || ' ' || coalesce(" + STATE_LABEL + ", '')"
        f" || CASE WHEN c <> '' THEN {q(C.CONTENT_SEPARATOR)} || c ELSE '' END"
        f" WHEN 'review_comment' THEN CASE WHEN {has_line} THEN author || {q(C.LINE_COMMENT_IN_FILE)}"
        f" || file || {q(C.LINE_COMMENT_LINE)} || CAST(line AS VARCHAR) || {q(C.LINE_COMMENT_SUFFIX)} || c"
        f" ELSE author || {q(C.LINE_COMMENT_IN_FILE)} || file || {q(C.FILE_COMMENT_SUFFIX)} || c END"
        f" ELSE author || {q(C.ISSUE_COMMENT_SUFFIX)} || c END")


def unified_feedback(mode: str = "all") -> str:
    """Feedback rows after P3 / P4 as SQL over the derived ``feedback`` table."""
    if mode == "all":
        return (f"SELECT pr_number, pos, type, {KIND_RANK} AS kind_rank, author, state, "
                "coalesce(content, '') AS c, CASE WHEN type = 'review_comment' THEN file END AS file, "
                "CASE WHEN type = 'review_comment' THEN line END AS line, submitted_at FROM feedback")
    t = "regexp_replace(coalesce(content, ''), '^\\s+|\\s+$', '', 'g')"
    return (f"SELECT pr_number, pos, type, {KIND_RANK} AS kind_rank, author, state, {t} AS c, "
            "CASE WHEN type = 'review_comment' THEN file END AS file, "
            "CASE WHEN type = 'review_comment' THEN coalesce(nullif(line, 0), pos % 50) END AS line, "
            "submitted_at FROM feedback "
            f"WHERE CASE WHEN type = 'review_decision' THEN state IS DISTINCT FROM 'COMMENTED' OR {t} <> '' "
            f"ELSE {t} <> '' END")


def timeline(mode: str = "all") -> str:
    return (f"SELECT pr_number, string_agg({render(mode)}, {NL} || {NL} ORDER BY submitted_at IS NULL, "
            f"submitted_at, kind_rank, pos) AS timeline, count(*) AS feedback_count "
            f"FROM ({unified_feedback(mode)}) GROUP BY pr_number")


def file_texts(src: str, keys: str = "pr_number") -> str:
    """A1 + A2 + A3 + count over a files relation with ``filename`` etc."""
    return (
        f"SELECT {keys}, string_agg({FILE_LINE}, {NL} ORDER BY pos) AS files_list, "
        f"string_agg({DIFF_BLOCK}, {NL} || {NL} ORDER BY pos) AS diffs, "
        f"coalesce(string_agg(ext, ', ' ORDER BY first_pos) FILTER (WHERE ext <> '' AND is_first), '') AS languages, "
        f"count(*) AS file_count FROM ("
        f"SELECT *, min(pos) OVER (PARTITION BY {keys}, ext) AS first_pos, "
        f"pos = min(pos) OVER (PARTITION BY {keys}, ext) AS is_first "
        f"FROM (SELECT *, {EXTENSION} AS ext FROM {src})) GROUP BY {keys}")


def ignored(patterns_sql: str) -> str:
    """P7 test for ``filename`` against a list expression."""
    return ("coalesce(list_bool_or(list_transform(" + patterns_sql + ", lambda p: CASE WHEN "
            "starts_with(p, '*.') THEN suffix(filename, substr(p, 2)) ELSE filename = p END)), false)")


def history(text_sql: str) -> str:
    return f"CASE WHEN coalesce({text_sql}, '') = '' THEN '' ELSE {q(C.HISTORY_HEADER)} || {text_sql} END"


def replace_first(s: str, token: str, value: str) -> str:
    pos = f"strpos({s}, {q(token)})"
    return (f"CASE WHEN {pos} > 0 THEN substr({s}, 1, {pos} - 1) || {value} || "
            f"substr({s}, {pos} + {len(token)}) ELSE {s} END")


def js_length(s: str) -> str:
    """UTF-16 length: code points plus one per character above U+FFFF."""
    return (f"CAST(length({s}) + length(regexp_replace({s}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) "
            "AS BIGINT)")


def settings_flat() -> str:
    d = C.FORM_DEFAULTS
    return (
        "SELECT tenant, has_token, has_key AS has_openai_key, has_key AS has_anthropic_key, ai_service, "
        f"{q(d['openai']['apiEndpoint'])} AS openai_endpoint, "
        f"coalesce(nullif(CASE WHEN ai_service = 'openai' THEN model END, ''), {q(d['openai']['model'])}) AS openai_model, "
        "coalesce(CASE WHEN ai_service = 'anthropic' THEN model END, '') AS anthropic_model, "
        f"{q(C.INSTALL_DEFAULTS['review']['reviewPrompt'])} AS review_prompt, "
        f"CAST(CASE WHEN mt IS NULL THEN NULL ELSE greatest({C.MAX_TOKENS_MIN}, least({C.MAX_TOKENS_MAX}, mt)) END AS INTEGER) AS max_tokens, "
        "list_filter(list_transform(string_split(coalesce(ignore_files, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ignore_files "
        "FROM (SELECT *, try_cast(regexp_extract(max_tokens, '^\\s*([+-]?\\d+)', 1) AS BIGINT) AS mt FROM settings_raw)")
