"""Registered queries (Spark) and their oracle SQL (DuckDB).

Every query reads the driver's tables through the derivations in
``sources.fixtures`` and runs over them whole. Keys follow the survey:
operator id in lower case plus its name.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake import constants as C
from reviewlake import oracle as O
from reviewlake.functions.requests import api_endpoint
from reviewlake.functions.text import estimate_tokens, file_extension, js_length, preview, render_review_html
from reviewlake.operators import details, feedback as fb, files as fl, prompts, requests, results, settings as st
from reviewlake.operators import streams, visits
from reviewlake.session import scratch_path, sized_shuffles
from reviewlake.sinks import writers
from reviewlake.sources import landing, readers
from reviewlake.streaming import assembly
from reviewlake.sources import fixtures as fx

KEYS = ["pr_number"]
FIXED_PATTERNS = ["*.test.js", "*.min.js", "package-lock.json"]


class Tables:
    """Lazy derived tables for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in fx.DERIVED:
            return fx.derived(self.spark, self.sf_dir, name)
        if name in fx.BASE_TABLES:
            return fx.base_table(self.spark, self.sf_dir, name)
        raise AttributeError(name)

    @property
    def files(self) -> DataFrame:
        return fl.project_files(self.changed_files, KEYS)

    def unified_feedback(self, mode: str = "all") -> DataFrame:
        return fb.union_feedback(self.reviews, self.review_comments, self.issue_comments, KEYS, mode)

    @property
    def settings(self) -> DataFrame:
        return st.fixture_settings(self.settings_raw)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- Q2 (flagship)
Q2_COLUMNS = ["request_id", "pr_number", "tenant", "ai_service", "max_tokens", "error_code",
              "file_count", "languages", "prompt", "diff_length", "reviews_length", "total_length"]


def _filled(mode: str) -> list[str]:
    """Oracle CTEs from ``h`` to ``t4``: the prompt ``p4``, in either template mode."""
    values = ["files_list", "diffs", "languages", "history"]
    if mode == "safe":
        # the template's own placeholders become marks before any value is put in
        steps, prev = [f"m0 AS (SELECT *, {O.replace_first('review_prompt', C.PLACEHOLDERS[0], 'chr(1)')} AS m1 FROM h)"], "m0"
        for i, tok in enumerate(C.PLACEHOLDERS[1:], 1):
            steps.append(f"m{i} AS (SELECT *, {O.replace_first(f'm{i}', tok, f'chr({i + 1})')} AS m{i + 1} FROM {prev})")
            prev = f"m{i}"
        filled = f"m{len(values)}"
        for i, v in enumerate(values):
            filled = f"replace({filled}, chr({i + 1}), {v})"
        return [*steps, f"t4 AS (SELECT *, {filled} AS p4 FROM {prev})"]
    steps, prev = [], "h"
    for i, (tok, v) in enumerate(zip(C.PLACEHOLDERS, values)):
        src = "review_prompt" if i == 0 else f"p{i}"
        shown = f"replace(replace(replace({v}, '$$', chr(1)), '$&', {O.q(tok)}), chr(1), '$')"
        steps.append(f"t{i + 1} AS (SELECT *, {O.replace_first(src, tok, shown)} AS p{i + 1} FROM {prev})")
        prev = f"t{i + 1}"
    return steps


def _q2_ctes(mode: str = "safe") -> str:
    """Oracle CTEs ending in ``t4``: one row per run with its filled prompt (``p4``)."""
    steps = _filled(mode)
    body = f"""
, settings AS ({O.settings_flat()}),
rs AS (SELECT r.request_id, r.pr_number, r.tenant, r.run_ts,
         coalesce(nullif(r.temp_ai_service, ''), s.ai_service) AS ai_service,
         coalesce(nullif(r.temp_review_prompt, ''), s.review_prompt) AS review_prompt,
         s.has_token, s.has_openai_key, s.has_anthropic_key, s.max_tokens, s.ignore_files,
         s.openai_endpoint, s.openai_model, s.anthropic_model
       FROM runs r LEFT JOIN settings s ON r.tenant = s.tenant),
rs2 AS (SELECT *, CASE WHEN NOT coalesce(has_token, false) THEN 'NO_FORGE_TOKEN'
          WHEN ai_service = 'openai' AND NOT coalesce(has_openai_key, false) THEN 'NO_OPENAI_KEY'
          WHEN ai_service = 'anthropic' AND NOT coalesce(has_anthropic_key, false) THEN 'NO_ANTHROPIC_KEY'
          END AS err0 FROM rs),
pairs AS (SELECT DISTINCT pr_number, tenant, ignore_files FROM rs2 WHERE err0 IS NULL),
kept AS (SELECT f.*, p.tenant FROM changed_files f JOIN pairs p ON f.pr_number = p.pr_number
         WHERE NOT {O.ignored('p.ignore_files')}),
fa AS ({O.file_texts('kept', 'pr_number, tenant')}),
tl AS ({O.timeline('all')}),
j AS (SELECT rs2.*, fa.files_list, fa.diffs, fa.languages, fa.file_count, tl.timeline,
        coalesce(err0, CASE WHEN coalesce(fa.file_count, 0) = 0 THEN 'NO_FILES' END) AS error_code
      FROM rs2 LEFT JOIN fa ON rs2.pr_number = fa.pr_number AND rs2.tenant = fa.tenant
      LEFT JOIN tl ON rs2.pr_number = tl.pr_number),
h AS (SELECT *, CASE WHEN error_code IS NULL THEN {O.history(f"coalesce(timeline, {O.q(C.NO_FEEDBACK_TEXT)})")} END AS history FROM j),
{", ".join(steps)}
"""
    return fx.derived_cte(["runs", "settings_raw", "changed_files", "feedback"]) + body


def _q2_sql(mode: str = "safe") -> str:
    return _q2_ctes(mode) + f"""
SELECT request_id, pr_number, tenant, ai_service, max_tokens, error_code, file_count, languages,
  CASE WHEN error_code IS NULL THEN p4 END AS prompt,
  {O.js_length('diffs')} AS diff_length, {O.js_length('history')} AS reviews_length,
  {O.js_length('CASE WHEN error_code IS NULL THEN p4 END')} AS total_length
FROM t4
"""


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return prompts.build_review_prompts(t.runs, t.settings, t.files, t.unified_feedback("all"), KEYS)


@register("q2_review_prompts", _q2_sql())
def q2_review_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select(*Q2_COLUMNS)


# ---------------------------------------------------------------- files
@register("a1_files_list", fx.oracle_with(["changed_files"], f"""
SELECT pr_number, string_agg({O.FILE_LINE}, chr(10) ORDER BY pos) AS files_list
FROM changed_files GROUP BY pr_number"""))
def a1_files_list(spark, sf_dir):
    return fl.agg_files_list(Tables(spark, sf_dir).files, KEYS)


@register("a2_diffs", fx.oracle_with(["changed_files"], f"""
SELECT pr_number, string_agg({O.DIFF_BLOCK}, chr(10) || chr(10) ORDER BY pos) AS diffs
FROM changed_files GROUP BY pr_number"""))
def a2_diffs(spark, sf_dir):
    return fl.agg_diffs(Tables(spark, sf_dir).files, KEYS)


@register("a3_languages", fx.oracle_with(["changed_files"], f"""
SELECT pr_number, languages FROM ({O.file_texts('changed_files')})"""))
def a3_languages(spark, sf_dir):
    return fl.agg_languages(Tables(spark, sf_dir).files, KEYS)


@register("a1_a3_file_texts", fx.oracle_with(["changed_files"], O.file_texts("changed_files")))
def a1_a3_file_texts(spark, sf_dir):
    return fl.agg_file_texts(Tables(spark, sf_dir).files, KEYS)


_PAT_SQL = "[" + ", ".join(O.q(p) for p in FIXED_PATTERNS) + "]"


@register("p7_filter_ignored", fx.oracle_with(["changed_files"], f"""
SELECT pr_number, pos, filename AS name FROM changed_files WHERE NOT {O.ignored(_PAT_SQL)}"""))
def p7_filter_ignored(spark, sf_dir):
    return fl.filter_ignored_files(Tables(spark, sf_dir).files, FIXED_PATTERNS).select(
        "pr_number", "pos", "name")


@register("a10_ignore_stats", fx.oracle_with(["changed_files"], f"""
SELECT pr_number, count(*) AS total_files, count(*) FILTER (WHERE NOT {O.ignored(_PAT_SQL)}) AS kept_files,
  count(*) FILTER (WHERE {O.ignored(_PAT_SQL)}) AS ignored_files
FROM changed_files GROUP BY pr_number"""))
def a10_ignore_stats(spark, sf_dir):
    return fl.agg_ignore_stats(Tables(spark, sf_dir).files, KEYS, FIXED_PATTERNS)


@register("j2_anti_join_ignored", fx.oracle_with(["changed_files", "runs", "settings_raw"], f"""
, settings AS ({O.settings_flat()}),
pr_tenant AS (SELECT DISTINCT pr_number, tenant FROM runs)
SELECT f.pr_number, t.tenant, f.pos, f.filename AS name
FROM changed_files f JOIN pr_tenant t ON f.pr_number = t.pr_number
LEFT JOIN settings s ON s.tenant = t.tenant
WHERE NOT {O.ignored('coalesce(s.ignore_files, [])')}"""))
def j2_anti_join_ignored(spark, sf_dir):
    t = Tables(spark, sf_dir)
    pr_tenant = t.runs.select("pr_number", "tenant").distinct()
    files = t.files.join(pr_tenant, "pr_number").select("pr_number", "tenant", "pos", "name")
    patterns = t.settings.select("tenant", F.explode("ignore_files").alias("pattern"))
    return fl.anti_join_ignored(files, patterns)


# ---------------------------------------------------------------- feedback
@register("a4_timeline", fx.oracle_with(["feedback"], O.timeline("all")))
def a4_timeline(spark, sf_dir):
    return fb.agg_timeline(Tables(spark, sf_dir).unified_feedback("all"), KEYS, "all")


@register("a4_timeline_non_empty", fx.oracle_with(["feedback"], O.timeline("non_empty")))
def a4_timeline_non_empty(spark, sf_dir):
    return fb.agg_timeline(Tables(spark, sf_dir).unified_feedback("non_empty"), KEYS, "non_empty")


@register("a6_feedback_counts", fx.oracle_with(["feedback"], """
SELECT pr_number, count(*) FILTER (WHERE type = 'review_decision') AS n_reviews,
  count(*) FILTER (WHERE type = 'review_comment') AS n_review_comments,
  count(*) FILTER (WHERE type = 'issue_comment') AS n_issue_comments
FROM feedback GROUP BY pr_number"""))
def a6_feedback_counts(spark, sf_dir):
    return fb.agg_feedback_counts(Tables(spark, sf_dir).unified_feedback("all"), KEYS)


@register("u1_union_feedback", fx.oracle_with(["feedback"], f"""
SELECT pr_number, pos, type, author, state, c AS content, file, CAST(line AS INTEGER) AS line, submitted_at
FROM ({O.unified_feedback('all')})"""))
def u1_union_feedback(spark, sf_dir):
    return Tables(spark, sf_dir).unified_feedback("all").select(
        "pr_number", "pos", "type", "author", "state", "content", "file", "line", "submitted_at")


@register("p4_feedback_non_empty", fx.oracle_with(["feedback"], f"""
SELECT pr_number, pos, type, c AS content, CAST(line AS INTEGER) AS line
FROM ({O.unified_feedback('non_empty')})"""))
def p4_feedback_non_empty(spark, sf_dir):
    return Tables(spark, sf_dir).unified_feedback("non_empty").select(
        "pr_number", "pos", "type", "content", "line")


# ---------------------------------------------------------------- Q1
@register("q1_pr_details", fx.oracle_with(["pull_requests", "changed_files", "feedback"], f"""
, fl AS (SELECT pr_number, string_agg(filename, '|' ORDER BY pos) AS file_names, count(*) AS n_files
         FROM changed_files GROUP BY pr_number),
tl AS ({O.timeline('all')})
SELECT p.pr_number, p.title, coalesce(p.body, '') AS description, p.base_ref AS base_branch,
  p.head_ref AS head_branch, p.commits, p.additions, p.deletions, p.changed_files,
  coalesce(fl.n_files, 0) AS n_files, coalesce(fl.file_names, '') AS file_names,
  coalesce(tl.timeline, {O.q(C.NO_FEEDBACK_TEXT)}) AS reviews
FROM pull_requests p LEFT JOIN fl ON p.pr_number = fl.pr_number LEFT JOIN tl ON p.pr_number = tl.pr_number"""))
def q1_pr_details(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = details.assemble_pr_details(t.pull_requests, t.changed_files, t.reviews, t.review_comments,
                                    t.issue_comments, KEYS)
    return d.select("pr_number", "title", "description", "base_branch", "head_branch", "commits",
                    "additions", "deletions", "changed_files",
                    F.size("files").cast("bigint").alias("n_files"),
                    F.array_join(F.transform("files", lambda x: x["name"]), "|").alias("file_names"),
                    "reviews")


# ---------------------------------------------------------------- Q3 requests
def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.build_requests(_prompts(spark, sf_dir))


_REQUESTS_SQL = _q2_ctes() + f"""
, q AS (SELECT *, coalesce(error_code, CASE WHEN coalesce(ai_service IN ('openai', 'anthropic'), false)
                    THEN NULL ELSE 'UNSUPPORTED_SERVICE' END) AS err FROM t4),
r AS (SELECT *, CASE WHEN err IS NULL THEN CASE ai_service
      WHEN 'openai' THEN coalesce(nullif(openai_endpoint, ''), {O.q(C.INSTALL_DEFAULTS['openai']['apiEndpoint'])})
      ELSE {O.q(C.ANTHROPIC_ENDPOINT)} END END AS endpoint,
    CASE WHEN err IS NULL THEN CASE ai_service WHEN 'openai' THEN coalesce(nullif(openai_model, ''), {O.q(C.INSTALL_DEFAULTS['openai']['model'])})
      ELSE anthropic_model END END AS model FROM q),
req AS (SELECT *, CASE WHEN err IS NULL THEN CASE ai_service
      WHEN 'openai' THEN CAST(to_json({{'model': model, 'messages': [{{'role': 'system', 'content': {O.q(C.SYSTEM_PROMPT)}}}, {{'role': 'user', 'content': p4}}],
        'max_tokens': max_tokens, 'temperature': CAST(0.7 AS DOUBLE), 'stream': true}}) AS VARCHAR)
      ELSE CAST(to_json({{'model': model, 'messages': [{{'role': 'user', 'content': p4}}], 'max_tokens': max_tokens,
        'system': {O.q(C.SYSTEM_PROMPT)}, 'stream': true}}) AS VARCHAR) END END AS body FROM r)
"""


@register("q3_build_requests", _REQUESTS_SQL + f"""
SELECT request_id, ai_service, err AS error_code, endpoint, model, sha256(body) AS body_sha256,
  CASE WHEN ai_service = 'openai' THEN CAST(coalesce(openai_endpoint = {O.q(C.INSTALL_DEFAULTS['openai']['apiEndpoint'])}, false) AS VARCHAR)
    ELSE 'N/A' END AS use_default_endpoint,
  coalesce(CASE WHEN ai_service = 'openai' THEN openai_model = {O.q(C.INSTALL_DEFAULTS['openai']['model'])}
    ELSE anthropic_model = {O.q(C.INSTALL_DEFAULTS['anthropic']['model'])} END, false) AS use_default_model,
  CASE WHEN err IS NULL THEN CASE ai_service WHEN 'openai' THEN {len(C.OPENAI_HEADER_NAMES)}
    ELSE {len(C.ANTHROPIC_HEADER_NAMES)} END END AS n_headers,
  CASE WHEN err IS NULL THEN {O.js_length('p4')} END AS audit_prompt_length
FROM req""")
def q3_build_requests(spark, sf_dir):
    """Request rows; the bodies are compared byte by byte, as hashes."""
    return _requests(spark, sf_dir).select(
        "request_id", "ai_service", "error_code", "endpoint", "model", F.sha2("body", 256).alias("body_sha256"),
        "use_default_endpoint", "use_default_model", F.size("header_names").alias("n_headers"),
        F.element_at("messages_audit", -1)["content_length"].alias("audit_prompt_length"))


# ---------------------------------------------------------------- Q4 streams
def _chunks(spark, sf_dir):
    return fx.stream_chunks(spark, sf_dir).select(*streams.CHUNK_COLUMNS)


_RESP_ID = "CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)"
_SERVICE = "CASE WHEN conv_id % 2 = 0 THEN 'openai' ELSE 'anthropic' END"


@register("q4_assemble_responses", f"""
SELECT {_RESP_ID} AS request_id, {_SERVICE} AS service, text AS content,
  CAST(floor(({O.js_length('text')} + 2) / 4) AS BIGINT) AS tokens,
  CAST(0 AS BIGINT) AS n_malformed, true AS ended
FROM conversations WHERE role = 'assistant'""")
def q4_assemble_responses(spark, sf_dir):
    return streams.assemble_responses(_chunks(spark, sf_dir)).select(
        "request_id", "service", "content", "tokens", "n_malformed", "ended")


_PIECES = f"""
SELECT {_RESP_ID} AS request_id, conv_id, i, text, substr(text, CAST(i * 16 + 1 AS BIGINT), 16) AS piece
FROM (SELECT conv_id, turn, text, unnest(range(0, CAST(floor((length(text) - 1) / 16) AS BIGINT) + 1)) AS i
      FROM conversations WHERE role = 'assistant')"""


@register("t2_extract_deltas", f"""
SELECT request_id, CAST(CASE WHEN conv_id % 2 = 0 THEN 2 * i ELSE 3 * i + 1 END AS BIGINT) AS line_no,
  piece AS content FROM ({_PIECES}) WHERE piece <> ''""")
def t2_extract_deltas(spark, sf_dir):
    return streams.extract_deltas(streams.assemble_lines(_chunks(spark, sf_dir)))


@register("w3_running_content", f"""
SELECT request_id, CAST(CASE WHEN conv_id % 2 = 0 THEN 2 * i ELSE 3 * i + 1 END AS BIGINT) AS line_no,
  piece AS content, substr(text, 1, CAST((i + 1) * 16 AS BIGINT)) AS shown
FROM ({_PIECES}) WHERE piece <> ''""")
def w3_running_content(spark, sf_dir):
    return streams.running_content(streams.extract_deltas(streams.assemble_lines(_chunks(spark, sf_dir))))


# T3 reads the same responses as sent by a relay that writes the text raw between the
# JSON quotes: every piece holding a newline cuts its data line inside the JSON value.
_RELAY_SQL = f"""
WITH pieces AS (
  SELECT conv_id, turn, {_SERVICE} AS service,
    list_transform(range(0, CAST(trunc((length(text) - 1) / 16) AS BIGINT) + 1),
                   lambda i: substr(text, CAST(i * 16 + 1 AS BIGINT), 16)) AS ps
  FROM conversations WHERE role = 'assistant'),
wire AS (
  SELECT conv_id, turn, service, CASE WHEN service = 'openai' THEN
    array_to_string(list_transform(ps, lambda p: 'data: {{"choices":[{{"delta":{{"content":"' || p || '"}}}}]}}'),
                    chr(10) || chr(10)) || chr(10) || chr(10) || 'data: [DONE]' || chr(10) || chr(10)
  ELSE
    array_to_string(list_transform(ps, lambda p: 'event: content_block_delta' || chr(10) ||
      'data: {{"type":"content_block_delta","delta":{{"text":"' || p || '"}}}}'), chr(10) || chr(10))
      || chr(10) || chr(10) || 'event: message_stop' || chr(10) || 'data: {{"type":"message_stop"}}' || chr(10) || chr(10)
  END AS w FROM pieces),
split AS (SELECT conv_id, turn, service, string_split(w, chr(10)) AS parts FROM wire),
lines AS (SELECT conv_id, turn, service, parts, unnest(range(len(parts) - 1)) AS i FROM split)
SELECT {_RESP_ID} AS request_id, CAST(i AS BIGINT) AS line_no, parts[i + 1] AS line
FROM lines
WHERE starts_with(parts[i + 1], 'data: ') AND parts[i + 1] <> 'data: [DONE]'
  AND NOT json_valid(substr(parts[i + 1], 7))"""


@register("t3_route_malformed", _RELAY_SQL)
def t3_route_malformed(spark, sf_dir):
    relay = fx.stream_chunks(spark, sf_dir, escaped=False).select(*streams.CHUNK_COLUMNS)
    return streams.route_malformed(streams.assemble_lines(relay))


# DuckDB twin of the Spark-built response streams (same JSON bytes as Spark's to_json).
_WIRE_SQL = f"""
WITH pieces AS (
  SELECT conv_id, turn, {_SERVICE} AS service,
    list_transform(range(0, CAST(trunc((length(text) - 1) / 16) AS BIGINT) + 1),
                   lambda i: substr(text, CAST(i * 16 + 1 AS BIGINT), 16)) AS ps
  FROM conversations WHERE role = 'assistant'),
wire AS (
  SELECT conv_id, turn, service, CASE WHEN service = 'openai' THEN
    array_to_string(list_transform(ps, lambda p: 'data: ' || to_json({{'choices': [{{'delta': {{'content': p}}}}]}})),
                    chr(10) || chr(10)) || chr(10) || chr(10) || 'data: [DONE]' || chr(10) || chr(10)
  ELSE
    array_to_string(list_transform(ps, lambda p: 'event: content_block_delta' || chr(10) || 'data: ' ||
      to_json({{'type': 'content_block_delta', 'delta': {{'text': p}}}})), chr(10) || chr(10))
      || chr(10) || chr(10) || 'event: message_stop' || chr(10) || 'data: {{"type":"message_stop"}}' || chr(10) || chr(10)
  END AS w FROM pieces)"""


@register("a9_stream_stats", _WIRE_SQL + f"""
SELECT {_RESP_ID} AS request_id, service, CAST(ceil(strlen(w) / 37) AS BIGINT) AS chunk_count,
  CAST(strlen(w) AS BIGINT) AS total_bytes, CAST(least(37, strlen(w)) AS BIGINT) AS max_chunk_bytes,
  true AS ended
FROM wire""")
def a9_stream_stats(spark, sf_dir):
    return streams.stream_status(_chunks(spark, sf_dir))


# ---------------------------------------------------------------- Q5 / Q6 results
def _completions(spark, sf_dir):
    return streams.assemble_responses(_chunks(spark, sf_dir)).select("request_id", "content", "tokens", "ended")


def _flagged_runs(t: Tables) -> DataFrame:
    return st.flag_review_eligibility(st.resolve_run_settings(t.runs, t.settings))


def _results(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return results.build_review_results(_completions(spark, sf_dir), _flagged_runs(t), t.pull_requests, t.files, KEYS)


def _run_results_sql() -> str:
    """Oracle CTEs ending in ``res``: one row per run, failed ones included."""
    tables = ["runs", "settings_raw", "changed_files", "feedback"]
    return fx.derived_cte([*tables, "pull_requests"]) + _q2_ctes()[len(fx.derived_cte(tables)):] + f"""
, resp AS (SELECT {_RESP_ID} AS response_id, text AS review, CAST(floor(({O.js_length('text')} + 2) / 4) AS BIGINT) AS tokens
           FROM conversations WHERE role = 'assistant'),
names AS (SELECT pr_number, tenant, string_agg(filename, '|' ORDER BY pos) AS file_names FROM kept GROUP BY pr_number, tenant),
res AS (SELECT t4.*, resp.review, resp.tokens, names.file_names, p.changed_files AS total_files, p.additions, p.deletions, p.owner, p.repo,
          coalesce(t4.error_code, CASE WHEN resp.response_id IS NULL THEN CASE WHEN coalesce(t4.ai_service IN ('openai', 'anthropic'), false)
            THEN 'NO_RESPONSE' ELSE 'UNSUPPORTED_SERVICE' END END) AS code
        FROM t4 LEFT JOIN resp ON response_id = t4.request_id LEFT JOIN pull_requests p ON p.pr_number = t4.pr_number
        LEFT JOIN names ON names.pr_number = t4.pr_number AND names.tenant = t4.tenant)
"""


_MESSAGES = "CASE code " + " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in (C.ERRORS | C.OWN_ERRORS).items()) + " END"


@register("j4_run_results", _run_results_sql() + f"""
SELECT request_id, pr_number, run_ts, code IS NULL AS success, code AS error_code, {_MESSAGES} AS error_message,
  CASE WHEN code IS NULL THEN review END AS review, CASE WHEN code IS NULL THEN file_names END AS file_names,
  CASE WHEN code IS NULL THEN CAST(file_count AS BIGINT) END AS reviewed_files,
  CASE WHEN code IS NULL THEN total_files END AS total_files, CASE WHEN code IS NULL THEN additions END AS additions,
  CASE WHEN code IS NULL THEN deletions END AS deletions, CASE WHEN code IS NULL THEN tokens END AS token_usage,
  CASE WHEN code IS NULL THEN true END AS ended
FROM res""")
def j4_run_results(spark, sf_dir):
    """Every run with its nested result, or with what went wrong."""
    t = Tables(spark, sf_dir)
    r = results.run_results(_flagged_runs(t), _completions(spark, sf_dir), t.pull_requests, t.files, KEYS)
    return r.select("request_id", "pr_number", "run_ts", "success", "error_code", "error_message", "review",
                    F.array_join(F.transform("files", lambda x: x["name"]), "|").alias("file_names"), "reviewed_files",
                    "summary.*", "token_usage", "ended")


def _results_sql() -> str:
    html = ("regexp_replace(regexp_replace(regexp_replace(review, chr(10), '<br>', 'g'), "
            "'```([^`]+)```', '<pre><code>\\\\1</code></pre>', 'g'), '`([^`]+)`', '<code>\\\\1</code>', 'g')")
    stats = ("'审查文件数: ' || CAST(reviewed_files AS VARCHAR) || chr(10) || '代码增加: +' || "
             "CAST(additions AS VARCHAR) || chr(10) || '代码删除: -' || CAST(deletions AS VARCHAR) || "
             "chr(10) || 'Token消耗: ' || coalesce(CAST(nullif(tokens, 0) AS VARCHAR), 'N/A')")
    return _run_results_sql() + f"""
, latest AS (SELECT *, CAST(file_count AS BIGINT) AS reviewed_files FROM (
             SELECT *, row_number() OVER (PARTITION BY pr_number ORDER BY run_ts DESC, request_id DESC) AS rn
             FROM res WHERE code IS NULL) WHERE rn = 1),
out AS (SELECT request_id, pr_number, run_ts, review, reviewed_files, total_files, additions, deletions, tokens, file_names,
          {html} AS review_html, {stats} AS stats_text, owner, repo FROM latest)
"""


@register("q5_review_results", _results_sql() + """
SELECT request_id, pr_number, run_ts, review, reviewed_files, total_files, additions, deletions, tokens,
  file_names, review_html, stats_text FROM out""")
def q5_review_results(spark, sf_dir):
    return _results(spark, sf_dir).select(
        "request_id", "pr_number", "run_ts", "review", "reviewed_files", "total_files", "additions",
        "deletions", "tokens", F.array_join(F.transform("files", lambda x: x["name"]), "|").alias("file_names"),
        "review_html", "stats_text")


@register("q6_submissions", _results_sql() + """
SELECT request_id, pr_number, owner, repo,
  '/repos/' || owner || '/' || repo || '/pulls/' || CAST(pr_number AS VARCHAR) || '/reviews' AS endpoint,
  review AS body, 'COMMENT' AS event, sha256(review) AS body_sha256 FROM out""")
def q6_submissions(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return results.build_submissions(_results(spark, sf_dir), t.pull_requests, KEYS)


# ---------------------------------------------------------------- Q7 visits
_HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@register("p6_parse_pr_url", fx.oracle_with(["page_visits"], f"""
SELECT tab_id, seq, url, path, string_split(path, '/')[2] AS owner, string_split(path, '/')[3] AS repo,
  string_split(path, '/')[5] AS pr_number
FROM (SELECT *, {_PATH} AS path FROM page_visits)"""))
def p6_parse_pr_url(spark, sf_dir):
    return visits.parse_pr_url(Tables(spark, sf_dir).page_visits).select(
        "tab_id", "seq", "url", "path", "owner", "repo", "pr_number")


@register("p5_filter_pr_pages", fx.oracle_with(["page_visits"], f"""
SELECT tab_id, seq, url FROM page_visits WHERE {_HOST} = 'github.com' AND contains({_PATH}, '/pull/')"""))
def p5_filter_pr_pages(spark, sf_dir):
    return visits.filter_pr_pages(Tables(spark, sf_dir).page_visits).select("tab_id", "seq", "url")


@register("q7_pr_visit_feed", fx.oracle_with(["page_visits"], f"""
, pr AS (SELECT *, {_PATH} AS path FROM page_visits WHERE {_HOST} = 'github.com' AND contains({_PATH}, '/pull/')),
l AS (SELECT *, lag(path) OVER (PARTITION BY tab_id, page_load_id ORDER BY ts, seq) AS prev FROM pr)
SELECT tab_id, page_load_id, seq, ts, url, path, string_split(path, '/')[2] AS owner,
  string_split(path, '/')[3] AS repo, string_split(path, '/')[5] AS pr_number
FROM l WHERE prev IS DISTINCT FROM path"""))
def q7_pr_visit_feed(spark, sf_dir):
    return visits.pr_visit_feed(Tables(spark, sf_dir).page_visits)


# ---------------------------------------------------------------- scalar functions
@register("f1_file_extension", fx.oracle_with(["changed_files"], f"""
SELECT pr_number, pos, filename AS name, {O.EXTENSION} AS extension FROM changed_files"""))
def f1_file_extension(spark, sf_dir):
    return Tables(spark, sf_dir).files.select("pr_number", "pos", "name",
                                              file_extension("name").alias("extension"))


@register("f10_render_review_html", fx.oracle_with(["review_text"], """
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(content, chr(10), '<br>', 'g'),
  '```([^`]+)```', '<pre><code>\\1</code></pre>', 'g'), '`([^`]+)`', '<code>\\1</code>', 'g') AS html
FROM review_text"""))
def f10_render_review_html(spark, sf_dir):
    return Tables(spark, sf_dir).review_text.select("doc_id", render_review_html("content").alias("html"))


@register("f11_estimate_tokens", f"""
SELECT doc_id, {O.js_length('text')} AS utf16_length,
  CAST(floor(({O.js_length('text')} + 2) / 4) AS BIGINT) AS tokens FROM documents""")
def f11_estimate_tokens(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", js_length("text").alias("utf16_length"), estimate_tokens("text").alias("tokens"))


@register("o2_preview", f"""
SELECT doc_id, substr(text, 1, 200) || '...' AS preview_200, substr(text, 1, 2000) || '...' AS preview_2000
FROM documents""")
def o2_preview(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", preview("text", 200).alias("preview_200"),
                    preview("text", 2000).alias("preview_2000"))


@register("f23_api_endpoints", fx.oracle_with(["pull_requests"], """
SELECT pr_number, '/repos/' || owner || '/' || repo || '/pulls/' || CAST(pr_number AS VARCHAR) AS pull,
  '/repos/' || owner || '/' || repo || '/pulls/' || CAST(pr_number AS VARCHAR) || '/files' AS files,
  '/repos/' || owner || '/' || repo || '/pulls/' || CAST(pr_number AS VARCHAR) || '/reviews' AS reviews,
  '/repos/' || owner || '/' || repo || '/pulls/' || CAST(pr_number AS VARCHAR) || '/comments' AS review_comments,
  '/repos/' || owner || '/' || repo || '/issues/' || CAST(pr_number AS VARCHAR) || '/comments' AS issue_comments
FROM pull_requests"""))
def f23_api_endpoints(spark, sf_dir):
    p = Tables(spark, sf_dir).pull_requests
    return p.select("pr_number", *[api_endpoint(k).alias(k) for k in
                                   ("pull", "files", "reviews", "review_comments", "issue_comments")])


@register("f24_pr_summary_text", fx.oracle_with(["pull_requests"], """
SELECT pr_number, '仓库: ' || owner || '/' || repo || chr(10) || 'PR编号: #' || CAST(pr_number AS VARCHAR)
  || chr(10) || '标题: ' || coalesce(nullif(title, ''), '加载中...') || chr(10) || '变更文件: '
  || coalesce(CAST(nullif(changed_files, 0) AS VARCHAR), '加载中...') || '个' AS summary
FROM pull_requests"""))
def f24_pr_summary_text(spark, sf_dir):
    p = Tables(spark, sf_dir).pull_requests
    return p.select("pr_number", results.pr_summary_text(file_count="changed_files").alias("summary"))


# ---------------------------------------------------------------- settings
def _settings_out(df: DataFrame) -> DataFrame:
    return df.select("tenant", "has_token", "has_openai_key", "has_anthropic_key", "ai_service",
                     "openai_endpoint", "openai_model", "anthropic_model", "max_tokens",
                     F.array_join("ignore_files", "|").alias("ignore_files"),
                     (F.col("review_prompt") == C.INSTALL_DEFAULTS["review"]["reviewPrompt"])
                     .alias("default_prompt"))


@register("m4_normalize_settings", fx.oracle_with(["settings_raw"], f"""
, s AS ({O.settings_flat()})
SELECT tenant, has_token, has_openai_key, has_anthropic_key, ai_service, openai_endpoint, openai_model,
  anthropic_model, max_tokens, array_to_string(ignore_files, '|') AS ignore_files, true AS default_prompt FROM s"""))
def m4_normalize_settings(spark, sf_dir):
    return _settings_out(Tables(spark, sf_dir).settings)


@register("j3_resolve_run_settings", fx.oracle_with(["runs", "settings_raw"], f"""
, s AS ({O.settings_flat()})
SELECT r.request_id, r.tenant, coalesce(nullif(r.temp_ai_service, ''), s.ai_service) AS ai_service,
  coalesce(nullif(r.temp_review_prompt, ''), s.review_prompt) AS review_prompt, s.max_tokens
FROM runs r LEFT JOIN s ON r.tenant = s.tenant"""))
def j3_resolve_run_settings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return st.resolve_run_settings(t.runs, t.settings).select(
        "request_id", "tenant", "ai_service", "review_prompt", "max_tokens")


@register("p11_review_eligibility", _q2_ctes() + "\nSELECT request_id, error_code FROM t4")
def p11_review_eligibility(spark, sf_dir):
    return _prompts(spark, sf_dir).select("request_id", "error_code")


_KEYS_SQL = """
SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'openai' WHEN 'BUILDING' THEN 'anthropic'
    WHEN 'FURNITURE' THEN 'openai' WHEN 'HOUSEHOLD' THEN 'anthropic' ELSE 'other' END AS ai_service,
  concat(CASE WHEN c_custkey % 3 = 0 THEN 'sk-' ELSE '' END, substr(c_name, 1, CAST(c_custkey % 25 AS INT))) AS api_key
FROM customer"""


@register("p12_settings_quality", f"""
WITH k AS ({_KEYS_SQL})
SELECT c_custkey, ai_service, length(api_key) > 0 AS has_key, CAST(length(api_key) AS INTEGER) AS key_length,
  CASE ai_service WHEN 'anthropic' THEN starts_with(api_key, 'sk-') AND length(api_key) >= 20
    WHEN 'openai' THEN length(api_key) >= 20 ELSE false END AS key_ok,
  CASE ai_service WHEN 'anthropic' THEN CASE WHEN NOT (starts_with(api_key, 'sk-') AND length(api_key) >= 20) THEN 'INVALID_ANTHROPIC_KEY' END
    WHEN 'openai' THEN CASE WHEN length(api_key) < 20 THEN 'INVALID_OPENAI_KEY' END
    ELSE 'UNSUPPORTED_SERVICE' END AS key_error
FROM k""")
def p12_settings_quality(spark, sf_dir):
    keys = fx.spark_sql(spark, sf_dir, _KEYS_SQL)
    return st.flag_settings_quality(keys)


# ---------------------------------------------------------------- template modes, M3 / M5
@register("q2_review_prompts_sequential", _q2_sql("sequential"))
def q2_review_prompts_sequential(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return prompts.build_review_prompts(t.runs, t.settings, t.files, t.unified_feedback("all"), KEYS,
                                        mode="sequential").select(*Q2_COLUMNS)


@register("m3_settings_with_fallback", fx.oracle_with(["settings_raw"], f"""
, s AS ({O.settings_flat()})
SELECT tenant, coalesce(nullif(ai_service, ''), 'openai') AS ai_service, openai_model,
  coalesce(nullif(anthropic_model, ''), {O.q(C.FORM_DEFAULTS['anthropic']['model'])}) AS anthropic_model,
  coalesce(nullif(max_tokens, 0), {C.FORM_DEFAULTS['maxTokens']}) AS max_tokens FROM s"""))
def m3_settings_with_fallback(spark, sf_dir):
    return st.settings_with_fallback(Tables(spark, sf_dir).settings).select(
        "tenant", "ai_service", "openai_model", "anthropic_model", "max_tokens")


@register("m5_reset_review_settings", fx.oracle_with(["settings_raw"], f"""
SELECT tenant, ai_service, {C.FORM_DEFAULTS['maxTokens']} AS max_tokens, '' AS ignore_files,
  true AS form_default_prompt FROM settings_raw"""))
def m5_reset_review_settings(spark, sf_dir):
    r = st.reset_review_settings(Tables(spark, sf_dir).settings)
    return r.select("tenant", "ai_service", "max_tokens",
                    F.array_join("ignore_files", "|").alias("ignore_files"),
                    (F.col("review_prompt") == C.FORM_DEFAULTS["reviewPrompt"]).alias("form_default_prompt"))


# ---------------------------------------------------------------- Q8 settings migration
_STORED_SQL = """
SELECT tenant, reason,
  map('aiService', ai_service, 'githubToken', CASE WHEN has_token THEN concat('secret-ref:', tenant) ELSE '' END,
      'theme', 'dark') AS top,
  map('apiKey', CASE WHEN has_key THEN concat('secret-ref:openai:', tenant) ELSE '' END, 'model', model) AS openai,
  map('apiKey', CASE WHEN has_key THEN concat('secret-ref:anthropic:', tenant) ELSE '' END) AS anthropic,
  map('maxTokens', max_tokens, 'ignoreFiles', ignore_files) AS review
FROM settings_raw"""


def _q8_sql() -> str:
    d = C.INSTALL_DEFAULTS
    parse_int = "try_cast(regexp_extract(max_tokens, '^\\s*([+-]?\\d+)', 1) AS INTEGER)"
    ign = ("array_to_string(list_filter(list_transform(string_split(coalesce(ignore_files, ''), chr(10)), "
           "lambda x: trim(x)), lambda x: x <> ''), '|')")
    return fx.oracle_with(["settings_raw"], f"""
, r AS (SELECT * FROM settings_raw)
SELECT tenant, reason,
  CASE WHEN reason = 'install' THEN {O.q(d['aiService'])} ELSE ai_service END AS ai_service,
  has_token,
  CASE WHEN reason = 'install' THEN false ELSE has_key END AS has_openai_key,
  CASE WHEN reason = 'install' THEN false ELSE has_key END AS has_anthropic_key,
  CASE WHEN reason IN ('install', 'update') THEN {O.q(d['openai']['apiEndpoint'])} END AS openai_endpoint,
  CASE WHEN reason = 'install' THEN {O.q(d['openai']['model'])} ELSE model END AS openai_model,
  CASE WHEN reason IN ('install', 'update') THEN {O.q(d['anthropic']['model'])} END AS anthropic_model,
  CASE WHEN reason IN ('install', 'update') THEN true END AS default_prompt,
  CASE WHEN reason = 'install' THEN {d['review']['maxTokens']} ELSE {parse_int} END AS max_tokens,
  CASE WHEN reason = 'install' THEN '' ELSE {ign} END AS ignore_files,
  'dark' AS theme
FROM r""")


def _migrated(spark, sf_dir) -> DataFrame:
    stored = fx.spark_sql(spark, sf_dir, fx.derived_cte(["settings_raw"]) + _STORED_SQL)
    return st.merge_settings(stored, "reason")


@register("q8_migrate_settings", _q8_sql())
def q8_migrate_settings(spark, sf_dir):
    m = _migrated(spark, sf_dir)
    flat = st.flatten_settings(m)
    theme = m.select("tenant", "reason", F.try_element_at("top", F.lit("theme")).alias("theme"))
    return flat.join(theme, "tenant").select(
        "tenant", "reason", "ai_service", "has_token", "has_openai_key", "has_anthropic_key",
        "openai_endpoint", "openai_model", "anthropic_model",
        (F.col("review_prompt") == C.INSTALL_DEFAULTS["review"]["reviewPrompt"]).alias("default_prompt"),
        "max_tokens", F.array_join("ignore_files", "|").alias("ignore_files"), "theme")


@register("k3_write_settings", _q8_sql())
def k3_write_settings(spark, sf_dir):
    merged, base = q8_migrate_settings(spark, sf_dir), scratch_path(spark, "settings")
    writers.write_settings(merged.withColumn("theme", F.lit("old")), base)
    writers.write_settings(merged, base)
    return writers.read_settings_version(spark, base, merged.schema)  # the second version


# ---------------------------------------------------------------- sources S1-S8
def _landed(spark, sf_dir, export: str) -> str:
    return landing.land_api_exports(spark, sf_dir, [export])[export]


@register("s1_read_pull_requests", fx.oracle_with(["pull_requests"], """
SELECT owner, repo, pr_number, title, body, base_ref, head_ref, author, commits, additions, deletions,
  changed_files FROM pull_requests"""))
def s1_read_pull_requests(spark, sf_dir):
    return readers.read_pull_requests(spark, _landed(spark, sf_dir, "pull_requests"))


@register("s2_read_changed_files", fx.oracle_with(["changed_files", "pull_requests"], """
SELECT p.owner, p.repo, f.pr_number, f.pos, f.filename, f.status, f.additions, f.deletions, f.patch, f.blob_url
FROM changed_files f JOIN pull_requests p ON f.pr_number = p.pr_number"""))
def s2_read_changed_files(spark, sf_dir):
    return readers.read_changed_files(spark, _landed(spark, sf_dir, "changed_files"))


_RANKED = "CAST(row_number() OVER (PARTITION BY x.pr_number ORDER BY x.pos) - 1 AS INTEGER) AS pos"


@register("s3_read_reviews", fx.oracle_with(["reviews", "pull_requests"], f"""
SELECT p.owner, p.repo, x.pr_number, {_RANKED}, x.author, x.state, x.body, x.submitted_at
FROM reviews x JOIN pull_requests p ON x.pr_number = p.pr_number"""))
def s3_read_reviews(spark, sf_dir):
    return readers.read_reviews(spark, _landed(spark, sf_dir, "reviews"))


@register("s4_read_review_comments", fx.oracle_with(["review_comments", "pull_requests"], f"""
SELECT p.owner, p.repo, x.pr_number, {_RANKED}, x.author, x.body, x.path, x.line, x.position, x.created_at
FROM review_comments x JOIN pull_requests p ON x.pr_number = p.pr_number"""))
def s4_read_review_comments(spark, sf_dir):
    return readers.read_review_comments(spark, _landed(spark, sf_dir, "review_comments"))


@register("s5_read_issue_comments", fx.oracle_with(["issue_comments", "pull_requests"], f"""
SELECT p.owner, p.repo, x.pr_number, {_RANKED}, x.author, x.body, x.created_at
FROM issue_comments x JOIN pull_requests p ON x.pr_number = p.pr_number"""))
def s5_read_issue_comments(spark, sf_dir):
    return readers.read_issue_comments(spark, _landed(spark, sf_dir, "issue_comments"))


@register("s6_read_settings", fx.oracle_with(["settings_raw"], f"""
, s AS ({O.settings_flat()})
SELECT tenant, has_token, has_openai_key, has_anthropic_key, ai_service, openai_model, anthropic_model,
  max_tokens, array_to_string(ignore_files, '|') AS ignore_files FROM s"""))
def s6_read_settings(spark, sf_dir):
    path = landing.land_settings_docs(spark, Tables(spark, sf_dir).settings)
    back = readers.read_settings(spark, path)
    return back.select("tenant", "has_token", "has_openai_key", "has_anthropic_key", "ai_service",
                       "openai_model", "anthropic_model", "max_tokens",
                       F.array_join("ignore_files", "|").alias("ignore_files"))


def _documents_sql(export: str, table: str, key: str = "pr_number") -> str:
    return f"""SELECT '{export}' AS export, count(DISTINCT {key}) AS documents,
  count(DISTINCT CASE WHEN CAST(regexp_extract(CAST({key} AS VARCHAR), '[0-9]+$') AS BIGINT) % 10 <> 3 THEN {key} END) AS good,
  count(DISTINCT CASE WHEN CAST(regexp_extract(CAST({key} AS VARCHAR), '[0-9]+$') AS BIGINT) % 10 = 3 THEN {key} END) AS quarantined
FROM {table}"""


@register("s1_s6_quarantine", fx.oracle_with(
    ["pull_requests", "changed_files", "reviews", "review_comments", "issue_comments", "settings_raw"], "\nUNION ALL\n".join(
        [_documents_sql("pull_requests", "pull_requests"),
         *[_documents_sql(x, f"{x} JOIN (SELECT pr_number AS n FROM pull_requests) p ON pr_number = n")
           for x in ("changed_files", "reviews", "review_comments", "issue_comments")],
         _documents_sql("settings", "settings_raw", "tenant")])))
def s1_s6_quarantine(spark, sf_dir):
    """Documents that broke off: of each export, how many its reader returns and how many are quarantined."""
    paths = landing.land_api_exports(spark, sf_dir) | {"settings": landing.land_settings_docs(spark, Tables(spark, sf_dir).settings)}
    read = {"pull_requests": readers.read_pull_requests, "changed_files": readers.read_changed_files, "reviews": readers.read_reviews,
            "review_comments": readers.read_review_comments, "issue_comments": readers.read_issue_comments,
            "settings": readers.read_settings}
    parts = []
    for export, reader in read.items():
        key = readers.EXPORTS[export][1][-1]
        path = landing.land_cut_off(spark, paths[export], key)
        good = reader(spark, path).select(F.col(key).cast("string").alias("k"), F.lit(True).alias("is_good")).distinct()
        bad = readers.read_quarantine(spark, path, export).select(F.col("document").alias("k"), F.lit(False).alias("is_good"))
        parts.append(good.unionByName(bad).groupBy().agg(
            F.lit(export).alias("export"), F.count(F.lit(1)).alias("documents"), F.count_if("is_good").alias("good"),
            F.count_if(~F.col("is_good")).alias("quarantined")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


ARRIVALS = 4


def _land_in_parts(df: DataFrame, spark, name: str, at, parts: int = ARRIVALS) -> str:
    """Write ``df`` as ``parts`` separately committed file sets, one after the other; ``at`` is a row's set.

    ``df`` is worked out once, into one folder a set; the sets are then landed from there.
    """
    base, files = scratch_path(spark, name), max(2, spark.sparkContext.defaultParallelism)
    held = scratch_path(spark, f"{name}-held")
    df.withColumn("_at", at.cast("int")).write.mode("overwrite").partitionBy("_at").parquet(held)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_at", T.IntegerType())])).parquet(held)
    for i in range(parts):
        rows.where(F.col("_at") == i).drop("_at").repartition(files).write.mode("overwrite").parquet(f"{base}/batch={i:03d}")
    return base


@register("s7_read_stream_chunks", _WIRE_SQL + f"""
SELECT {_RESP_ID} AS request_id, CAST(seq AS INTEGER) AS seq, service,
  hex(encode(w)[seq * 37 + 1:seq * 37 + 37]) AS payload_hex, seq = CAST(ceil(strlen(w) / 37) AS BIGINT) - 1 AS is_last
FROM (SELECT *, unnest(range(0, CAST(ceil(strlen(w) / 37) AS BIGINT))) AS seq FROM wire)""")
def s7_read_stream_chunks(spark, sf_dir):
    base = scratch_path(spark, "chunks")
    _chunks(spark, sf_dir).write.mode("overwrite").parquet(base)
    return readers.read_stream_chunks(spark, base).select(
        "request_id", "seq", "service", F.hex("payload").alias("payload_hex"), "is_last")


@register("s8_read_page_visits", fx.oracle_with(["page_visits"], """
SELECT tab_id, page_load_id, seq, ts, url FROM page_visits"""))
def s8_read_page_visits(spark, sf_dir):
    base = scratch_path(spark, "visits")
    Tables(spark, sf_dir).page_visits.write.mode("overwrite").parquet(base)
    return readers.read_page_visits(spark, base)


# ---------------------------------------------------------------- sinks K1 / K2
@register("k1_write_requests", _REQUESTS_SQL + """
SELECT request_id, ai_service AS service, sha256('{"custom_id":' || CAST(to_json(request_id) AS VARCHAR) || ',"url":'
  || CAST(to_json(endpoint) AS VARCHAR) || ',"body":' || body || '}') AS line_sha256
FROM req WHERE err IS NULL""")
def k1_write_requests(spark, sf_dir):
    """The written lines, byte by byte as hashes."""
    rows = max(fx.base_table(spark, sf_dir, t).count() for t in ("lineitem", "orders", "events"))
    with sized_shuffles(spark, rows):
        path = writers.write_requests(_requests(spark, sf_dir), scratch_path(spark, "requests"))
    back = spark.read.text(path)
    return back.select(F.get_json_object("value", "$.custom_id").alias("request_id"), "service", F.sha2("value", 256).alias("line_sha256"))


@register("k2_write_submissions", ORACLE["q6_submissions"])
def k2_write_submissions(spark, sf_dir):
    subs = q6_submissions(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)  # one result, handed over twice
    try:
        outbox = scratch_path(spark, "outbox")
        writers.write_submissions(spark, subs, outbox)
        return writers.write_submissions(spark, subs, outbox)  # second batch adds nothing
    finally:
        subs.unpersist()


# ---------------------------------------------------------------- streaming T1-T6, K4
def _state_partitions(spark):
    """While a stream starts: as many state partitions as tasks run at once (fixed in its checkpoint then)."""
    @contextlib.contextmanager
    def held():
        key = "spark.sql.shuffle.partitions"
        before = spark.conf.get(key)
        spark.conf.set(key, str(max(2, spark.sparkContext.defaultParallelism)))
        try:
            yield
        finally:
            spark.conf.set(key, before)
    return held()


def _run_stream(df: DataFrame, spark, name: str) -> DataFrame:
    """Run a stream to the end of its input."""
    out, ck = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    with _state_partitions(spark):
        q = writers.write_stream(df, out, ck)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _chunk_stream(spark, chunks: DataFrame) -> DataFrame:
    """The chunks as they arrive: in any order, cut into file sets by a hash of all columns."""
    landed = _land_in_parts(chunks, spark, "chunk-arrivals", F.pmod(F.xxhash64(*chunks.columns), F.lit(ARRIVALS)))
    return readers.read_stream_chunks(spark, landed + "/*", stream=True,
                                      max_files_per_trigger=max(2, spark.sparkContext.defaultParallelism))


@register("t1_stream_responses", f"""
SELECT {_RESP_ID} AS request_id, text AS content,
  CAST(floor(({O.js_length('text')} + 2) / 4) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS n_malformed, 'done' AS status
FROM conversations WHERE role = 'assistant'""")
def t1_stream_responses(spark, sf_dir):
    """T1-T5 in one query: the sink holds one row per ended response."""
    out = _run_stream(assembly.response_stream(_chunk_stream(spark, _chunks(spark, sf_dir))), spark, "responses")
    return out.select("request_id", "content", "tokens", "n_malformed", "status")


def _published(spark, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deltas, dead letters) that K4 publishes from the chunks as a stream."""
    deltas, dead, ck = (scratch_path(spark, n) for n in ("deltas", "dead-letters", "deltas-ckpt"))
    with _state_partitions(spark):
        q = writers.write_delta_batches(assembly.delta_stream(_chunk_stream(spark, chunks)), deltas, dead, ck)
    q.awaitTermination()
    return writers.read_deltas(spark, deltas), writers.read_dead_letters(spark, dead)


@register("k4_write_deltas", f"""
SELECT request_id, CAST(CASE WHEN conv_id % 2 = 0 THEN 2 * i ELSE 3 * i + 1 END AS BIGINT) AS line_no,
  piece AS content, false AS done FROM ({_PIECES}) WHERE piece <> ''
UNION ALL
SELECT {_RESP_ID} AS request_id,
  CAST(CASE WHEN conv_id % 2 = 0 THEN 2 * n + 2 ELSE 3 * n + 3 END AS BIGINT) AS line_no, '' AS content, true AS done
FROM (SELECT conv_id, turn, CAST(trunc((length(text) - 1) / 16) AS BIGINT) + 1 AS n
      FROM conversations WHERE role = 'assistant')""")
def k4_write_deltas(spark, sf_dir):
    return _published(spark, _chunks(spark, sf_dir))[0]


@register("t3_dead_letters_stream", _RELAY_SQL)
def t3_dead_letters_stream(spark, sf_dir):
    relay = fx.stream_chunks(spark, sf_dir, escaped=False).select(*streams.CHUNK_COLUMNS)
    return _published(spark, relay)[1].where("kind = 'malformed'").select("request_id", "line_no", "line")


VISIT_SETS = 8
VISIT_JITTER = 3600


@register("t6_visits_stream", ORACLE["q7_pr_visit_feed"])
def t6_visits_stream(spark, sf_dir):
    """T6 over visits that arrive up to an hour late, in any order within a file set.

    The watermark's delay covers two file sets and that hour, since a micro-batch may end in the
    middle of a set. A last visit (of no PR page) moves the watermark past all others.
    """
    v = Tables(spark, sf_dir).page_visits.withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.unix_seconds("ts") + F.pmod(F.xxhash64("tab_id", "seq"), F.lit(VISIT_JITTER))
    first, last, cuts = v.select(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts")), F.percentile_approx(
        arrival, [i / VISIT_SETS for i in range(1, VISIT_SETS)])).first()
    edges = [first or 0, *(cuts or []), (last or 0) + VISIT_JITTER]
    delay = 2 * max(b - a for a, b in zip(edges, edges[1:])) + VISIT_JITTER
    at = sum((F.when(arrival > c, 1).otherwise(0) for c in cuts or []), F.lit(0))
    end = spark.range(1).select(F.lit(None).cast("long").alias("tab_id"), F.lit(0).cast("long").alias("page_load_id"),
                                F.lit(0).cast("long").alias("seq"), F.timestamp_seconds(F.lit(edges[-1] + 2 * delay)).alias("ts"),
                                F.lit("https://github.com/").alias("url"))
    landed = _land_in_parts(v, spark, "visit-arrivals", at, VISIT_SETS)
    end.write.parquet(f"{landed}/batch={VISIT_SETS:03d}")
    stream = readers.read_page_visits(spark, landed + "/*", stream=True,
                                      max_files_per_trigger=max(2, spark.sparkContext.defaultParallelism))
    out = _run_stream(assembly.detect_pr_changes_stream(stream, f"{delay} seconds"), spark, "visit-feed")
    return out.where("error_code IS NULL").drop("error_code")
