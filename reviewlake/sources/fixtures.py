"""Derived input tables over the driver's test data.

Each derivation is plain SQL that runs unchanged in Spark SQL and in
DuckDB, so the same text feeds the Spark job and the oracle. In Spark the
base tables are bound through CTEs over ``parquet.`path``` (no catalog
state, column pruning and filter pushdown reach the scan); in the oracle
they are the driver's pre-registered views.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()

DERIVED: dict[str, str] = {}

DERIVED["pull_requests"] = """
SELECT o_orderkey AS pr_number, lower(c_mktsegment) AS owner,
  concat('repo', CAST(c_nationkey AS STRING)) AS repo,
  concat('Change ', o_orderpriority) AS title,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('Body for ', CAST(o_orderkey AS STRING)) END AS body,
  'main' AS base_ref, concat('feature-', CAST(o_custkey AS STRING)) AS head_ref,
  concat('user', CAST(o_custkey % 17 AS STRING)) AS author,
  CAST(o_orderkey % 9 + 1 AS INT) AS commits,
  coalesce(a.additions, 0) AS additions, coalesce(a.deletions, 0) AS deletions,
  coalesce(a.changed_files, 0) AS changed_files
FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS INT) AS additions,
                  CAST(sum(CAST(round(l_discount * 100) AS INT)) AS INT) AS deletions,
                  CAST(count(*) AS INT) AS changed_files
           FROM lineitem GROUP BY l_orderkey) a ON a.l_orderkey = o_orderkey
"""

# The position window partitions by the renamed key, so the files come out
# hash-partitioned by ``pr_number`` and per-PR joins and aggregations reuse it.
DERIVED["changed_files"] = """
SELECT pr_number,
  CAST(row_number() OVER (PARTITION BY pr_number ORDER BY l_linenumber, l_partkey, l_suppkey,
                     l_quantity, l_extendedprice, l_shipdate) - 1 AS INT) AS pos,
  filename, status, additions, deletions, patch, blob_url
FROM (
SELECT l_orderkey AS pr_number, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate,
  CASE WHEN l_partkey % 50 = 0 THEN 'package-lock.json'
       ELSE concat('src/', replace(p_name, ' ', '_'), '_', CAST(l_partkey AS STRING),
         CASE l_partkey % 6 WHEN 0 THEN '.js' WHEN 1 THEN '.test.js' WHEN 2 THEN '.min.js'
           WHEN 3 THEN '.css' WHEN 4 THEN '.py'
           ELSE CASE WHEN l_partkey % 4 = 1 THEN '.' ELSE '' END END) END AS filename,
  CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'removed' ELSE 'modified' END AS status,
  CAST(l_quantity AS INT) AS additions, CAST(round(l_discount * 100) AS INT) AS deletions,
  CASE WHEN l_linenumber = 7 THEN NULL
       WHEN l_partkey % 40 = 1 THEN concat('@@ -1 +1 @@', chr(10), '+{language} costs $$ or $& ', p_name)
       ELSE concat('@@ -1 +1 @@', chr(10), '+', p_name) END AS patch,
  concat('https://github.com/blob/', CAST(l_orderkey AS STRING), '/', CAST(l_partkey AS STRING)) AS blob_url
FROM lineitem JOIN part ON l_partkey = p_partkey) li
"""

# The same rows for Spark: the position window sorts and shuffles the plain columns, the texts are made of
# them after it. (``DERIVED`` keeps the form that the oracle runs.)
SPARK_FORMS = {"changed_files": """
SELECT pr_number, CAST(rn - 1 AS INT) AS pos,
  CASE WHEN l_partkey % 50 = 0 THEN 'package-lock.json'
       ELSE concat('src/', replace(p_name, ' ', '_'), '_', CAST(l_partkey AS STRING),
         CASE l_partkey % 6 WHEN 0 THEN '.js' WHEN 1 THEN '.test.js' WHEN 2 THEN '.min.js'
           WHEN 3 THEN '.css' WHEN 4 THEN '.py'
           ELSE CASE WHEN l_partkey % 4 = 1 THEN '.' ELSE '' END END) END AS filename,
  CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'removed' ELSE 'modified' END AS status,
  CAST(l_quantity AS INT) AS additions, CAST(round(l_discount * 100) AS INT) AS deletions,
  CASE WHEN l_linenumber = 7 THEN NULL
       WHEN l_partkey % 40 = 1 THEN concat('@@ -1 +1 @@', chr(10), '+{language} costs $$ or $& ', p_name)
       ELSE concat('@@ -1 +1 @@', chr(10), '+', p_name) END AS patch,
  concat('https://github.com/blob/', CAST(pr_number AS STRING), '/', CAST(l_partkey AS STRING)) AS blob_url
FROM (
SELECT *, row_number() OVER (PARTITION BY pr_number ORDER BY l_linenumber, l_partkey, l_suppkey,
                     l_quantity, l_extendedprice, l_shipdate) AS rn
FROM (
SELECT l_orderkey AS pr_number, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate,
  l_discount, l_returnflag, p_name
FROM lineitem JOIN part ON l_partkey = p_partkey) j) li
"""}

DERIVED["feedback"] = """
SELECT user_id AS pr_number, event_id AS pos,
  CASE WHEN event_type IN ('click', 'view') THEN 'review_decision'
       WHEN event_type IN ('signup', 'purchase') THEN 'review_comment' ELSE 'issue_comment' END AS type,
  concat('user', CAST(event_id % 17 AS STRING)) AS author,
  CASE WHEN event_type IN ('click', 'view') THEN
    CASE event_id % 5 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'CHANGES_REQUESTED' WHEN 2 THEN 'COMMENTED'
                      WHEN 3 THEN 'DISMISSED' ELSE 'PENDING' END END AS state,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '  '
       ELSE concat(' note ', CAST(event_id AS STRING)) END AS content,
  concat('src/f', CAST(event_id % 13 AS STRING), '.js') AS file,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 400 END AS line,
  date_trunc('day', ts) AS submitted_at
FROM events
"""

# The three landed feedback tables, split off the unified derivation.
DERIVED["reviews"] = """
SELECT pr_number, pos, author, state, content AS body, submitted_at
FROM feedback WHERE type = 'review_decision'
"""
DERIVED["review_comments"] = """
SELECT pr_number, pos, author, content AS body, file AS path, CAST(line AS INT) AS line,
  CAST(pos % 50 AS INT) AS position, submitted_at AS created_at
FROM feedback WHERE type = 'review_comment'
"""
DERIVED["issue_comments"] = """
SELECT pr_number, pos, author, content AS body, submitted_at AS created_at
FROM feedback WHERE type = 'issue_comment'
"""

DERIVED["page_visits"] = """
SELECT user_id AS tab_id, CAST(0 AS BIGINT) AS page_load_id, event_id AS seq, ts,
  CASE event_type
    WHEN 'click' THEN concat('https://github.com/acme/repo', CAST(user_id % 3 AS STRING), '/pull/', CAST(event_id % 2 AS STRING))
    WHEN 'view' THEN concat('https://github.com/acme/repo', CAST(user_id % 3 AS STRING), '/pull/', CAST(event_id % 2 AS STRING), '/files?x=1')
    WHEN 'signup' THEN 'https://github.com/acme/repo1/issues/3'
    WHEN 'purchase' THEN 'https://example.com/a/b/pull/9'
    ELSE 'https://github.com/' END AS url
FROM events
"""

DERIVED["review_text"] = """
SELECT doc_id, concat('Intro ', chr(96), 'x', CAST(doc_id AS STRING), chr(96), chr(10),
  repeat(chr(96), 3), 'code ', lang, repeat(chr(96), 3), chr(10),
  text, chr(10), 'unclosed ', chr(96), ' tick') AS content
FROM documents
"""

# Stored settings, one record per user (customer): service by market segment,
# the other fields by rules over the customer row, so every kind of stored
# value occurs (blank / missing model, unparsable and out-of-range token caps,
# multi-line ignore lists with blanks and padding, missing secrets) and the
# table grows with the data. ``reason`` is the trigger of the next migration.
DERIVED["settings_raw"] = """
SELECT concat('u', CAST(c_custkey AS STRING)) AS tenant,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'openai' WHEN 'BUILDING' THEN 'anthropic'
    WHEN 'FURNITURE' THEN 'openai' WHEN 'HOUSEHOLD' THEN 'anthropic' ELSE 'other' END AS ai_service,
  CASE c_custkey % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'm-b' END AS model,
  CASE c_custkey % 6 WHEN 0 THEN '1000' WHEN 1 THEN '12abc' WHEN 2 THEN '50' WHEN 3 THEN '99999'
    WHEN 4 THEN 'x' ELSE CAST(c_nationkey * 100 AS STRING) END AS max_tokens,
  CASE c_nationkey % 5 WHEN 0 THEN concat('*.test.js', chr(10), ' *.min.js ', chr(10), chr(10), 'package-lock.json')
    WHEN 1 THEN '' WHEN 2 THEN '*.css' WHEN 3 THEN 'package-lock.json' ELSE '*.js' END AS ignore_files,
  c_custkey % 7 <> 3 AS has_token, c_custkey % 9 <> 4 AS has_key,
  CASE c_custkey % 5 WHEN 0 THEN 'install' WHEN 1 THEN 'update' WHEN 2 THEN 'chrome_update'
    WHEN 3 THEN 'update' ELSE 'shared_module_update' END AS reason
FROM customer
"""

# Review runs: one per PR (turn 1), and a second one (turn 3) for urgent PRs.
# Overrides: some runs pick another service or an empty one, some bring their
# own template (placeholders reordered and repeated) or an empty one.
DERIVED["runs"] = """
SELECT concat(CAST(o_orderkey AS STRING), '-', CAST(turn AS STRING)) AS request_id,
  o_orderkey AS pr_number, concat('u', CAST(o_custkey AS STRING)) AS tenant,
  o_orderdate + turn * INTERVAL 1 HOUR AS run_ts,
  CASE WHEN o_orderkey % 7 = 0 THEN 'anthropic' WHEN o_orderkey % 7 = 1 THEN '' END AS temp_ai_service,
  CASE WHEN o_orderkey % 11 = 0 THEN concat('Review {diff} for {files} ({language}) {files}{reviews}', chr(10), 'End')
       WHEN o_orderkey % 11 = 1 THEN '' END AS temp_review_prompt
FROM (SELECT o_orderkey, o_custkey, o_orderdate, 1 AS turn FROM orders
      UNION ALL
      SELECT o_orderkey, o_custkey, o_orderdate, 3 AS turn FROM orders WHERE o_orderpriority = '1-URGENT') o
"""

# Dependencies between derived tables (bound as CTEs, in order).
DEPENDS = {
    "reviews": ["feedback"],
    "review_comments": ["feedback"],
    "issue_comments": ["feedback"],
}

_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def _base_refs(sql: str) -> list[str]:
    words = set(_WORD.findall(sql))
    return [t for t in BASE_TABLES if t in words]


def derived_cte(names: list[str], forms: dict[str, str] = DERIVED) -> str:
    """``WITH a AS (...), b AS (...)`` for the named derived tables and their deps."""
    order: list[str] = []

    def add(n: str):
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({forms[n].strip()})" for n in order)


def oracle_with(names: list[str], body: str) -> str:
    """Oracle SQL: derived tables as CTEs over the pre-registered base views."""
    return derived_cte(names) + "\n" + body.strip()


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL with base-table names bound to the parquet files of ``sf_dir``."""
    refs = _base_refs(sql)
    binds = ", ".join(
        f"{t} AS (SELECT * FROM parquet.`{os.path.join(sf_dir, t + '.parquet')}`)" for t in refs)
    stripped = sql.strip()
    if stripped.upper().startswith("WITH "):
        text = f"WITH {binds},\n{stripped[5:]}" if binds else stripped
    else:
        text = f"WITH {binds}\n{stripped}" if binds else stripped
    return spark.sql(text)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as a lazy DataFrame."""
    return spark_sql(spark, sf_dir, derived_cte([name], DERIVED | SPARK_FORMS) + f"\nSELECT * FROM {name}")


#: assistant turns that one task encodes and cuts up
TURNS_A_TASK = 500


def stream_chunks_sql(chunk_bytes: int = 37, piece_chars: int = 16, escaped: bool = True, tasks: int = 0) -> str:
    """Spark-only: assistant turns encoded as response streams and cut by bytes.

    Even conversations use dialect A (``data: {choices..}`` lines and a
    final ``data: [DONE]``), odd ones dialect B (``event:`` + ``data:`` line
    pairs, closed by an unrelated ``message_stop`` event). Cuts fall on
    fixed byte offsets, so multi-byte characters are split across chunks.
    With ``escaped=False`` the pieces are written the way a faulty relay
    writes them, raw between the JSON quotes: a piece holding a newline then
    ends its ``data:`` line in the middle of the JSON value. ``tasks``: over how many
    tasks the turns are dealt before they are cut up (up to 1: as they are read, and a
    small file is one task however much it unfolds to).
    """
    dealt = f"/*+ REPARTITION({tasks}) */ " if tasks > 1 else ""
    if escaped:
        body_a = "to_json(named_struct('choices', array(named_struct('delta', named_struct('content', p)))))"
        body_b = "to_json(named_struct('type', 'content_block_delta', 'delta', named_struct('text', p)))"
    else:
        body_a = """concat('{"choices":[{"delta":{"content":"', p, '"}}]}')"""
        body_b = """concat('{"type":"content_block_delta","delta":{"text":"', p, '"}}')"""
    return f"""
WITH pieces AS (
  SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS service,
    transform(sequence(0, CAST((length(text) - 1) / {piece_chars} AS INT)),
              i -> substring(text, i * {piece_chars} + 1, {piece_chars})) AS ps
  FROM (SELECT {dealt}conv_id, turn, text FROM conversations WHERE role = 'assistant')),
wire AS (
  SELECT conv_id, turn, service, CASE WHEN service = 'openai' THEN
    concat(array_join(transform(ps, p -> concat('data: ', {body_a})), '\\n\\n'), '\\n\\ndata: [DONE]\\n\\n')
  ELSE
    concat(array_join(transform(ps, p -> concat('event: content_block_delta\\ndata: ', {body_b})), '\\n\\n'),
      '\\n\\nevent: message_stop\\ndata: {{"type":"message_stop"}}\\n\\n')
  END AS w FROM pieces)
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS request_id, conv_id, turn, service,
  CAST(seq AS INT) AS seq, substring(encode(w, 'UTF-8'), seq * {chunk_bytes} + 1, {chunk_bytes}) AS payload,
  seq = CAST((octet_length(w) - 1) / {chunk_bytes} AS INT) AS is_last
FROM wire LATERAL VIEW explode(sequence(0, CAST((octet_length(w) - 1) / {chunk_bytes} AS INT))) e AS seq
"""


def stream_chunks(spark: SparkSession, sf_dir: str, chunk_bytes: int = 37,
                  piece_chars: int = 16, escaped: bool = True) -> DataFrame:
    tasks = -(-base_table(spark, sf_dir, "conversations").where("role = 'assistant'").count() // TURNS_A_TASK)
    return spark_sql(spark, sf_dir, stream_chunks_sql(chunk_bytes, piece_chars, escaped, tasks))
