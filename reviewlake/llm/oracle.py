"""DuckDB SQL of the queries that SQL can express, written from the definitions alone."""

from __future__ import annotations

from collections.abc import Mapping

from .decontaminate import NOT_WORD, WINDOW
from .mixing import SPACE, SWEEPS, TOPICS


def mix(powers: Mapping[str, float], fraction: float, docs: str = "documents") -> str:
    """Raking as a recursive table: one step is a sweep over all margins."""
    topic = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS)
    margins = list(powers)
    targets = ", ".join(f"pow(sum(tokens) OVER (PARTITION BY {m}), {p}) AS r_{m}" for m, p in powers.items())
    sums = ", ".join(f"(SELECT sum(r) FROM (SELECT any_value(r_{m}) AS r FROM raised GROUP BY {m})) AS s_{m}" for m in margins)
    columns = ", ".join([*margins, *(f"t_{m}" for m in margins)])
    step = "prev"
    for m in margins:
        step = f"(SELECT step, {columns}, share * t_{m} / sum(share) OVER (PARTITION BY {m}) AS share FROM {step})"
    keys = " AND ".join(f"d.{m} IS NOT DISTINCT FROM s.{m}" for m in margins)
    return f"""
WITH RECURSIVE sized AS (
  SELECT *, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '')) AS tokens,
         CASE {topic} ELSE 'prose' END AS topic FROM {docs}),
cells AS (SELECT {', '.join(margins)}, sum(tokens)::DOUBLE AS tokens FROM sized GROUP BY ALL),
raised AS (SELECT *, {targets} FROM cells WHERE tokens > 0),
start AS (SELECT {', '.join(margins)}, {', '.join(f'r_{m} / s_{m} AS t_{m}' for m in margins)},
                 tokens / (SELECT sum(tokens) FROM cells) AS share
          FROM raised, (SELECT {sums}) AS totals),
prev AS (SELECT 0 AS step, {columns}, share FROM start
         UNION ALL SELECT step + 1, {columns}, share FROM {step} AS s WHERE step < {SWEEPS}),
shares AS (SELECT *, share / sum(share) OVER () AS part FROM prev WHERE step = {SWEEPS}),
rates AS (SELECT s.*, {fraction} * s.part * (SELECT sum(tokens) FROM cells) / d.tokens AS rate
          FROM shares AS s JOIN cells AS d ON {keys})
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(coalesce(s.rate, 0), 6) AS rate,
       (floor(coalesce(s.rate, 0)) + CASE WHEN ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0
        < coalesce(s.rate, 0) - floor(coalesce(s.rate, 0)) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM sized AS d LEFT JOIN rates AS s ON {keys}"""


def _words(column: str) -> str:
    """The words by the complement of the separators, A-Z lower-cased alone."""
    lower = f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(regexp_split_to_array({lower}, '{NOT_WORD}'), lambda x: x <> '')"


def decontaminate() -> str:
    """Every window of every item, as joined text, against every window of every document."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, {_words('text')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, list_slice(w, s, s + least(len(w), {WINDOW}) - 1) AS g
       FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - {WINDOW} + 1, 1))) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, s, list_slice(w, s, s + n - 1) AS g
       FROM (SELECT r, n, w, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, item_id, s, dw.n FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
marked AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marked USING (r) LEFT JOIN items USING (r)"""


def top_k() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""


def revisits() -> str:
    from .revisits import PERMITTED, REWRITES

    key = "url"
    for pattern, to in REWRITES:
        key = f"regexp_replace({key}, '{pattern}', '{to}', 'g')"
    permitted = ", ".join(f"'{x}'" for x in PERMITTED)
    return f"""
WITH p AS (SELECT page_id AS i, lower({key}) AS u, '"' || substr(md5(html), 1, 12) || '"' AS tag FROM pages),
r AS (
  SELECT i * 3 AS record_id, true AS is_full, u, i * 10 AS ts, tag AS etag, 'max-age=60' AS cc, 'text/html' AS ct FROM p
  UNION ALL
  SELECT i * 3 + 1, false, u, CASE WHEN i % 7 = 0 THEN i * 10 - 5 ELSE i * 10 + 1000005 END,
         CASE WHEN i % 3 = 0 THEN 'W/' ELSE '' END || tag, 'max-age=120', NULL FROM p
  UNION ALL
  SELECT i * 3 + 2, false, u, i * 10 + 2000007, CASE WHEN i % 11 = 0 THEN NULL WHEN i % 5 = 0 THEN '"changed"' ELSE tag END, 'max-age=180', NULL FROM p),
f AS (SELECT *, last_value(CASE WHEN is_full THEN record_id END IGNORE NULLS) OVER (
        PARTITION BY u ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS response_id FROM r),
j AS (SELECT f.*, o.etag AS old_tag,
        CASE WHEN f.response_id IS NULL THEN 'orphan' WHEN f.etag IS NULL OR o.etag IS NULL THEN 'unverified'
             WHEN regexp_replace(f.etag, '^W/', '') = regexp_replace(o.etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END AS state
      FROM f LEFT JOIN r AS o ON f.response_id = o.record_id WHERE NOT f.is_full)
SELECT record_id, u AS url_key, ts, response_id, state,
       CASE WHEN state = 'resolved' THEN 'cache-control=' || cc || ';content-type=text/html;date=' || ts || ';etag=' || etag END AS headers
FROM j"""


def licences(files: str) -> str:
    from .licences import LEAST_COSINE, LICENCE_FILE, TEMPLATES, TRIGGER

    values = ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())
    return f"""
WITH files AS ({files}),
names(licence, notice) AS (VALUES {values}),
n AS (SELECT count(*) AS n FROM files WHERE path IS NOT NULL AND text IS NOT NULL),
tpl AS (SELECT licence, term, count(*) AS tf FROM (SELECT licence, unnest({_words('notice')}) AS term FROM names) GROUP BY ALL),
has AS (SELECT path, unnest(list_distinct({_words('text')})) AS term FROM files),
df AS (SELECT term, count(*) AS df FROM has GROUP BY term),
tw AS (SELECT licence, tpl.term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + coalesce(df, 0))) + 1) AS w FROM tpl LEFT JOIN df USING (term), n),
tn AS (SELECT licence, sqrt(sum(w * w)) AS norm FROM tw GROUP BY licence),
lines AS (SELECT path, unnest(string_split(text, chr(10))) AS line FROM files
          UNION ALL SELECT path, text FROM files WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '{LICENCE_FILE}')),
units AS (SELECT row_number() OVER () AS unit, path, line FROM lines WHERE regexp_matches(line, '{TRIGGER}')),
tf AS (SELECT unit, path, term, count(*) AS tf FROM (SELECT unit, path, unnest({_words('line')}) AS term FROM units) GROUP BY ALL),
uw AS (SELECT unit, path, tf.term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + coalesce(df, 0))) + 1) AS w FROM tf LEFT JOIN df USING (term), n),
un AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM uw GROUP BY unit),
cs AS (SELECT path, licence, round(sum(uw.w * tw.w / tn.norm) / any_value(un.norm), 6) AS cosine
       FROM uw JOIN tw USING (term) JOIN tn USING (licence) JOIN un USING (unit) GROUP BY unit, path, licence),
own AS (SELECT * FROM cs WHERE cosine >= {LEAST_COSINE} QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, licence) = 1),
declared AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, licence, cosine FROM own WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '{LICENCE_FILE}')
             QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, licence) = 1),
near AS (SELECT f.path, d.dir, d.licence, d.cosine FROM (SELECT DISTINCT path FROM files) AS f JOIN declared AS d ON starts_with(f.path, d.dir || '/')
         QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(d.dir) DESC) = 1)
SELECT f.path, coalesce(own.licence, near.licence) AS licence, coalesce(own.cosine, near.cosine) AS cosine,
       CASE WHEN own.licence IS NOT NULL THEN 'own' WHEN near.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN own.licence IS NULL THEN near.dir END AS declared_in
FROM files AS f LEFT JOIN own ON f.path = own.path LEFT JOIN near ON f.path = near.path"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text: each byte is mixed in, then eight steps of one bit (-1)."""
    steps = ", ".join(["-1"] * 8)
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({text}, ''),
      lambda c: [ascii(c)::BIGINT, {steps}]))),
      lambda x, b: CASE WHEN b >= 0 THEN xor(x, b) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END), 4294967295::BIGINT)"""


def merkle(levels: int = 7, docs: str = "documents") -> str:
    """The trees level by level (a tree that has come to one node stays as it is), then each leaf's path."""
    def field(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [f"""
WITH l AS (SELECT doc_id, source, {leaf('text')} AS leaf,
                  CASE WHEN {_crc32('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS fold FROM {docs}),
t AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM l)),
p0 AS (SELECT doc_id, leaf, fold, tree, '' AS proof,
              row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
       FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source),
n0 AS (SELECT tree, idx, leaf AS hash, count(*) OVER (PARTITION BY tree) AS cnt FROM p0)"""]

    def climb(at: str, to: str, before: str, nodes: str, after: str) -> str:
        return f""",
{after} AS (SELECT tree, idx // 16 AS idx, CASE WHEN any_value(cnt) > 1 THEN sha256(string_agg(hash, '' ORDER BY idx)) ELSE any_value(hash) END AS hash,
       (any_value(cnt) + 15) // 16 AS cnt FROM {nodes} GROUP BY tree, idx // 16),
{before}l AS (SELECT tree, idx // 16 AS run, any_value(cnt) AS cnt, list(hash ORDER BY idx) AS h FROM {nodes} GROUP BY tree, idx // 16),
{to} AS (SELECT doc_id, leaf, p.tree AS tree, idx // 16 AS idx, {'subroot, ' if 'r' in to else ''}
       CASE WHEN cnt > 1 THEN sha256(array_to_string(h[:idx % 16], '') || fold || array_to_string(h[idx % 16 + 2:], '')) ELSE fold END AS fold,
       CASE WHEN cnt > 1 THEN proof || array_to_string(h[:idx % 16], '') || array_to_string(h[idx % 16 + 2:], '') ELSE proof END AS proof
       FROM {at} AS p JOIN {before}l AS s ON p.tree = s.tree AND p.idx // 16 = s.run)"""

    out += [climb(f"p{i}", f"p{i + 1}", f"s{i}", f"n{i}", f"n{i + 1}") for i in range(levels)]
    out.append(f""",
q0 AS (SELECT -1 AS tree, tree AS idx, hash, count(*) OVER () AS cnt FROM n{levels}),
r0 AS (SELECT doc_id, leaf, -1 AS tree, p.tree AS idx, hash AS subroot, fold, proof FROM p{levels} AS p JOIN n{levels} AS n ON p.tree = n.tree)""")
    out += [climb(f"r{i}", f"r{i + 1}", f"v{i}", f"q{i}", f"q{i + 1}") for i in range(levels)]
    out.append(f"""
SELECT doc_id, leaf, subroot, hash AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = hash AS verified
FROM r{levels}, (SELECT hash FROM q{levels})""")
    return "".join(out)
