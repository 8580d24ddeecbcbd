"""DuckDB SQL of the queries that SQL can express; plain joins and windows, none of the operators' methods."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM windows) WHERE r > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM again),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.i = x.i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g ON g.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages WHERE page_id IS NOT NULL), l AS (SELECT h, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN l ON l.h = p.h"""

NEAR = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS p FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY 1) c ON c.a = d.doc_id"""

CHAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)) + len(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


def _found(kind: int, pattern: str, group: int, keep: str) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {kind} AS kind, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM (
SELECT doc_id, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s, ms[i] AS m, vs[i] AS v
FROM (SELECT doc_id, g, ms, vs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}, 0) AS ms, regexp_extract_all(t, {p}, {group}) AS vs FROM d))) WHERE {keep}"""


_PARTS = [
    _found(0, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, "length(v) >= 6"),
    _found(1, "AKIA[A-Z0-9]+", 0, "length(m) >= 20"),
    _found(2, "[0-9a-f]+", 0, "length(m) >= 24"),
]
_WEAK = [_found(3, "[A-Za-z0-9+/=]+", 0, "length(m) = 40 AND NOT contains(m, '=')"), _found(4, r"""https?://[^\x09-\x0D\x20"'<>]+""", 0, "true")]
_LISTED = "coalesce(string_agg(['assign', 'access', 'hex', 'part', 'endpoint'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e){}, '')"

SECRETS = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED ({" UNION ALL ".join(_PARTS)}),
weak AS MATERIALIZED (SELECT * FROM ({" UNION ALL ".join(_WEAK)}) WHERE doc_id IN (SELECT doc_id FROM base WHERE kind = 1)),
met AS MATERIALIZED (SELECT a.doc_id, a.s AS a_s, w.kind, w.s, w.e FROM base a JOIN (SELECT * FROM weak UNION ALL SELECT * FROM base WHERE kind = 0 AND doc_id IN (SELECT doc_id FROM weak)) w ON a.kind = 1 AND a.doc_id = w.doc_id AND w.s < a.e + 400 AND a.s - 400 < w.e AND (w.e <= a.s OR w.s >= a.e)),
extra AS (SELECT DISTINCT doc_id, kind, s, e FROM met m WHERE kind >= 3 AND EXISTS (SELECT 1 FROM met o WHERE o.doc_id = m.doc_id AND o.a_s = m.a_s AND o.kind IN (0, 3))),
every AS (SELECT * FROM base UNION ALL SELECT doc_id, kind, s, e FROM extra)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, sha256({_LISTED.format(" FILTER (kind < 3)")}) AS base_sha256, {_LISTED.format("")} AS spans
FROM d LEFT JOIN every USING (doc_id) GROUP BY d.doc_id"""


def sql() -> dict[str, str]:
    return {"op1_substring_dedup": SUBSTRING, "op4_warc_chain": WARC, "op6_minhash_dedup": NEAR, "op7_chat_round_trip": CHAT, "op10_secret_linking": SECRETS}
