"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH kinds(kind, ord, re) AS (VALUES
  ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), ('ip', 1, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), ('card', 2, '[0-9](?:[ -]?[0-9])+'),
  ('phone', 3, '\+[0-9][ ().0-9-]+[0-9]'), ('iban', 4, '\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b'), ('ssn', 5, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b'),
  ('key', 6, '\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{9,}[A-Za-z0-9]|sk-[A-Za-z0-9_-]{19,}[A-Za-z0-9_])\b|-----BEGIN (?:[A-Z ]* )?PRIVATE KEY-----'),
  ('secret', 7, '\b(?:[Aa][Pp][Ii][ _-]?[Kk][Ee][Yy]|[Aa]ccess[ _-]?[Kk]ey|ACCESS_KEY|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Pp]assw(?:or)?d|PASSWORD|[Pp]wd)["'']?[ \t]*[:=][ \t]*["'']?[^\x00-\x20"''<>,;#]{8,}')
), texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), cut AS (SELECT doc_id, kind, ord, t, regexp_extract_all(t, re) AS m, string_split_regex(t, re) AS p FROM texts, kinds WHERE regexp_matches(t, re)
), spans AS (
  SELECT doc_id, kind, ord, t, x, translate(x, ' -', '') AS d, s, s + length(x) AS e FROM (
    SELECT doc_id, kind, ord, t, m[i] AS x, CAST(list_sum([length(y) for y in p[1:i]]) + coalesce(list_sum([length(y) for y in m[1:i - 1]]), 0) AS BIGINT) AS s
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM cut))
), valid AS (
  SELECT doc_id, kind, ord, s, e FROM spans WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN coalesce(list_max([try_cast(y AS HUGEINT) for y in string_split(x, '.')]) <= 255, false)
    WHEN 'card' THEN length(d) BETWEEN 12 AND 19 AND list_sum([CASE WHEN (length(d) - j) % 2 = 0 THEN CAST(d[j] AS INT) ELSE (CAST(d[j] AS INT) * 2) // 10 + (CAST(d[j] AS INT) * 2) % 10 END for j in range(1, length(d) + 1)]) % 10 = 0
    WHEN 'phone' THEN length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15
    WHEN 'iban' THEN list_reduce([0] || [ascii(c) for c in string_split(substr(d, 5) || substr(d, 1, 4), '')], lambda a, b: CASE WHEN b < 58 THEN a * 10 + b - 48 ELSE a * 100 + b - 55 END % 97) = 1
    WHEN 'key' THEN true
    WHEN 'secret' THEN regexp_matches(x, '[0-9]') OR regexp_matches(lower(x), '^(passw|pwd)')
    ELSE regexp_matches(lower(t[greatest(s - 39, 1):s] || ' ' || t[e + 1:e + 40]), '\b(ssn|social security)\b') END
), sums AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, count(*) AS n_spans,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans
  FROM valid GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN sums USING (doc_id)
"""

OP3 = r"""
WITH word_lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM item_windows
), doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM word_lists, sizes WHERE len(w) >= n)
), found AS (SELECT d.doc_id, d.i, d.n, x.item_id FROM doc_windows d JOIN item_windows x USING (n, win)
), hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM word_lists LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP4 = r"""
WITH lines AS (
  SELECT doc_id, line, pos, CASE WHEN length(key) >= 20 THEN key END AS key FROM (
    SELECT doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))
), keys AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE key IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.keeper AS gone FROM lines l LEFT JOIN keys k USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP5 = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + 2 * length(role) - length(translate(role, '\<#' || chr(10), '')) + 2 * length(text) - length(translate(text, '\<#', ''))) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""


OP10 = r"""
WITH RECURSIVE word_lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM word_lists WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)
), ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (SELECT DISTINCT x AS a, x AS b FROM ways UNION SELECT a, y FROM reach JOIN ways ON b = x
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

_FINE = "embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)) for x in embedding] || [true])"


def _whole(scale: int) -> str:
    """The components as whole numbers."""
    return f"[CAST(greatest(least(floor({scale} * CAST(x AS DOUBLE)), 67108864), -67108864) AS BIGINT) for x in embedding]"


OP12 = f"""
WITH own AS (
  SELECT vec_id, min({{'label': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, 'v': embedding}}) AS r
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINE} GROUP BY vec_id
), rows_ AS (SELECT vec_id, r.label AS label, {_whole(256).replace("embedding", "r.v")} AS q FROM own
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same,
    CAST(coalesce(list_sum([coalesce(z[1] * z[2], 0) for z in list_zip(a.q, r.q)]), 0) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def _rounds(n: int) -> str:
    """Assignments a0 to a``n`` of points ``p``, each to centroids of its number, and those centroids."""
    out = []
    for i in range(n + 1):
        out.append(f"""a{i} AS MATERIALIZED (
  SELECT n, any_value(vec_id) AS vec_id, any_value(p.q) AS q, min({{'d': CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.q, c.q)]) AS BIGINT), 'c': cluster}}) AS m FROM p, c{i} c GROUP BY n
)""")
        if i < n:
            out.append(f"""s{i} AS (SELECT cluster, j, sum(x) AS s, count(*) AS k FROM (SELECT m.c AS cluster, unnest(q) AS x, unnest(range(1, len(q) + 1)) AS j FROM a{i}) GROUP BY cluster, j
), c{i + 1} AS MATERIALIZED (
  SELECT cluster, list(CAST((s - (s % k + k) % k) // k AS BIGINT) ORDER BY j) AS q FROM s{i} GROUP BY cluster
  UNION ALL SELECT cluster, q FROM c{i} WHERE cluster NOT IN (SELECT cluster FROM s{i})
)""")
    return ", ".join(out)


OP13 = f"""
WITH p AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, embedding, {_whole(64)} AS q FROM embeddings WHERE {_FINE} AND len(embedding) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, embedding) - 1 AS cluster, q FROM (SELECT sha256('1:' || vec_id) AS h, embedding, q FROM p WHERE vec_id IS NOT NULL ORDER BY h, embedding LIMIT 16)
), {_rounds(3)}
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON m.c = c3.cluster
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_pii": OP1, "op5_chat_format": OP5, "op3_decontamination": OP3, "op4_line_dedup": OP4, "op10_near_dedup": OP10, "op12_hard_negatives": OP12, "op13_centroids": OP13}
