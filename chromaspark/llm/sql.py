"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

CHAT = """
WITH t AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY pos) AS seq,
         string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>', chr(10) ORDER BY pos) AS rendered
  FROM t GROUP BY conv_id
), k AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, seq, any_value(rendered) AS rendered FROM c GROUP BY seq, n_turns
), p AS (
  SELECT DISTINCT list_slice(seq, 1, x.i) AS seq FROM c, LATERAL (SELECT unnest(range(1, n_turns)) AS i) x
)
SELECT conv_id, n_turns, n_copies, rendered FROM k WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.seq = k.seq)
"""

URLS = r"""
WITH u AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 7919) % 360 AS INT) AS fetched_on,
         regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://', ''), '[?#].*$', '') AS raw
  FROM pages
), b AS (
  SELECT page_id, fetched_on,
         regexp_replace(regexp_replace(regexp_replace(split_part(raw, '/', 1), '^.*@', ''), ':\d*$', ''), '\.+$', '') AS host,
         regexp_replace(regexp_replace(raw, '^[^/]*', ''), '/+$', '') AS path
  FROM u
), pat AS (
  SELECT DISTINCT 'hosts' AS list, 'domain:' || regexp_replace(host, '^(www|m|blog)\.', '') AS pattern FROM b
  UNION ALL SELECT DISTINCT 'pages', 'path:' || host || path FROM b
), h AS (
  SELECT list, pattern, CAST('0x' || substr(md5(pattern), 1, 8) AS BIGINT) AS h FROM pat
), spans AS (
  SELECT list, pattern, DATE '2024-01-01' + CAST(h % 200 AS INT) AS since,
         DATE '2024-01-01' + CAST(h % 200 + 30 + h % 61 AS INT) AS until
  FROM h WHERE (list = 'hosts' AND h % 5 = 0) OR (list = 'pages' AND h % 20 = 0)
  UNION ALL
  SELECT list, pattern, DATE '2024-01-01' + CAST(h % 200 + 120 AS INT), DATE '9999-12-31'
  FROM h WHERE h % 3 = 0 AND ((list = 'hosts' AND h % 5 = 0) OR (list = 'pages' AND h % 20 = 0))
), asked AS (
  SELECT page_id, fetched_on, 'domain:' || array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS pattern
  FROM b, LATERAL (SELECT unnest(range(1, len(string_split(host, '.')) + 1)) AS i)
  UNION
  SELECT page_id, fetched_on, 'path:' || array_to_string(list_slice(string_split(host || path, '/'), 1, i), '/')
  FROM b, LATERAL (SELECT unnest(range(1, len(string_split(host || path, '/')) + 1)) AS i)
), met AS (
  SELECT a.page_id, count(*) AS hits, min({'l': list, 'p': s.pattern, 's': since, 'u': until}) AS m
  FROM asked a JOIN spans s ON a.pattern = s.pattern AND a.fetched_on >= s.since AND a.fetched_on < s.until GROUP BY a.page_id
)
SELECT b.page_id, CAST(b.fetched_on AS VARCHAR) AS fetched_on, coalesce(hits, 0) > 0 AS blocked, coalesce(hits, 0) AS hits, m.l AS list_name, m.p AS pattern,
       CAST(m.s AS VARCHAR) AS since, CAST(m.u AS VARCHAR) AS until
FROM b LEFT JOIN met ON b.page_id = met.page_id
"""


def oracles() -> dict[str, str]:
    return {"op3_chat_format": CHAT, "op4_url_lists": URLS}
