"""DuckDB SQL for the queries that SQL can express.

The ratio of op1, the filters of op3, the search of op4 and the encoders need
hashes or models that SQL lacks; their tests are in ``tests/llm``.
"""

from __future__ import annotations

OP2 = r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(url, ''), '://[^?#]*\?([^#]*)', 1) AS query
  FROM pages
), tokened AS (
  SELECT *, list_sort(list_distinct(list_concat(
    list_transform(list_filter(string_split(regexp_replace(host, '[0-9]+', '#', 'g'), '.'), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(path), '[0-9]+', '#', 'g'), '[/._-]'), lambda x: x <> ''), lambda x: 'p:' || x),
    list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(query), '[0-9]+', '#', 'g'), '[&=+]'), lambda x: x <> ''), lambda x: 'q:' || x)
  ))) AS tokens FROM parts
), said AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), known AS (
  SELECT row_number() OVER () AS t, tokens, bad FROM tokened JOIN said USING (page_id) WHERE len(tokens) > 0
), least AS (
  SELECT greatest(10, ceil(0.02 * count(*) FILTER (WHERE bad = 1))) AS n, CAST(sum(bad) AS DOUBLE) / count(*) AS p FROM known
), flat AS (SELECT t, bad, unnest(tokens) AS x FROM known
), ones AS (
  SELECT [x] AS items, sum(bad) AS support, count(*) AS seen FROM flat GROUP BY x
), twos AS (
  SELECT [a.x, b.x] AS items, sum(a.bad) AS support, count(*) AS seen FROM flat a JOIN flat b ON a.t = b.t AND a.x < b.x GROUP BY a.x, b.x
), threes AS (
  SELECT [a.x, b.x, c.x] AS items, sum(a.bad) AS support, count(*) AS seen FROM flat a JOIN flat b ON a.t = b.t AND a.x < b.x
    JOIN flat c ON a.t = c.t AND b.x < c.x GROUP BY a.x, b.x, c.x
), rules AS (
  SELECT items FROM (SELECT * FROM ones UNION ALL SELECT * FROM twos UNION ALL SELECT * FROM threes), least
  WHERE support >= least.n AND support / seen >= 0.5 AND support - seen * p >= 3.0 * sqrt(seen * (p * (1 - p)))
), fixed AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
    EXISTS (SELECT 1 FROM rules WHERE list_has_all(tokens, rules.items)) AS mined
  FROM tokened
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN mined THEN 'block' ELSE 'allow' END AS verdict,
  mined
FROM fixed
"""

OP5 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i+3], ' '))) END AS s
  FROM worded
), classes AS (
  SELECT list_sort(s) AS s, len(s) AS n, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY 1, 2
), flat AS (SELECT rep, n, unnest(s) AS x FROM classes
), counted AS (SELECT x, count(*) AS df FROM flat GROUP BY x
), ordered AS (
  SELECT rep, n, x, df, row_number() OVER (PARTITION BY rep ORDER BY df, x) AS pos FROM flat JOIN counted USING (x)
), prefix AS (
  SELECT rep, n, x FROM ordered WHERE pos <= n - (85 * n + 99) // 100 + 1 AND df > 1
), pairs AS (
  SELECT DISTINCT a.rep AS a, b.rep AS b, a.n AS n, b.n AS m FROM prefix a JOIN prefix b ON a.x = b.x AND a.rep < b.rep
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), links AS (
  SELECT a, b FROM pairs JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b
  WHERE 185 * len(list_intersect(x.s, y.s)) >= 85 * (pairs.n + pairs.m)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT rep AS a, rep AS b FROM classes UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a
), named AS (SELECT classes.s, lowest.component_id FROM classes JOIN lowest ON classes.rep = lowest.a)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles,
  CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE named.component_id END AS component_id
FROM sets LEFT JOIN named ON list_sort(sets.s) = named.s
"""

OP8 = r"""
WITH p AS (
  SELECT DISTINCT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, coalesce(CAST(page_id AS VARCHAR), 'null') || '-' || sha256(coalesce(url, '') || chr(10) || coalesce(html, '')) AS record_id FROM pages
), h AS (
  SELECT *, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || record_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
    || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) AS head FROM p
), r AS (
  SELECT *, strlen(head) AS body_at, head || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM h
), k AS (
  SELECT page_id, record_id, body_at, strlen(record) AS length_a, sha256(record) AS digest_a, hex(encode(record)) AS hx FROM r
), d AS (
  SELECT *, CASE WHEN substr(digest_a, 1, 2) <= '0f' THEN substr(hx, 1, 2 * body_at) || CASE WHEN substr(hx, 2 * body_at + 1, 2) = '58' THEN '59' ELSE '58' END || substr(hx, 2 * body_at + 3)
    WHEN substr(digest_a, 1, 2) <= '17' THEN NULL WHEN substr(digest_a, 1, 2) <= '1f' THEN substr(hx, 1, 2 * (length_a - length_a // 3)) ELSE hx END AS hb FROM k
), g AS (
  SELECT page_id, record_id, length_a, digest_a, strlen(hb) // 2 AS length_b, sha256(unhex(hb)) AS digest_b, CAST(floor(page_id / 256) AS BIGINT) AS grp, count(*) OVER (PARTITION BY floor(page_id / 256)) AS n,
    split_part(record_id, '-', -1) AS payload FROM d
), c AS (
  SELECT *, CASE WHEN n > 512 OR grp IS NULL THEN CAST(ceil(n / 256) AS BIGINT) END AS cuts FROM g
), f AS (
  SELECT *, CASE WHEN grp IS NULL THEN 'null' WHEN cuts IS NOT NULL THEN 'cut-' || grp ELSE 'crawl' END AS tree,
    CASE WHEN cuts IS NOT NULL THEN CAST('0x' || substr(payload, 1, 8) AS BIGINT) % cuts ELSE grp END AS number,
    CASE WHEN cuts IS NOT NULL THEN CAST('0x' || substr(payload, 9, 4) AS BIGINT) % 16 ELSE (page_id % 256) // 16 END AS leaf FROM c
), o AS (
  SELECT *, coalesce(sum(length_a) OVER w, 0) AS offset_a, CASE WHEN digest_b IS NOT NULL THEN coalesce(sum(length_b) OVER w, 0) ELSE -1 END AS offset_b FROM f
  WINDOW w AS (PARTITION BY tree, number ORDER BY leaf, page_id NULLS FIRST, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT page_id, record_id, tree || '-' || number AS file, CAST(leaf AS INTEGER) AS leaf, CASE WHEN digest_b IS NULL THEN 'missing' ELSE 'corrupt' END AS status,
  CAST(offset_a AS BIGINT) AS offset_a, CAST(offset_b AS BIGINT) AS offset_b, digest_a, digest_b
FROM o WHERE digest_b IS DISTINCT FROM digest_a
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_rules": OP2, "op5_jaccard_join": OP5, "op8_warc_fixity": OP8}
