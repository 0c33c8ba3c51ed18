"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORD = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
k AS (SELECT doc_id, s, w[s:s + 19] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM k) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM late) GROUP BY 1),
flat AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT f.doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM flat f
         ANTI JOIN (SELECT doc_id, unnest(g) AS p FROM gone) r ON r.doc_id = f.doc_id AND r.p = f.p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {A_Z}), {ALNUM}) AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n
      FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {A_Z}), {ALNUM}) AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, w[s:s + n - 1] AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM b)),
occ AS (SELECT doc_id, s, n, w[s:s + n - 1] AS k
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win))),
m AS (SELECT doc_id, s, occ.n, item_id FROM occ JOIN win USING (k)),
hit AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY 1),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS i FROM m GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(i), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(i, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {A_Z}), {WORD}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, w[s:s + 4] AS k
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS s FROM d)),
n AS (SELECT doc_id, COUNT(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, b.y FROM reach r JOIN edges b ON b.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, MIN(y) AS component_id FROM reach GROUP BY 1) c USING (doc_id)"""
