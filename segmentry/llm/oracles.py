"""DuckDB SQL that gives the rows of queries that SQL can express, over tables of unique doc_ids."""

from __future__ import annotations

import string

_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_PLAIN = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_PLAIN}') AS w FROM documents),
k AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 20], ' ') AS x FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 19, 0))) AS s FROM d)),
f AS (SELECT x, min((doc_id, s)) AS place FROM k GROUP BY x HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, s + unnest(range(0, 20)) AS p FROM (SELECT k.doc_id, k.s FROM k JOIN f ON k.x = f.x WHERE (k.doc_id, k.s) <> f.place)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
kept AS (SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.p) AS text FROM word a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.p = a.p WHERE g.p IS NULL GROUP BY a.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_ALNUM}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(coalesce({_LOWER}, ''), '{_ALNUM}') AS w FROM benchmark),
i AS (SELECT DISTINCT item, n, array_to_string(w[s + 1 : s + n], ' ') AS x FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)),
k AS (SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS s FROM d, (SELECT DISTINCT n FROM i))),
m AS (SELECT k.doc_id, k.s, k.n, i.item FROM k JOIN i ON i.n = k.n AND i.x = k.x),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_PLAIN}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 3, 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM o JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * o >= 85 * (a.n + b.n - o)),
r AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.v, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT u, min(v) AS v FROM r GROUP BY u) c ON c.u = d.doc_id
"""
