"""The same results in DuckDB's SQL, for the operators that SQL can express."""

from __future__ import annotations

from refloom.llm.common import LOWER, UPPER
from refloom.llm.licenses import COVERAGE, GAP, K, TEMPLATES, WIDTH

WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every window of every document is held against every window of the benchmark, without fingerprints.
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

_VALUES = ", ".join(f"({i}, '{label}', {str(base).lower()}, '{phrase}')" for i, (label, base, phrase) in enumerate(TEMPLATES))
LICENSES = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), t AS (SELECT id, label, base, string_split(phrase, ' ') AS p FROM (VALUES {_VALUES}) v(id, label, base, phrase)),
tg AS (SELECT id, label, base, len(p) - {K - 1} AS grams, i AS place, list_slice(p, i, i + {K - 1}) AS g FROM (SELECT *, unnest(range(1, len(p) - {K - 2})) AS i FROM t)),
dg AS (SELECT doc_id, i AS word, list_slice(w, i, i + {K - 1}) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {K - 2})) AS i FROM d WHERE len(w) >= {K})),
vote AS (SELECT DISTINCT doc_id, id, label, base, grams, word, word - place AS diagonal, place FROM dg JOIN tg ON dg.g = tg.g),
line AS (SELECT DISTINCT doc_id, id, base, diagonal FROM vote),
open AS (SELECT *, CASE WHEN base OR lag(diagonal) OVER w IS NULL OR diagonal - lag(diagonal) OVER w > {GAP} THEN 1 ELSE 0 END AS opens FROM line WINDOW w AS (PARTITION BY doc_id, id ORDER BY diagonal)),
isle AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, id ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS island FROM open),
part AS (SELECT *, (diagonal - min(diagonal) OVER (PARTITION BY doc_id, id, island)) // {WIDTH + 1} AS part FROM isle),
ordered AS (SELECT v.*, p.island, p.part, coalesce(v.place > max(v.place) OVER (PARTITION BY v.doc_id, v.id, p.island, p.part ORDER BY v.word, v.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS counts
 FROM vote v JOIN part p ON v.doc_id = p.doc_id AND v.id = p.id AND v.diagonal = p.diagonal),
span AS (SELECT doc_id, label, base, min(diagonal) AS start, count(*) FILTER (counts) / CAST(any_value(grams) AS DOUBLE) AS share
 FROM ordered GROUP BY doc_id, id, label, base, island, part HAVING count(*) FILTER (counts) >= CASE WHEN base THEN any_value(grams) ELSE {COVERAGE} * any_value(grams) END),
found AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
 string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
 coalesce(labels, '') AS labels, coalesce(score, CAST(0 AS DOUBLE)) AS score FROM d LEFT JOIN found ON found.doc_id = d.doc_id
"""
