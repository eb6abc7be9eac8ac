"""SQL for DuckDB of those operators that SQL can express in whole."""

from __future__ import annotations

from .decontam import MIN_ITEMS, WINDOW
from .licenses import LINES, PHRASES, TEMPLATES, THRESHOLD

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATION = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS k, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM iw))),
hit AS (SELECT doc_id, i, dw.k, item FROM dw JOIN iw ON dw.k = iw.k AND dw.s = iw.s),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_items, 0) >= {MIN_ITEMS} AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id"""

_LABELS = ", ".join(f"CASE WHEN len(list_filter(five, lambda f: starts_with(f, '{p} '))) > 0 THEN '{v}' END" for p, v in PHRASES.items())
_TEMPLATES = ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())

LICENSES = f"""
WITH d AS (SELECT doc_id, text, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents),
p AS (SELECT doc_id, text, len(w) AS n_words, list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + 3], ' ') || ' ') AS five FROM d),
q AS (SELECT doc_id, text, n_words, list_filter(range(0, n_words), lambda i: list_contains([{', '.join(f"starts_with(five[i + 1], '{p} ')" for p in PHRASES)}], true)) AS places,
  list_filter([{_LABELS}], lambda x: x IS NOT NULL) AS base FROM p),
s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, list_distinct(regexp_extract_all({_LOW}, {_ALNUM})) AS held FROM (SELECT doc_id, array_to_string(lines[i:i + k], chr(10)) AS text FROM (SELECT doc_id, lines, k, unnest(range(1, len(lines) + 1)) AS i FROM s, (SELECT unnest(range(0, {LINES})) AS k)))),
t AS (SELECT label, list_distinct(string_split(said, ' ')) AS tokens FROM (VALUES {_TEMPLATES}) v(label, said)),
m AS (SELECT doc_id, label, len(list_intersect(held, tokens)) / len(tokens) AS share FROM l, t WHERE len(list_intersect(held, tokens)) >= ceil({THRESHOLD} * len(tokens) - 1e-9)),
g AS (SELECT doc_id, list(label) AS added, max(share) AS best FROM m GROUP BY 1)
SELECT q.doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(added, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM q LEFT JOIN g ON q.doc_id = g.doc_id"""


def _removed(make: str, window: int, size: str, kept: str, more: str) -> str:
    """Windows that start in an earlier document too, merged to runs, and what is left between the runs.

    make: (doc_id, n, at, win) of each window, kept: the piece from a to b, as a list of its parts.
    """
    return f"""
WITH d AS ({make}), w AS (SELECT doc_id, unnest(range(0, n - {window - 1})) AS p, src FROM d WHERE n >= {window}),
s AS (SELECT doc_id, p, {kept.format(a='p', b=f'p + {window}')} AS win FROM w),
f AS (SELECT win, min(doc_id) AS m FROM s GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM s JOIN f ON s.win = f.win WHERE m < doc_id),
r AS (SELECT doc_id, min(p) AS a, max(p) + {window} AS b FROM (SELECT *, sum((before IS NULL OR p > before + {window})::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g) GROUP BY doc_id, run),
e AS (SELECT doc_id, a, b, b - a AS size FROM r UNION ALL SELECT doc_id, n, n, 0 FROM d),
k AS (SELECT doc_id, a, size, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS c FROM e),
o AS (SELECT k.doc_id, a, size, {kept.format(a='c', b='a')} AS piece FROM k JOIN d ON k.doc_id = d.doc_id)
SELECT d.doc_id, n::BIGINT AS {size}, sum(o.size)::BIGINT AS n_removed{more} FROM d JOIN o ON d.doc_id = o.doc_id GROUP BY d.doc_id, n"""


BLOCKS = _removed(
    r"SELECT doc_id, len(w) AS n, w AS src FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)",
    50, "n_words", "array_to_string(src[{a} + 1:{b}], ' ')", ", sha256(coalesce(array_to_string(list(piece ORDER BY a) FILTER (piece <> ''), ' '), '')) AS kept_sha256",
)
SUFFIX = _removed(
    "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS src FROM documents",
    50, "n_bytes", "substr(src, 2 * ({a}) + 1, 2 * (({b}) - ({a})))", ", count(*) FILTER (o.size > 0) AS n_spans, sha256(unhex(string_agg(piece, '' ORDER BY a))) AS kept_sha256",
)
