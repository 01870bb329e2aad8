"""DuckDB SQL for the results that SQL can express, written from the operators' rules."""

from __future__ import annotations

from .mixing import POWER, ROUNDS

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
WINDOW same AS (PARTITION BY h)
"""


def mixing(power: float = POWER, rounds: int = ROUNDS, docs: str = "documents") -> str:
    steps, last = [], "cells"
    for k in range(rounds):
        for dim in ("source", "lang", "topic"):
            name = f"w{k}_{dim}"
            steps.append(f"{name} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.weight * (g.target / sum(c.weight) OVER (PARTITION BY c.{dim})) AS weight FROM {last} c JOIN goal_{dim} g ON g.{dim} = c.{dim})")
            last = name
    goals = ",\n".join(f"goal_{dim} AS MATERIALIZED (SELECT {dim}, pow(sum(tokens)::DOUBLE, {power}) AS target FROM cells GROUP BY {dim})" for dim in ("source", "lang", "topic"))
    return f"""
WITH placed AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
    CASE WHEN text IS NULL OR text = '' THEN 'empty'
         WHEN contains(text, ' | ') THEN 'table'
         WHEN contains(text, '***') OR contains(text, '###') THEN 'symbols'
         WHEN contains(text, '!! ') THEN 'shout'
         WHEN contains(text, 'icense') THEN 'license'
         WHEN strlen(text) < 500 THEN 'short'
         WHEN strlen(text) > 20000 THEN 'long' ELSE 'prose' END AS topic,
    1 + length(regexp_replace(coalesce(text, ''), '[^ \\n]', '', 'g')) AS tokens
  FROM {docs}),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE AS weight FROM placed GROUP BY ALL),
{goals},
{','.join(steps)},
chances AS (SELECT source, lang, topic, round(weight / tokens / (SELECT max(weight / tokens) FROM {last}), 9) AS probability FROM {last})
SELECT p.doc_id, p.source, p.lang, p.topic, p.tokens, c.probability,
       ('0x' || substr(md5('mix:' || coalesce(p.doc_id::VARCHAR, '')), 1, 12))::BIGINT / pow(16, 12) < c.probability AS kept
FROM placed p JOIN chances c USING (source, lang, topic)
"""

VECTOR_SEARCH = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) DESC, c.vec_id) AS rank
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
WHERE rank <= 20
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH docs AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS u, {_LETTERS} AS ws FROM documents),
items AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS item, {_LETTERS} AS ws FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item, least(len(ws), 10) AS size, array_to_string(ws[k : k + 9], ' ') AS gram
  FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k FROM items WHERE len(ws) > 0)),
places AS (
  SELECT u, size, k, array_to_string(ws[k : k + size - 1], ' ') AS gram
  FROM (SELECT u, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM docs, (SELECT DISTINCT size FROM windows))),
found AS MATERIALIZED (SELECT p.u, p.k, p.size, w.item FROM places p JOIN windows w ON p.gram = w.gram AND p.size = w.size),
hit AS (SELECT u, count(DISTINCT i) AS n_hit FROM (SELECT u, unnest(range(k, k + size)) AS i FROM found) GROUP BY u),
named AS (SELECT u, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT u, item FROM found WHERE item IS NOT NULL) GROUP BY u)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h ON h.u = d.u LEFT JOIN named n ON n.u = d.u
"""

_GRAMS = "\n  UNION ALL ".join(f"SELECT lang, array_to_string(ws[k : k + {size - 1}], ' ') AS g, {size} AS size FROM words WHERE k + {size - 1} <= len(ws)" for size in range(1, 6))

COLLOCATIONS = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
cut AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
words AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS k FROM cut),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM cut GROUP BY lang),
f AS MATERIALIZED (SELECT lang, g, size, count(*) AS c FROM (
  {_GRAMS}) GROUP BY ALL HAVING count(*) >= 100),
cands AS MATERIALIZED (SELECT lang, g, size, c, string_split(g, ' ') AS ws FROM f WHERE size > 1),
inner_parts AS (
  SELECT DISTINCT lang, array_to_string(ws[i : i + len - 1], ' ') AS g, c
  FROM (SELECT *, unnest(range(1, size - len + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS len FROM cands))),
covered AS (SELECT DISTINCT p.lang, p.g FROM inner_parts p JOIN f ON f.lang = p.lang AND f.g = p.g WHERE 100 * p.c >= 100 * f.c),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM cands),
scored AS (
  SELECT x.lang, x.g, x.c AS a, l.c AS l, r.c AS r, t.n, x.k,
         CAST((1000 * CAST(x.c AS HUGEINT) * t.n) // (CAST(l.c AS HUGEINT) * r.c) AS BIGINT) AS score
  FROM cuts x JOIN totals t ON t.lang = x.lang
  JOIN f l ON l.lang = x.lang AND l.g = array_to_string(x.ws[1 : x.k], ' ')
  JOIN f r ON r.lang = x.lang AND r.g = array_to_string(x.ws[x.k + 1 : x.size], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM lowest ANTI JOIN covered USING (lang, g))
SELECT lang, CAST(rank AS BIGINT) AS rank, g AS phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
