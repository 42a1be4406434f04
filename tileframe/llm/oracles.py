"""SQL for the queries that SQL can express: raking is a recursion over cells, a dimension at each step."""

from __future__ import annotations

from .mixing import KEEP, LANGS, OTHER, ROUNDS, SCALINGS, SOURCES, TOPICS


def _targets() -> str:
    rows = [(d, k, v) for d, t in enumerate((SOURCES, LANGS, TOPICS)) for k, v in t.items()]
    return ", ".join(f"({d}, '{k}', {v!r}::DOUBLE)" for d, k, v in rows)


def _named(column: str, known: dict[str, float]) -> str:
    return f"CASE WHEN {column} IN ({', '.join(repr(k) for k in known)}) THEN {column} ELSE '{OTHER}' END"


MIXING = f"""
WITH RECURSIVE target(d, k, share) AS (VALUES {_targets()}),
tok AS (SELECT doc_id, text, source, lang, coalesce(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')), 0)::BIGINT AS tokens FROM documents),
doc AS (SELECT doc_id, tokens, {_named("source", SOURCES)} AS source, {_named("lang", LANGS)} AS lang,
  CASE WHEN contains(text, 'Licensed under') OR contains(text, 'License') THEN 'licensed' WHEN tokens < 150 THEN 'brief' WHEN tokens < 1000 THEN 'article' ELSE 'longform' END AS topic FROM tok),
cell AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS n FROM doc GROUP BY ALL),
present AS MATERIALIZED (SELECT d, sum(share) AS total FROM target WHERE (d, k) IN (SELECT (0, source) FROM cell WHERE n > 0 UNION SELECT (1, lang) FROM cell WHERE n > 0 UNION SELECT (2, topic) FROM cell WHERE n > 0) GROUP BY d),
raked(step, source, lang, topic, n, w) AS (
  SELECT 0, source, lang, topic, n, 1.0::DOUBLE FROM cell
  UNION ALL
  SELECT step + 1, source, lang, topic, n, w * total_n * coalesce(t.share, 0) / p.total / now FROM (
    SELECT *, step % 3 AS d, CASE step % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE topic END AS k,
      sum(n * w) OVER (PARTITION BY CASE step % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE topic END) AS now, sum(n) OVER () AS total_n FROM raked) r
  LEFT JOIN target t ON t.d = r.d AND t.k = r.k JOIN present p ON p.d = r.d WHERE step < {3 * ROUNDS}),
final AS MATERIALIZED (SELECT * FROM raked WHERE step = {3 * ROUNDS}),
scaling(step, scale) AS (
  SELECT 0, {KEEP}::DOUBLE
  UNION ALL
  SELECT s.step + 1, s.scale * {KEEP} * sum(n) / sum(n * least(1.0, s.scale * w)) FROM scaling s, final f WHERE s.step < {SCALINGS} GROUP BY s.step, s.scale)
SELECT doc_id, source, lang, topic, tokens, round(w, 6) AS weight, round(least(1.0, scale * w), 6) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':7'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < least(1.0, scale * w) AS kept
FROM doc JOIN final USING (source, lang, topic), (SELECT scale FROM scaling WHERE step = {SCALINGS})
"""

SQL: dict[str, str] = {"op4_mixing": MIXING}
