"""DuckDB SQL for the operators whose rows SQL can express, over the table `documents`."""

from __future__ import annotations

from . import hard_negatives, minhash_dedup, quality, vector_codes

_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS} AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM w, unnest(range(1, len(words) - 1)) AS u(i)),
repeats AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
cover AS (SELECT rid, count(DISTINCT i + j) AS n FROM repeats, (VALUES (0), (1), (2)) AS o(j) GROUP BY rid),
counts AS (
  SELECT doc_id, host, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN cover USING (rid)),
rules AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts),
hosts AS (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS f FROM rules GROUP BY host),
moments AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS square, count(*) / sum(1 / n) AS typical FROM hosts),
prior AS (
  SELECT m, greatest(coalesce(m * (1 - m) / nullif(greatest(square - m * m - m * (1 - m) / typical, m * (1 - m) / 1000), 0) - 1, 1), 1) AS s
  FROM moments),
beta AS (SELECT host, f + m * s AS a, n - f + (1 - m) * s AS b FROM hosts, prior),
verdicts AS (
  SELECT host, a / (a + b) AS rate, a / (a + b) - {quality.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {quality.MAX_HOST_RATE} AS host_rejected
  FROM beta)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, {quality.RATE_DIGITS}) AS host_rate,
  host_rejected, NOT base_failed AND NOT host_rejected AS kept
FROM rules AS r JOIN verdicts AS v ON r.host IS NOT DISTINCT FROM v.host
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, {_WORDS} AS words FROM d),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s
  FROM w, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS u(i) WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes AS p ON p.doc_id = a JOIN sizes AS q ON q.doc_id = b
  WHERE 100 * x >= {minhash_dedup.PERCENT} * (p.n + q.n - x)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, s.b FROM reach AS r JOIN steps AS s ON s.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""

#: Spans are islands of covered bytes: a start more than 200 bytes after the one before it begins a new one.
SUFFIXES = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS t FROM documents),
starts AS (SELECT rid, i, hash(t[i:i + 199]) AS h, md5(t[i:i + 199]) AS m FROM d, unnest(range(1, octet_length(t) - 198)) AS u(i)),
repeats AS (SELECT rid, i FROM starts QUALIFY count(*) OVER (PARTITION BY h, m) > 1),
begun AS (SELECT rid, i, coalesce(i > 200 + lag(i) OVER (PARTITION BY rid ORDER BY i), true) AS fresh FROM repeats),
islands AS (SELECT rid, i, sum(fresh::INT) OVER (PARTITION BY rid ORDER BY i) AS k FROM begun),
spans AS (SELECT rid, k, min(i) AS a, max(i) + 200 AS z FROM islands GROUP BY rid, k),
removed AS (SELECT rid, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid),
gaps AS (
  SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 1) AS a, a - 1 AS z FROM spans
  UNION ALL SELECT d.rid, coalesce(max(s.z), 1), octet_length(any_value(t)) FROM d LEFT JOIN spans AS s ON s.rid = d.rid GROUP BY d.rid),
kept AS (SELECT rid, string_agg(hex(t[a:z]), '' ORDER BY a) AS kept FROM gaps JOIN d USING (rid) WHERE z >= a GROUP BY rid)
SELECT doc_id, octet_length(t) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN removed USING (rid) LEFT JOIN kept USING (rid)
"""


def _vector_codes() -> str:
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES
    steps = [
        f"""v AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT rid, part, len(q) // {parts} AS w, q[part * (len(q) // {parts}) + 1 : (part + 1) * (len(q) // {parts})] AS x FROM v, range({parts}) AS r(part))",
        f"b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x AS e FROM p WHERE rid <= {entries})",
    ]
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT rid, part, any_value(x) AS x, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT rid, p.part, x, entry, list_sum(list_transform(range(1, w + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i]))) AS d FROM p JOIN b{k} USING (part)) GROUP BY rid, part)""")
        if k < vector_codes.ROUNDS:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT part, entry, list(m ORDER BY i) AS e FROM (SELECT part, entry, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM a{k}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY part, entry, i) GROUP BY part, entry
  UNION ALL SELECT part, entry, e FROM b{k} ANTI JOIN a{k} USING (part, entry))""")
    chain = ",\n".join(steps)
    return f"""
WITH {chain},
digest AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{vector_codes.ROUNDS}),
coded AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{vector_codes.ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN coded USING (rid), digest"""


VECTOR_CODES = _vector_codes()

#: Every row against every anchor, in full.
HARD_NEGATIVES = f"""
WITH u AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % {hard_negatives.LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, q) = 1),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_sum(list_transform(range(1, len(r.q) + 1), lambda i: a.q[i] * r.q[i]))::BIGINT AS score
  FROM r JOIN r AS a ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {hard_negatives.KEEP})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {hard_negatives.LEAST_PERCENT} * positive_score <= 100 * score AND 100 * score <= {hard_negatives.MOST_PERCENT} * positive_score QUALIFY rank <= {hard_negatives.KEEP}
"""
