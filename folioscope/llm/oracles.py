"""DuckDB SQL for the queries of this subpackage that SQL can state."""

from __future__ import annotations

#: crc32 of an ASCII string, byte by byte over a table worked out from the polynomial.
CRC = """
crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i,0,0,0,0,0,0,0,0], lambda c, z:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab)"""


def crc32(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(
      string_split({text}, ''), lambda x: unicode(x)::BIGINT)),
      lambda c, b: xor(tab[(xor(c, b) % 256) + 1], c // 256)), 4294967295)"""


_BLANK = "NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]')"

DIALOGUE_REPAIR = f"""
WITH RECURSIVE {CRC},
damaged AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations, crc),
rows_after AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM damaged WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS seen,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM rows_after),
faults AS (
  SELECT *, CASE WHEN {_BLANK} THEN 'blank' WHEN seen THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated'
    ELSE 'none' END AS fault
  FROM numbered),
inserts(state, tail, paid, place, lines) AS (VALUES
  (0,'',0,0,''),(0,'I',2,2,'u'),(0,'II',4,3,'ua'),(1,'',0,1,''),(1,'I',2,2,'u'),(1,'II',4,3,'ua'),
  (2,'',0,2,''),(2,'I',2,3,'a'),(2,'II',4,2,'au'),(3,'',0,3,''),(3,'I',2,2,'u'),(3,'II',4,3,'ua')),
moves(place, initial, after) AS (VALUES (0,'s',1),(0,'u',2),(1,'u',2),(2,'a',3),(3,'u',2)),
edits(place, edit, initial, after) AS (
  SELECT place, 'K', initial, after FROM moves
  UNION ALL SELECT DISTINCT place, 'D', NULL, place FROM inserts
  UNION ALL SELECT DISTINCT place, 'R', NULL, CASE WHEN place = 2 THEN 3 ELSE 2 END FROM inserts),
steps AS (
  SELECT state, tail || edit AS tail, edit, initial, after, lines,
    paid + CASE edit WHEN 'K' THEN 0 WHEN 'R' THEN 2 ELSE 3 END AS cost
  FROM inserts JOIN edits USING (place)),
ways AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, 0 AS state,
    {{'cost': 0, 'audit': '', 'body': ''}} AS way FROM conversations
  UNION ALL
  SELECT w.conv_id, r.n, s.after, min({{
    'cost': w.way.cost + s.cost + CASE WHEN r.fault = 'truncated' AND s.edit <> 'D' THEN 1 ELSE 0 END,
    'audit': w.way.audit || s.tail,
    'body': w.way.body || replace(replace(s.lines, 'a', chr(10) || 'assistant:'), 'u', chr(10) || 'user:')
      || CASE s.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text
         ELSE chr(10) || CASE s.after WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text END}})
  FROM ways w JOIN faults r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1
    JOIN steps s ON s.state = w.state AND (s.edit <> 'K' OR s.initial = r.role[1])
      AND (s.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
  GROUP BY 1, 2, 3),
ends AS (
  SELECT w.conv_id, min({{'cost': w.way.cost + i.paid, 'audit': w.way.audit || i.tail,
    'body': w.way.body || replace(replace(i.lines, 'a', chr(10) || 'assistant:'), 'u', chr(10) || 'user:')}}) AS way
  FROM ways w JOIN inserts i ON i.state = w.state AND i.place IN (0, 3)
  LEFT JOIN (SELECT conv_id, max(n) AS last FROM faults GROUP BY 1) m
    ON m.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE w.n = coalesce(m.last, 0) GROUP BY 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL
      AND coalesce(before[1], '') || coalesce(role[1], '') NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY 1)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, e.way.cost::BIGINT AS cost, e.way.audit AS audit,
  sha256(substr(e.way.body, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

_WORD = "[^\\x20\\x09-\\x0D]+"


def closure(links: str) -> str:
    """`component`: id and the smallest id reachable over `links` (a, b in both orders)."""
    return f"""
reach(id, other) AS (
  SELECT a, b FROM {links}
  UNION SELECT r.id, l.b FROM reach r JOIN {links} l ON l.a = r.other),
component AS (SELECT id, min(least(id, other)) AS smallest FROM reach GROUP BY id)"""


NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
-- Copies of one set meet once, by a digest of the whole set.
sets AS (SELECT doc_id, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS digest FROM shingles GROUP BY 1),
stands AS (SELECT digest, min(doc_id) AS stand FROM sets GROUP BY 1),
single AS (SELECT s.* FROM shingles s JOIN stands ON stand = doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM single a JOIN single b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)
  UNION ALL SELECT stand, doc_id FROM sets JOIN stands USING (digest) WHERE stand < doc_id),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
{closure("links")}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(smallest, doc_id) AS component_id,
  doc_id = coalesce(smallest, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN component ON id = doc_id
"""

HOST_RULES = f"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) > 4)),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (
    SELECT doc_id, i, unnest(range(5)) AS k FROM windows
    QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1)
  GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
measured AS (
  SELECT w.doc_id, source, len(w) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM words w LEFT JOIN lines l USING (doc_id) LEFT JOIN repeated r USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
hosts AS (
  SELECT source, count(*)::DOUBLE AS docs, count(*) FILTER (base_failed)::DOUBLE AS fails
  FROM judged GROUP BY source),
overall AS (
  SELECT count(*) AS hosts, sum(fails) / sum(docs) AS mean, sum(1 / docs) AS inverse FROM hosts),
spread AS (SELECT sum((fails / docs - mean) ** 2) AS spread FROM hosts, overall),
prior AS (
  SELECT mean, CASE WHEN hosts > inverse
    THEN (spread - mean * (1 - mean) * inverse) / (hosts - inverse) ELSE 0 END AS between
  FROM overall, spread),
rates AS (
  SELECT source, CASE WHEN between > 0
    THEN (fails + strength * mean) / (docs + strength) ELSE mean END AS fail_rate
  FROM hosts, (SELECT *, CASE WHEN between > 0
    THEN greatest(mean * (1 - mean) / between - 1, 0) END AS strength FROM prior))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
  n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND fail_rate <= 0.5 AS kept, fail_rate
FROM judged j JOIN rates r ON r.source IS NOT DISTINCT FROM j.source
"""

VECTORS = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y
    ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{closure("near")}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(smallest, vec_id) AS component_id,
  vec_id = coalesce(smallest, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM near GROUP BY a) ON a = vec_id
  LEFT JOIN component ON id = vec_id
"""
