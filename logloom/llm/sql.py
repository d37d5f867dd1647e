"""DuckDB SQL for the queries that SQL can state."""

from __future__ import annotations

from logloom.llm.quality_rules import CUTOFFS, DELTA, LIMIT, MAX_REPEATED, MIN_WORDS

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest,
         CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS bytes FROM pages),
o AS (SELECT digest, max(page_id) AS owner FROM p WHERE bytes >= 1000 GROUP BY digest)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
       CASE WHEN owner IS NULL OR owner IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN owner IS DISTINCT FROM page_id THEN owner END AS refers_to
FROM p LEFT JOIN o USING (digest)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, w[i:i + least(13, len(w)) - 1] AS words
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, size, i, w[i:i + size - 1] AS words
  FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS r(i) WHERE len(w) >= size),
hits AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, words)),
hit_words AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, size)) AS r(k) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)"""

JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i:i + least(3, len(w)) - 1] AS token
  FROM d, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.token = b.token AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id
  WHERE 100 * shared >= 90 * (p.size + q.size - shared)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT a, y FROM reach JOIN edges ON b = x)
SELECT doc_id, coalesce(size, 0) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)"""

SUBSTRING = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (
  SELECT doc_id, i, w[i:i + 12] AS words FROM d, unnest(range(1, len(w) - 11)) AS r(i) WHERE len(w) >= 13),
f AS (SELECT words, min(doc_id) AS first FROM x GROUP BY words),
gone AS (
  SELECT DISTINCT doc_id, i + k AS place FROM x JOIN f USING (words), unnest(range(0, 13)) AS r(k) WHERE first < doc_id),
p AS (SELECT doc_id, i AS place, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM p ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

_SHARES = {
    "symbol_share": ("n_symbols", "word_chars"), "capital_share": ("n_capitals", "word_chars"),
    "exclamation_share": ("n_exclamations", "word_chars"), "line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words"),
}
_STATISTICS = ", ".join(
    [f"CASE WHEN {whole} > 0 THEN {part} / {whole}::DOUBLE ELSE 0 END AS {name}" for name, (part, whole) in _SHARES.items()]
    + ["-n_words::DOUBLE AS few_words"])
_TRIED = ", ".join(f"('{rule}', {place}, {cutoff}::DOUBLE)" for rule, cutoffs in CUTOFFS.items() for place, cutoff in enumerate(cutoffs))
_VALUE = "CASE rule " + " ".join(f"WHEN '{rule}' THEN {rule}" for rule in CUTOFFS) + " END"
_RATE = LIMIT / len(CUTOFFS)

RULES = rf"""
WITH t AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
x AS (SELECT doc_id, i, w[i:i + 7] AS words FROM t, unnest(range(1, len(w) - 6)) AS r(i) WHERE len(w) >= 8),
often AS (SELECT doc_id, words FROM x GROUP BY doc_id, words HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM x JOIN often USING (doc_id, words), unnest(range(0, 8)) AS r(k)
  GROUP BY doc_id),
c AS (
  SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
         len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals, length(text) - length(replace(text, '!', '')) AS n_exclamations
  FROM t LEFT JOIN rep USING (doc_id)),
s AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed, {_STATISTICS} FROM c),
good AS (
  SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
tried(rule, place, cutoff) AS (VALUES {_TRIED}),
tests AS (
  SELECT lang, rule, place, cutoff, count(*) AS n, count(*) FILTER (WHERE {_VALUE} > cutoff) AS k
  FROM s JOIN good USING (doc_id), tried WHERE NOT base_failed GROUP BY ALL),
tails AS (
  SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
           + i * ln({_RATE}) + (n - i) * ln(1 - {_RATE})))) AS tail FROM tests WHERE k <= n * {_RATE}),
safe AS (
  SELECT lang, rule, min_by(cutoff, place) AS cutoff FROM tails
  WHERE tail <= {DELTA} / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM tests)) * {len(CUTOFFS)}) GROUP BY lang, rule),
lost AS (
  SELECT DISTINCT doc_id FROM s JOIN safe ON s.lang IS NOT DISTINCT FROM safe.lang WHERE {_VALUE} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM lost) AS kept
FROM s"""

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
m AS (SELECT doc_id, r, 75 + (25 * len(w) * n) // l AS m FROM d, s WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, text, term, count(*) AS times
      FROM (SELECT item_id, text, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
v AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM f, s),
found AS (
  SELECT item_id, text, r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS score
  FROM q JOIN v USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank,
       doc_id, CAST(score AS BIGINT) AS score
FROM found JOIN m USING (r) QUALIFY rank <= 20"""

REPAIR = rf"""
WITH RECURSIVE b AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
x AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT),
                            lambda c, v: list_reduce([xor(c, v)] || range(8), lambda a, n: xor(a >> 1, 3988292384 * (a & 1)))),
                4294967295) % 20 AS kind FROM b),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
  FROM x, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM o),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
dp AS (  -- cheapest (cost, audit, output) with nothing, system, user or assistant written last
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS s0, {{'c': 1000000000::BIGINT, 'a': '', 'o': ''}} AS s1,
         {{'c': 5::BIGINT, 'a': 'I', 'o': 'user:'}} AS s2, {{'c': 10::BIGINT, 'a': 'II', 'o': 'user:' || chr(10) || 'assistant:'}} AS s3 FROM c
  UNION ALL
  SELECT conv_id, i, r0 AS s0, r1 AS s1, t2 AS s2, least(r3, {{'c': t2.c + 5, 'a': t2.a || 'I', 'o': t2.o || chr(10) || 'assistant:'}}) AS s3
  FROM (
    SELECT conv_id, i, r0, r1, r3,
           least(r2, {{'c': w.c + 5, 'a': w.a || 'I', 'o': w.o || CASE w.o WHEN '' THEN '' ELSE chr(10) END || 'user:'}}) AS t2
    FROM (
      SELECT *, least(r0, r1, r3) AS w FROM (
        SELECT conv_id, i,
               {{'c': s0.c + 2, 'a': s0.a || 'D', 'o': s0.o}} AS r0,
               least({{'c': s1.c + 2, 'a': s1.a || 'D', 'o': s1.o}},
                     {{'c': s0.c + more + CASE role[1] WHEN 's' THEN 0 ELSE 1000000000 END, 'a': s0.a || 'K', 'o': role || ':' || text}}) AS r1,
               least({{'c': s2.c + 2, 'a': s2.a || 'D', 'o': s2.o}},
                     {{'c': v.c + 1 + more, 'a': v.a || 'R', 'o': v.o || nl || 'user:' || text}},
                     {{'c': v.c + more + CASE role[1] WHEN 'u' THEN 0 ELSE 1000000000 END, 'a': v.a || 'K', 'o': v.o || nl || role || ':' || text}}) AS r2,
               least({{'c': s3.c + 2, 'a': s3.a || 'D', 'o': s3.o}},
                     {{'c': s2.c + 1 + more, 'a': s2.a || 'R', 'o': s2.o || chr(10) || 'assistant:' || text}},
                     {{'c': s2.c + more + CASE role[1] WHEN 'a' THEN 0 ELSE 1000000000 END, 'a': s2.a || 'K', 'o': s2.o || chr(10) || role || ':' || text}}) AS r3
        FROM (
          SELECT *, CASE v.o WHEN '' THEN '' ELSE chr(10) END AS nl FROM (
            SELECT p.conv_id, f.i, s0, s1, s2, s3, role, text, least(s0, s1, s3) AS v,
                   CASE WHEN fault IN ('b', 'd') THEN 1000000000 WHEN fault = 't' THEN 5 ELSE 0 END AS more
            FROM dp p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1)))))),
e AS (SELECT c.*, least(s0, s3) AS best FROM c JOIN dp ON dp.conv_id IS NOT DISTINCT FROM c.conv_id AND dp.i = c.n)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(best.o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM g.conv_id"""

ORACLE_SQL: dict[str, str] = {
    "op1_warc_archives": WARC,
    "op2_decontamination": DECONTAMINATION,
    "op5_jaccard_join": JACCARD,
    "op7_risk_controlled_rules": RULES,
    "op8_substring_dedup": SUBSTRING,
    "op11_structure_repair": REPAIR,
    "op12_lexical_search": LEXICAL,
}
