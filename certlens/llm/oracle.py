"""DuckDB twins of the queries that SQL can express.

Token counts, HTML extraction, surrogates, nearest neighbours, language ID and
suffix-tree scores have none; their tests compare with brute force instead.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
phrase AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS words
           FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM item WHERE len(w) > 0)),
place AS (SELECT r, s.size, p, array_to_string(w[p : p + s.size - 1], ' ') AS words
          FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM doc, (SELECT DISTINCT size FROM phrase)) s),
met AS (SELECT r, size, p, item FROM place JOIN phrase USING (size, words)),
hit AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS word FROM met) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

OP5 = """WITH RECURSIVE slim AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(concat_ws('|', '20240131', CAST(doc_id AS VARCHAR), md5(text))) AS place FROM documents),
sources AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM slim GROUP BY source)),
-- the water level: sources in the order in which they fill up
filled AS (
  SELECT *, coalesce(sum(3.0 * source_size) OVER before, 0) AS held, sum(weight) OVER behind AS free, sum(source_size) OVER () AS total
  FROM sources WINDOW before AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                      behind AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT max((total - held) / free) AS level FROM filled),
target AS (SELECT source, source_size, CASE WHEN 3.0 * source_size <= level * weight THEN CAST(3.0 * source_size AS DOUBLE) ELSE CAST(level * weight AS DOUBLE) END AS target FROM sources, level),
placed AS (
  SELECT slim.doc_id, slim.size, t.source_size, t.target, slim.source,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         coalesce(sum(slim.size) OVER (PARTITION BY slim.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM slim JOIN target t ON slim.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, whole * size + extra AS taken, source, whole, extra
FROM (SELECT *, CAST(greatest(0, least(size, CAST(floor(target + 0.5) AS BIGINT) - whole * source_size - ahead)) AS BIGINT) AS extra FROM placed)
"""

OP10 = f"""WITH RECURSIVE doc AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
gram AS (SELECT DISTINCT r, array_to_string(w[p : p + least(5, len(w)) - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM doc WHERE len(w) > 0)),
size AS (SELECT r, count(*) AS n FROM gram GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM gram a JOIN gram b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
link AS MATERIALIZED (SELECT a, b FROM shared JOIN size x ON x.r = a JOIN size y ON y.r = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS r, a AS t FROM edge UNION SELECT reach.r, edge.b FROM reach JOIN edge ON edge.a = reach.t),
least_id AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN doc d ON d.r = reach.t GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM doc LEFT JOIN size USING (r) LEFT JOIN least_id USING (r)
"""

OP7 = r"""
WITH turn_rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, length(regexp_replace(text, '(\\|<s>|</s>|\[/?INST\]|\[ANSWER\]|\[/?SYSTEM\]|\[/?TURN\]|\[:\])', '\\\1', 'g')) AS n,
         length(regexp_replace(role, '(\\|<s>|</s>|\[/?INST\]|\[ANSWER\]|\[/?SYSTEM\]|\[/?TURN\]|\[:\])', '\\\1', 'g')) AS role_n
  FROM turn_rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 13 WHEN 'system' THEN 19 ELSE 20 + role_n END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP11 = """WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
ranks AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS r1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS r2,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
pieces AS (
  SELECT *, substring(text, 1, least(r1, r2)) AS prefix, substring(text, least(r1, r2) + 1, abs(r1 - r2)) AS middle, substring(text, greatest(r1, r2) + 1) AS suffix FROM ranks)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(r1, r2) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(r1 - r2) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
"""

OP12 = """WITH doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
label AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
mask AS (
  SELECT part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc.doc_id > min(doc.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM doc LEFT JOIN label ON label.doc_id = doc.doc_id),
counted AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM mask GROUP BY part, mask),
letter(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS INTEGER) AS before FROM orders, range(1, 6) t(step)),
audited AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM counted, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM audited
"""

OP13 = """WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS plain FROM documents),
placed AS (SELECT doc_id, plain, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size, row_number() OVER best AS place
           FROM doc WINDOW best AS (PARTITION BY plain ORDER BY length(text) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(plain) AS text_sha256 FROM placed
"""

ORACLE_SQL: dict[str, str] = {"op3_decontaminate": OP3, "op5_mix": OP5, "op7_chat_format": OP7, "op10_ngram_jaccard": OP10, "op11_fill_in_middle": OP11, "op12_filter_audit": OP12,
                              "op13_exact_dedup": OP13}
