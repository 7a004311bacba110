"""The operators' queries as plain SQL (DuckDB), where SQL can express them."""

WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def words(column: str) -> str:
    return WORDS.format(column)


def lower(column: str) -> str:
    return LOWER.format(column)


def hex_digit(n: int) -> str:
    return f"(instr('0123456789abcdef', substr(digest, {n}, 1)) - 1)"


MIX = f"""
WITH sized AS (SELECT doc_id, source, len({words("text")})::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS weight FROM sizes),
poured AS (
  SELECT *,
    3 * sum(source_size) OVER () - 2 * coalesce(sum(2 * source_size) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing
  FROM weighed WINDOW fill AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
flagged AS (SELECT *, remaining * weight > 4 * source_size * sharing AS capped FROM poured),
rest AS (SELECT arg_max(remaining, remaining) AS remaining, arg_max(sharing, remaining) AS sharing FROM flagged WHERE NOT capped),
targets AS (
  SELECT f.source, f.source_size,
    CASE WHEN capped THEN (2 * f.source_size)::DOUBLE ELSE (f.weight * r.remaining)::DOUBLE / (2 * r.sharing)::DOUBLE END AS target,
    md5('mix/' || coalesce('s:' || f.source, 'null')) AS digest
  FROM flagged f, rest r),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ((({hex_digit(1)} * 16 + {hex_digit(2)}) * 16 + {hex_digit(3)}) * 16 + {hex_digit(4)} + 0.5::DOUBLE) / 65536 AS start
  FROM targets),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST) - 1 AS place FROM sized)
SELECT u.doc_id, u.size, r.source_size, r.target,
  ((floor((place + 1) * rate + start) - floor(place * rate + start)) * size)::BIGINT AS taken
FROM ranked u JOIN rates r ON u.source IS NOT DISTINCT FROM r.source
"""

LINES = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM split),
keyed AS (SELECT *, {lower(f"trim(line, {SPACE})")} AS key FROM lines),
held AS (SELECT key, min(doc_id) AS first_id, count(DISTINCT doc_id) AS docs FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT k.*, coalesce(h.docs > 1 AND k.doc_id <> h.first_id, false) AS lost FROM keyed k LEFT JOIN held h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

LEAKS = f"""
WITH items AS (SELECT item_id, {words(lower("text"))} AS w FROM benchmark),
long AS (SELECT item_id, w, least(5, len(w)) AS n FROM items WHERE len(w) > 0),
item_grams AS (
  SELECT item_id, n, list_distinct(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS grams FROM long),
item_gram AS (SELECT item_id, n, len(grams) AS n_item_shingles, unnest(grams) AS gram FROM item_grams),
docs AS (SELECT row_number() OVER () AS row, doc_id, {words(lower("text"))} AS w FROM documents),
doc_gram AS (
  SELECT DISTINCT row, doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram
  FROM docs, (SELECT DISTINCT n FROM long) WHERE len(w) >= n),
shared AS (SELECT row, doc_id, item_id, n_item_shingles, count(*) AS n_shared FROM doc_gram JOIN item_gram USING (n, gram) GROUP BY ALL)
SELECT doc_id, item_id, n_item_shingles, n_shared, n_shared / n_item_shingles AS containment
FROM shared WHERE 5 * n_shared >= 4 * n_item_shingles
"""

COPIES = """
WITH groups AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(g.t) AS text_sha256
FROM documents d JOIN groups g ON coalesce(d.text, '') = g.t
"""

REPEATS = f"""
WITH docs AS (SELECT doc_id, {words("text")} AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS place, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS gram FROM docs WHERE len(w) >= 13),
firsts AS (SELECT gram, min(doc_id) AS first_id FROM windows GROUP BY gram),
hits AS (SELECT w.doc_id, w.place FROM windows w JOIN firsts f USING (gram) WHERE f.first_id < w.doc_id),
gone AS (SELECT DISTINCT doc_id, place + k AS place FROM hits, range(13) r(k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM docs),
kept AS (
  SELECT w.doc_id, count(g.place) AS n_removed, string_agg(w.word, ' ' ORDER BY w.place) FILTER (g.place IS NULL) AS rest
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.place = g.place GROUP BY w.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.rest, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""

#: The template's own length: two markers, two line breaks, and a backslash for each escape.
CHATS = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(text) + 2 * length(role || text) - length(replace(role || text, chr(92), '')) - length(replace(role || ' ' || text, '<|', '<')) + 1
    + length(role) - length(replace(role, chr(10), '')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

#: All arithmetic in whole numbers of any size needed.
AUDIT = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
words AS (SELECT row, lang, source, unnest(w) AS word FROM docs),
found AS (SELECT row, lang, source, {lower("word")} AS term FROM words),
counts AS (SELECT lang, source, term, count(*) AS n FROM found GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS lang_n FROM found GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
sources AS (SELECT DISTINCT lang, source FROM docs),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
given AS (
  SELECT s.lang, s.source, k.term, k.lang_n, coalesce(c.n, 0) AS n
  FROM sources s JOIN kept k ON s.lang = k.lang LEFT JOIN counts c ON s.lang = c.lang AND s.source = c.source AND k.term = c.term),
totals AS (SELECT lang, source, sum(n) AS total FROM given GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, g.term, g.n,
    1 + (1000000000::HUGEINT * (g.n + 1)) // (t.total + l.v) AS p,
    1 + (1000000000::HUGEINT * (g.lang_n + 1)) // (l.total + l.v) AS q
  FROM given g JOIN totals t ON g.lang = t.lang AND g.source = t.source JOIN langs l ON g.lang = l.lang),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""

ORACLES = {
    "op12_source_audit": AUDIT,
    "op6_chat_trees": CHATS,
    "op1_mix_sources": MIX,
    "op3_line_dedup": LINES,
    "op7_decontaminate": LEAKS,
    "op8_exact_dedup": COPIES,
    "op9_substring_dedup": REPEATS,
}
