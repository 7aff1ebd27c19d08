"""DuckDB SQL with the same results, where SQL can say it."""

_WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP6 = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), pos AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM pos) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(t, '\|')) AS n_pipes,
         len(regexp_extract_all(t, '[!?]{2}')) AS n_bangs,
         len(regexp_extract_all(t, '\p{Lu}{4}')) AS n_caps4,
         len(lines) AS n_lines,
         len(regexp_extract_all(t, '[0-9]')) AS n_digits
  FROM w LEFT JOIN covered USING (rid)
), b AS (
  SELECT *,
    (n_words < 50)::BIGINT
    + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (10 * n_symbols > 3 * n_words)::BIGINT
    + 8 * (5 * n_pipes > n_words)::BIGINT
    + 16 * (8 * n_caps4 > word_chars)::BIGINT
    + 32 * (10 * n_bangs > 3 * n_words)::BIGINT
    + 64 * (10 * n_dup_lines > 3 * n_lines)::BIGINT
    + 128 * (2 * (n_symbols + n_digits) > word_chars)::BIGINT
    + 256 * (word_chars < 2 * n_words OR word_chars > 16 * n_words)::BIGINT
    + 512 * (10 * n_digits > 3 * word_chars)::BIGINT AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT rid, doc_id, i, lines[i] AS line,
         translate(trim(lines[i], {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)
), r AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT l.doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (WHERE r.k IS NOT NULL AND l.doc_id <> keeper)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r.k IS NULL OR l.doc_id = keeper), '')) AS kept_sha256
FROM l LEFT JOIN r USING (k) GROUP BY l.rid, l.doc_id
"""

#: CRC-32 of an ASCII string s: its polynomial is a fixed value.
_CRC = """xor(list_reduce(list_transform(range(len(s)), lambda i: ascii(s[i + 1])::BIGINT),
  lambda c, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295)"""

OP11 = f"""
WITH t AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
         strlen(coalesce(text, '')) AS bytes,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id, base, conv_id::VARCHAR AS s FROM t)
), r AS (
  SELECT conv_id, 0 AS part, 0 AS place, '' AS m, 0 AS bytes FROM c
  UNION ALL SELECT c.conv_id, 1, place, m, bytes FROM c JOIN t ON t.conv_id = c.base AND place <= h
  UNION ALL SELECT c.conv_id, 2, place, m, bytes FROM c JOIN t ON t.conv_id = c.conv_id AND place > h
), p AS (
  SELECT conv_id, bytes, row_number() OVER w - 1 AS depth, string_agg(m, '') OVER w AS k,
         row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS ends
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING)
), n AS (
  SELECT k, any_value(depth) AS depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids
  FROM p GROUP BY k
), kids AS (
  SELECT left(k, greatest(len(k) - 32, 0)) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), v AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)
), sub AS (
  SELECT a.k, sum((b.n_convs - 1) * b.bytes)::BIGINT AS saved_tokens, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves
  FROM v a JOIN v b ON b.k[1:len(a.k)] = a.k AND b.depth >= a.depth GROUP BY a.k
)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children, n_leaves, saved_tokens,
       sha256(v.ids) AS ends_sha256
FROM v JOIN sub USING (k) LEFT JOIN v u ON v.depth > 0 AND u.k = left(v.k, greatest(len(v.k) - 32, 0))
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_ledger": OP6, "op9_line_dedup": OP9, "op11_conversation_trie": OP11}
