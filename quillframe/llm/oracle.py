"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_LEDGER = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text,
    list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls
  FROM t
), win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS j FROM dup) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines,
    length(regexp_replace(text, '\P{Lu}', '', 'g')) AS n_upper,
    length(text) - length(replace(text, '!', '')) AS n_exclamations
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id
), v AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 15 * n_words)::BIGINT
    + 64 * (10 * n_upper > 3 * word_chars)::BIGINT + 128 * (5 * n_exclamations > n_words)::BIGINT AS failed FROM m
)
"""

ORACLE: dict[str, str] = {
    "op6_quality_rules": _LEDGER
    + """SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed, 'v1' AS policy FROM v""",
    "quality_ablations": _LEDGER
    + """SELECT policy, rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed & mask = bit) AS n_only
FROM v, (VALUES ('base', 3), ('v1', 255)) p(policy, mask),
  (VALUES ('few_words', 1), ('repeated_windows', 2), ('many_symbols', 4), ('duplicate_lines', 8), ('short_words', 16), ('long_words', 32), ('upper_case', 64), ('exclamations', 128)) r(rule, bit)
WHERE mask & bit <> 0 GROUP BY policy, rule""",
    "edited_texts": """WITH o AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS nxt FROM o)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(substr(text, 1, (length(text) - length(text) // 2)::BIGINT) || substr(nxt, 1, (length(text) // 2)::BIGINT)) AS edited_sha256 FROM n""",
}
