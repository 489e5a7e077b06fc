"""DuckDB twins of the contracts' queries, where SQL can express them."""

from __future__ import annotations

from meridia.llm import urls

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_BLANK_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[k : k + size - 1], ' ') AS said
  FROM (SELECT item_id, words, least(13, len(words)) AS size, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS k FROM b WHERE len(words) > 0)
),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, k, size, array_to_string(words[k : k + size - 1], ' ') AS said
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS k FROM d, sizes)
),
found AS (SELECT doc_id, k, size, item_id FROM places JOIN windows USING (size, said)),
hits AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + size)) AS w FROM found) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP2 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(words[k : k + least(4, len(words)) - 1], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 3) + 1)) AS k FROM d WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (
  SELECT a, a FROM both_ways
  UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
),
least_of AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least, d.doc_id) AS component_id, d.doc_id = coalesce(least, d.doc_id) AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""

_ROLE = "coalesce(role, '')"
OP4 = f"""
WITH said AS (
  SELECT conv_id, turn, {_ROLE} AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
made AS (
  SELECT *, regexp_replace(text, '\\\\|<(?:\\||s>|/s>|<SYS>>|</SYS>>)|\\[(?:INST\\]|/INST\\])', 'xx', 'g') AS unused,
    length(text)
      + length(text) - length(replace(text, chr(92), ''))
      + len(regexp_extract_all(text, '<\\||</?s>|<</?SYS>>|\\[/?INST\\]')) AS body
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + body + 23) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM made GROUP BY conv_id
""".replace("\\\\", "\\")


# The line rules, stated anew: nothing here is taken from the operator.
_LOWER_LINE = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The line with every character that is no part of a word doubled, so that neighbouring phrases don't share one.
_SPACED = rf"regexp_replace({_LOWER_LINE}, '([^0-9a-z\x{{80}}-\x{{10FFFF}}])', '\1\1', 'g')"
_SAID_EVERYWHERE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "accept cookies", "enable javascript", "lorem ipsum",
    "click here", "read more", "sign up for", "subscribe to our", "share this", "back to top", "log in", "skip to content",
)
_PHRASES = rf"(?:^|[^0-9a-z\x{{80}}-\x{{10FFFF}}])({'|'.join(p.replace(' ', '  ') for p in _SAID_EVERYWHERE)})(?:$|[^0-9a-z\x{{80}}-\x{{10FFFF}}])"
_SENTENCE_END = "[.!?:;…。！？][\"'')\\]}}»”’“]*(?:[ \t\r\x0b\x0c]|$)".replace("}}", "}")

OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_BLANK_WORDS} AS words FROM documents),
line AS (
  SELECT doc_id, k, line, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS k, unnest(lines) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM d))
),
own AS (SELECT * FROM line WHERE len(words) > 0),
marked AS (
  SELECT doc_id, line, len(array_to_string(words, '')) AS chars,
    len(list_filter(words, lambda w: regexp_full_match(w, '[|>/~]+|»|·|•|→|::') AND strlen(w) <= 3)) AS separators,
    len(list_filter(words, lambda w: regexp_matches(w, '(?:[!?]{{2,}}|[#*$%&|<>])$'))) AS noisy,
    regexp_extract_all({_SPACED}, '{_PHRASES}', 1) AS phrases,
    len(words) AS n
  FROM own
),
judged AS (
  SELECT doc_id, chars,
    separators >= 2 AND 4 * separators >= n
    OR 4 * coalesce(list_sum(list_transform(phrases, lambda p: (length(p) - length(replace(p, '  ', ''))) / 2 + 1)), 0) >= n
    OR NOT regexp_matches(line, '{_SENTENCE_END}')
    OR 2 * noisy > n AS bad
  FROM marked
),
lost AS (SELECT doc_id, sum(chars) FILTER (bad) AS lost FROM judged GROUP BY doc_id),
doubled AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM own GROUP BY doc_id),
window_at AS (
  SELECT doc_id, k, array_to_string(words[k : k + 4], ' ') AS said
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS k FROM d)
),
twice AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, said) AS n FROM window_at) WHERE n >= 2),
repeated AS (SELECT doc_id, count(DISTINCT w) AS n_repeat_words FROM (SELECT doc_id, unnest(range(k, k + 5)) AS w FROM twice) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN doubled USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * lost <= word_chars AS kept
FROM base
"""

_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
_FITS = "({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}')"


def _op3() -> str:
    """One WHEN for each rule, the longest first."""
    longest = sorted(urls.RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    fits = [(_FITS.format(host="host", path="path", h=h, p=p), h + p, v) for v, h, p in longest]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + f" ELSE '{urls.DEFAULT}' END"
    return f"""
WITH rest AS (SELECT page_id, coalesce({_REST}, '') AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM parts
"""


ORACLE: dict[str, str] = {"op1_decontamination": OP1, "op2_minhash_near_dedup": OP2, "op3_url_filters": _op3(), "op4_chat_formatting": OP4, "op7_quality_rules": OP7}
