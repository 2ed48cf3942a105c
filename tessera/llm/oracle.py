"""DuckDB SQL for the results of those operators that SQL can express over whole tables."""

from __future__ import annotations

from tessera.llm import quality as q

_W, _S = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]+"

_quoted = lambda x: x.replace("'", "''")
_LABELS = ", ".join(f"'{_quoted(x)}'" for x in q.LABELS)

OP3 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(x) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents) t WINDOW g AS (PARTITION BY x)
"""

OP4 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
e AS (SELECT doc_id, x, regexp_extract_all(x, '{_W}+') AS w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '{_W}')) AS ls FROM d),
f AS (SELECT *, list_filter(ls, lambda l: NOT ((len(regexp_extract_all(l, '{q.SYMBOLS}')) >= 2 AND len(regexp_extract_all(l, '{q.SYMBOLS}')) * {q.PER_SYMBOL} > length(l))
    OR len(regexp_extract_all(l, '!!')) * {q.PER_SHOUT} > length(l)
    OR (length(l) >= {q.LONG_LINE} AND NOT regexp_matches(l, '{q.MARKS}') AND NOT regexp_matches(l, '{q.UNMARKED}'))
    OR (length(l) <= {q.SHORT_LINE} AND regexp_matches(l, '{_quoted(q.BOILERPLATE)}'))
    OR (length(l) <= {q.SHORT_LINE} AND NOT regexp_matches(l, '{q.MARKS}') AND len(regexp_extract_all(l, '{q.SEPARATORS}')) >= 2
        AND (len(regexp_extract_all(l, '{q.SEPARATORS}')) + 1) * {q.NAV_ITEM} >= length(l))
    OR (length(l) <= {q.SHORT_LINE} AND regexp_matches(l, '{q.LINK}') AND NOT regexp_matches(l, '{q.TWO_WORDS}'))
    OR (length(l) <= {q.LABEL} AND trim(lower(regexp_replace(l, '{_S}', ' ', 'g'))) IN ({_LABELS})))) AS good FROM e),
g AS (SELECT doc_id, i, w[i:i + {q.WINDOW - 1}] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - {q.WINDOW - 2})) AS i FROM f) t),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g),
r AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n FROM (SELECT doc_id, least({q.WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {q.WINDOW})) AS c FROM h WHERE n > 1) t GROUP BY doc_id),
b AS (SELECT f.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '{_S}', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(x, '{q.SYMBOLS}')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    100 * length(array_to_string(good, '')) >= {q.MIN_LEFT} * length(array_to_string(ls, '')) AS enough FROM f LEFT JOIN r ON f.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED} * n_words AS base_failed,
    NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED} * n_words) AND enough AS kept FROM b
"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT) >> {s}) & 31 AS INT) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))

OP5 = f"""
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes, sha1(x) AS h, min(page_id) OVER (PARTITION BY x) AS first FROM (SELECT page_id, coalesce(html, '') AS x FROM pages) t) u
"""
