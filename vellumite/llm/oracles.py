"""SQL twins of operators that SQL can express."""

from __future__ import annotations

from .quality_rules import COMMON_WORDS, PUNCTUATION

_LISTS = " UNION ALL ".join(f"SELECT '{lang}' AS lang, {k} AS i, '{w}' AS word" for lang, words in COMMON_WORDS.items() for k, w in enumerate(words))
_PUNCTUATION = PUNCTUATION.replace("'", "''").replace("-", "\\-")


def quality_rules(char_limit: float = 0.26, common_limit: float = 0.24, least_chars: int = 200, least_words: int = 150, least_base_words: int = 50, short_limit: float = 0.32) -> str:
    count = lambda cls: f"len(regexp_extract_all(t, '{cls}'))"
    return f"""
WITH b AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
 ls AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM b),
 spot AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM b),
 win AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS g FROM spot),
 twice AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
 cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN twice USING (doc_id, g) CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
 base AS (SELECT b.doc_id, lang, ws, t, len(ws) AS n_words, length(t) - {count("[\\x20\\x09-\\x0D]")} AS word_chars, {count("[#*$%&|<>]")} AS n_symbols, len(ls.ls) - len(list_distinct(ls.ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM b JOIN ls USING (doc_id) LEFT JOIN cov USING (doc_id)),
 f AS (SELECT *, n_words < {least_base_words} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
 cl AS (SELECT doc_id, lang, base_failed, unnest([0, 1, 2, 3, 4, 5]) AS i, unnest([{count("\\p{L}")} - {count("\\p{Lu}")}, {count("\\p{Lu}")}, {count("[0-9]")}, {count(f"[{_PUNCTUATION}]")},
   word_chars - {count("\\p{L}")} - {count("[0-9]")} - {count(f"[{_PUNCTUATION}]")}, length(t) - word_chars]) AS v FROM f),
 lists AS ({_LISTS}),
 hits AS (SELECT doc_id, f.lang, i, count(*) AS v FROM (SELECT doc_id, lang, lower(unnest(ws)) AS word FROM f) f JOIN lists USING (lang, word) GROUP BY ALL),
 slots AS (SELECT doc_id, lang, base_failed, n_words, i FROM f JOIN (SELECT DISTINCT lang, i FROM lists) USING (lang)),
 cw AS (SELECT s.doc_id, s.lang, s.base_failed, s.i, coalesce(h.v, 0) AS v FROM slots s LEFT JOIN hits h USING (doc_id, i)
  UNION ALL SELECT s.doc_id, s.lang, s.base_failed, 99, any_value(s.n_words) - sum(coalesce(h.v, 0)) FROM slots s LEFT JOIN hits h USING (doc_id, i) GROUP BY ALL),
 rc AS (SELECT lang, i, sum(v)::DOUBLE AS q FROM cl WHERE NOT base_failed AND lang IN (SELECT lang FROM lists) GROUP BY lang, i), rp AS (SELECT i, sum(v)::DOUBLE AS q FROM cl WHERE NOT base_failed GROUP BY i),
 rw AS (SELECT lang, i, sum(v)::DOUBLE AS q FROM cw WHERE NOT base_failed GROUP BY lang, i),
 jc AS (SELECT cl.doc_id, v / nullif(sum(v) OVER d, 0)::DOUBLE AS p, coalesce(rc.q, rp.q) / nullif(sum(coalesce(rc.q, rp.q)) OVER d, 0) AS q FROM cl LEFT JOIN rc USING (lang, i) LEFT JOIN rp ON rp.i = cl.i WINDOW d AS (PARTITION BY cl.doc_id)),
 jw AS (SELECT cw.doc_id, v / nullif(sum(v) OVER d, 0)::DOUBLE AS p, q / nullif(sum(q) OVER d, 0) AS q FROM cw JOIN rw USING (lang, i) WINDOW d AS (PARTITION BY cw.doc_id)),
 dc AS (SELECT doc_id, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))) AS d FROM jc GROUP BY doc_id),
 dw AS (SELECT doc_id, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))) AS d FROM jw GROUP BY doc_id)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (word_chars < {least_chars} OR coalesce(dc.d <= {char_limit}, true)) AND (n_words < {least_base_words} OR coalesce(dw.d <= CASE WHEN n_words >= {least_words} THEN {common_limit}::DOUBLE ELSE greatest({common_limit}::DOUBLE, least({short_limit}::DOUBLE, {common_limit}::DOUBLE * sqrt({least_words}::DOUBLE / greatest(n_words, 1)))) END, true)) AS kept
FROM f LEFT JOIN dc USING (doc_id) LEFT JOIN dw USING (doc_id)"""


def fill_in_middle() -> str:
    draw = lambda k: f"('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), {8 * k + 1}, 8))::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, {draw(0)} AS h1, {draw(1)} AS h2, {draw(2)} AS h3, {draw(3)} AS h4 FROM documents),
 c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
 p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1, n - b) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE '<P>' || x || '<S>' || z || '<M>' || y END) AS output_sha256,
 sha256(CASE form WHEN 'plain' THEN t ELSE x || y || z END) AS restored_sha256
FROM p"""
