"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from corvane.llm.url_filter import Rule

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, {_FOLD} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""


JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_FOLD}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON r.m = e.a)
SELECT d AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(m) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY d
"""


def url_filter(rules: list[Rule], labels: list[str]) -> str:
    cases_rule = cases_verdict = ""
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        cases_rule += f" WHEN {fits} THEN '{r.text}'"
        cases_verdict += f" WHEN {fits} THEN '{r.verdict}'"
    spam = ", ".join(f"'{x}'" for x in labels)
    return f"""
WITH u AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
c AS (
  SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\\.', '')
         || regexp_replace(path, '(/index\\.html?|/+)$', '')
         || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'),
               lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS q FROM u)),
listed AS (SELECT DISTINCT canonical FROM c WHERE list_has_any(string_split(host, '.'), [{spam}]))
SELECT page_id, host, path, CASE{cases_rule} END AS rule,
       CASE{cases_verdict} WHEN canonical IN (SELECT canonical FROM listed WHERE canonical IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""


_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((p{j} >> {35 - 5 * i}) & 31)::INT, 1)" for j in range(4) for i in range(8)
)

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
n AS (SELECT page_id, strlen(html) AS payload_bytes,
             {', '.join(f"('0x' || substr(h, {1 + 10 * j}, 10))::BIGINT AS p{j}" for j in range(4))} FROM p),
d AS (SELECT page_id, payload_bytes, {_B32} AS payload_digest FROM n),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM m
"""

_GAP = r"[\x20\x09-\x0D]+"
_COUNT = "length(regexp_replace({0}, '[^{1}]', '', 'g'))"
_END = r"[.!?…。！？][\"''»”’)\]]*[\x20\x09-\x0D]*$"
_MENU = r"^[\x20\x09-\x0D]*(home|about( us)?|contact( us)?|login|menu|search|next|previous|back|sitemap|faq|help|top)[\x20\x09-\x0D]*$"
_BOILER = (
    r"\b(cookies?|privacy policy|terms of (use|service)|all rights reserved|copyright|javascript|lorem ipsum|subscribe|newsletter|sign (in|up)|log ?in"
    r"|skip to (main )?content|click here|read more|share (this|on)|powered by)\b"
)

QUALITY = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_GAP}'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT r, unnest(range(1, len(words) - 3)) AS i, words FROM d WHERE len(words) >= 5),
grams AS (SELECT r, i, list_slice(words, i, i + 4) AS g FROM win),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
line AS (SELECT r, unnest(lines) AS x FROM d),
judged AS (
  SELECT r, length(x) AS chars, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS n, x FROM line),
lost AS (
  SELECT r, sum(chars) AS total, sum(CASE WHEN
      (n < 10 AND NOT regexp_matches(x, '{_END}'))
      OR {_COUNT.format('x', '#*$%&|<>')} > 0.10 * chars
      OR {_COUNT.format('x', '|»›•·>')} > 0.20 * n
      OR {_COUNT.format('x', '!')} > 0.50 * n
      OR (n < 10 AND regexp_matches(lower(x), '{_MENU}'))
      OR (n < 10 AND regexp_matches(lower(x), '{_BOILER}')) THEN chars ELSE 0 END) AS lost
  FROM judged GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{_GAP}', '', 'g'))::BIGINT AS word_chars,
         {_COUNT.format('text', '#*$%&|<>')}::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(l.lost / l.total, 0) AS lost_share
  FROM d LEFT JOIN covered c USING (r) LEFT JOIN lost l USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_share <= 0.5 AS kept
FROM m
"""


COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
grams AS (
  SELECT lang, k, list_aggregate(w[i : i + k - 1], 'string_agg', ' ') AS phrase
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS k))),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM grams GROUP BY ALL),
words AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, p.f AS l, q.f AS r, 1 AS cut, c.k FROM cand c
  JOIN f p ON p.lang = c.lang AND p.phrase = c.w[1] JOIN f q ON q.lang = c.lang AND q.phrase = list_aggregate(c.w[2:], 'string_agg', ' ')
  UNION ALL
  SELECT c.lang, c.phrase, c.f, p.f, q.f, 2, c.k FROM cand c
  JOIN f p ON p.lang = c.lang AND p.phrase = c.w[1] || ' ' || c.w[2] JOIN f q ON q.lang = c.lang AND q.phrase = c.w[3] WHERE c.k = 3),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, f FROM cand WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM cand WHERE k = 3) GROUP BY ALL),
alone AS (SELECT s.* FROM lowest s LEFT JOIN longer g ON s.k = 2 AND g.lang = s.lang AND g.phrase = s.phrase WHERE g.f IS NULL OR 100 * g.f < 50 * s.a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alone) JOIN words USING (lang) WHERE rank <= 2000
"""
