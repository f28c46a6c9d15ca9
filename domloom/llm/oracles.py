"""DuckDB SQL for the queries of this subpackage."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce({WORDS.format(LOWER)}, []) AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT both_ways.b, r.root FROM r JOIN both_ways ON both_ways.a = r.doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.root) AS component_id, n.doc_id = min(r.root) AS kept
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""

OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce({WORDS.format("text")}, []) AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS g FROM x),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS later FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE later),
l AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (
  SELECT d.doc_id, d.w, list_filter(d.w, lambda x, i: NOT list_contains(coalesce(l.gone, []), i)) AS kept
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM k
"""

ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3 = rf"""
WITH b AS (SELECT item_id::VARCHAR AS item, coalesce({ALNUM.format(LOWER)}, []) AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i+9], ' ')) END) AS g,
    least(len(w), 10) AS n FROM b),
d AS (SELECT doc_id, coalesce({ALNUM.format(LOWER)}, []) AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM bw),
x AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
h AS (SELECT x.doc_id, x.i, x.n, bw.item FROM x JOIN bw ON bw.n = x.n AND bw.g = array_to_string(x.w[x.i:x.i+x.n-1], ' ')),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

WORD_LINE = r"regexp_matches(x, '[^\x20\x09-\x0D]')"
OP6 = rf"""
WITH d AS (SELECT doc_id, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {WORD_LINE}) AS l FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(l) - 1)) AS i, l FROM d WHERE len(l) >= 3),
g AS (SELECT doc_id, i, array_to_string(l[i:i+2], chr(10)) AS g FROM w),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS later FROM g),
c AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM f WHERE later),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (
  SELECT d.doc_id, d.l, r.gone, CASE WHEN r.gone IS NULL THEN coalesce(d.text, '')
    ELSE array_to_string(list_filter(d.l, lambda x, i: NOT list_contains(r.gone, i)), chr(10)) END AS kept
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id)
SELECT doc_id, len(l)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed_lines, sha256(kept) AS kept_sha256 FROM k
"""

_RULES = """n_words >= 20 AND mean_word_chars BETWEEN 2.0 AND 14.0 AND symbol_ratio <= 0.2 AND n_stop_words >= 2 AND alpha_word_ratio >= 0.5
  AND upper_ratio <= 0.6 AND dup_line_ratio <= 0.5 AND bullet_line_ratio <= 0.9 AND ellipsis_line_ratio <= 0.4"""


def _op10(stop: list[str]) -> str:
    words = ", ".join(f"'{w}'" for w in stop)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {WORD_LINE}) AS l FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
g AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM x),
f AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS again FROM g),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM f WHERE again) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^\pL]+')), [{words}])) AS n_stop_words,
    length(regexp_replace(text, '[^\pL]+', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS uppers,
    len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS alpha, len(l) AS n_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS bullets,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS dots
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
s AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio, CASE WHEN n_words > 0 THEN alpha / n_words ELSE 0 END AS alpha_word_ratio,
    CASE WHEN letters > 0 THEN uppers / letters ELSE 0 END AS upper_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
    CASE WHEN n_lines > 0 THEN bullets / n_lines ELSE 0 END AS bullet_line_ratio, CASE WHEN n_lines > 0 THEN dots / n_lines ELSE 0 END AS ellipsis_line_ratio,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ({_RULES}) AS kept FROM s
"""


def _stop_words() -> list[str]:
    from .quality_rules import STOP_WORDS

    return sorted(set(STOP_WORDS))


OP10 = _op10(_stop_words())
