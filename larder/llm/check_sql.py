"""Check SQL for DuckDB: the operators that SQL can express on whole tables."""

from __future__ import annotations

from larder.llm.quality import RULES
from larder.llm.url_filters import UrlRule

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = r"[\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NEAR_DUPLICATES = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WHITE}'),
    lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM split),
rows_of AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rows_of a JOIN rows_of b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reached r JOIN both_ways l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least USING (doc_id)"""


def url_filters(rules: list[UrlRule]) -> str:
    values = ", ".join(
        f"({_quoted(rule.name)}, {_quoted(rule.verdict)}, {_quoted(rule.expression.replace('[\\s\\S]', '(?s:.)'))}, {rule.is_domain})"
        for rule in rules
    )
    return rf"""
WITH rules AS (SELECT * FROM (VALUES {values}) t(name, verdict, expression, is_domain)),
parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
best AS (
  SELECT page_id, name, r.verdict, is_domain FROM split JOIN rules r ON regexp_matches(host || path, expression)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY is_domain DESC, length(name) DESC, r.verdict DESC) = 1)
SELECT page_id, host, path, CASE WHEN is_domain THEN name END AS rule, coalesce(verdict, 'allow') AS verdict,
  CASE WHEN NOT is_domain THEN name END AS pattern
FROM split LEFT JOIN best USING (page_id)"""


def quality_rules(risk: float = 0.05, error: float = 0.05) -> str:
    tests = ", ".join(f"({k}, {cutoff})" for k, rule in enumerate(RULES) for cutoff in rule.cutoffs)
    total = sum(len(rule.cutoffs) for rule in RULES)
    values = ", ".join(f"coalesce({rule.value.replace(' / ', ' / nullif(')}, 0), 0.0)" for rule in RULES)
    allowed = risk / len(RULES)
    tail = (
        f"CASE WHEN lost >= n_good * {allowed} THEN 1.0 ELSE list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(n_good + 1) "
        f"- lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({allowed}) + (n_good - i) * ln(1 - {allowed})))) END"
    )
    return rf"""
WITH split AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_WHITE}'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i,
    unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM split WHERE len(w) >= 3),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (VALUES (0), (1), (2)) t(k) GROUP BY doc_id),
counted AS (
  SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '{_WHITE}', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals
  FROM split LEFT JOIN covered c USING (doc_id)),
valued AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{values}] AS v FROM counted),
agreed AS (
  SELECT doc_id, min(quality) = 1 AS good FROM labels GROUP BY doc_id HAVING min(quality) = max(quality) AND min(quality) IN (0, 1)),
held AS (SELECT lang, good, v FROM valued JOIN agreed USING (doc_id) WHERE NOT base_failed),
sums AS (
  SELECT lang, rule, cutoff, count(*) FILTER (good) AS n_good, count(*) FILTER (good AND v[rule + 1] > cutoff) AS lost,
    count(*) FILTER (NOT good AND v[rule + 1] > cutoff) AS caught
  FROM held CROSS JOIN (VALUES {tests}) t(rule, cutoff) GROUP BY ALL),
passed AS (
  SELECT * FROM sums WHERE caught > 0 AND {tail} <= {error} / ((SELECT count(DISTINCT coalesce(lang, '')) FROM held) * {total})
  QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY caught DESC, cutoff DESC) = 1),
failed AS (
  SELECT DISTINCT doc_id FROM valued JOIN passed ON valued.lang IS NOT DISTINCT FROM passed.lang AND v[rule + 1] > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM failed) AS kept
FROM valued"""


def licence_scan(sets: dict[str, list[str]], limit: float = 0.8) -> str:
    values = ", ".join(
        f"({_quoted(name)}, [{', '.join(_quoted(b) for b in found)}])" for name, found in sorted(sets.items())
    )
    return rf"""
WITH templates AS (SELECT * FROM (VALUES {values}) t(name, bigrams)),
wanted AS (SELECT name, len(bigrams) AS size, unnest(bigrams) AS bigram FROM templates),
passages AS (
  SELECT doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)),
    regexp_split_to_array(text, '\n[ \t\r]*\n\s*'), [text]))) AS p FROM documents WHERE text IS NOT NULL),
words AS (
  SELECT doc_id, row_number() OVER () AS passage,
    string_split(trim(regexp_replace(lower(p), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM passages),
found AS (
  SELECT doc_id, passage, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM words WHERE len(w) >= 2),
each AS (SELECT doc_id, passage, len(b) AS size, unnest(b) AS bigram FROM found),
scored AS (
  SELECT e.doc_id, t.name, 2.0::DOUBLE * count(*) / (t.size + e.size) AS dice FROM each e JOIN wanted t USING (bigram)
  GROUP BY e.doc_id, e.passage, e.size, t.name, t.size HAVING 2.0::DOUBLE * count(*) / (t.size + e.size) >= {limit}),
best AS (SELECT doc_id, name, max(dice) AS dice FROM scored GROUP BY doc_id, name),
ended AS (
  SELECT doc_id, max(dice) AS dice, string_agg(name, ', ' ORDER BY name) AS licences,
    arg_min(name, (-dice, name)) AS licence FROM best GROUP BY doc_id)
SELECT doc_id, licence, dice, coalesce(licences, '') AS licences FROM documents LEFT JOIN ended USING (doc_id)"""


FILTER_AUDIT = rf"""
WITH split AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_WHITE}'), lambda x: x <> '') AS w FROM documents),
least AS (SELECT t, min(doc_id) AS least FROM split GROUP BY t),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
sets AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
      100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
      coalesce(doc_id > least, false)] AS f,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM split JOIN least USING (t) LEFT JOIN known USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, ascii(substr(filter_order, step, 1)) - 64 AS k,
    list_transform(range(1, step), lambda i: ascii(substr(filter_order, CAST(i AS INTEGER), 1)) - 64) AS earlier
  FROM orders CROSS JOIN (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
judged AS (
  SELECT part, filter_order, step, k, n, good, toxic, f[k] AS fails, len(list_filter(earlier, lambda i: f[i])) > 0 AS gone,
    len(list_filter(f, lambda x: x)) = 1 AS single FROM sets CROSS JOIN steps),
summed AS (
  SELECT part, filter_order, step, k, sum(n) FILTER (NOT fails AND NOT gone) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed,
    sum(n) FILTER (fails AND gone) AS redundant, sum(n) FILTER (fails AND single) AS unique_fails,
    sum(good) FILTER (fails AND NOT gone) AS good_lost, sum(toxic) FILTER (fails AND NOT gone) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({name}, 0) AS BIGINT) AS {name}" for name in
    ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, k), 0) AS BIGINT) AS shapley
FROM summed"""

RANKED_SEARCH = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
held AS (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM words WHERE len(w) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM words WHERE len(w) > 0),
postings AS (SELECT row, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM held GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * t.n + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, total t GROUP BY term, t.n),
wanted AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * t.n) // t.l)))) AS BIGINT) AS score
  FROM wanted JOIN postings p USING (term) JOIN weights USING (term) CROSS JOIN total t GROUP BY item_id, row, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, row) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10"""
