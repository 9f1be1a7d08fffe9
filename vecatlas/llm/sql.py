"""DuckDB SQL for the longer queries of the text operators, built from the operators' own parameters."""

from __future__ import annotations

from vecatlas.llm import spelling
from vecatlas.llm.weak_rules import BASE_FAILED, PRIOR, ROUNDS, RULES, START


def weak_rules() -> str:
    """Counts by regular expressions and windows by unnesting; expectation-maximisation as a recursive query over the votes' table."""
    right, wrong = PRIOR
    rules = range(len(RULES))
    vote = ", ".join(f"CASE WHEN {r.good} THEN 1 WHEN {r.bad} THEN -1 ELSE 0 END AS v{j}" for j, r in enumerate(RULES))
    odds = "ln(p / (1 - p)) + " + " + ".join(f"CASE v{j} WHEN 1 THEN ln(g{j} / (1 - b{j})) WHEN -1 THEN ln((1 - g{j}) / b{j}) ELSE 0 END" for j in rules)
    new = ", ".join(
        f"(sum(CASE WHEN v{j} = 1 THEN q ELSE 0 END) + {right}) / (sum(CASE WHEN v{j} <> 0 THEN q ELSE 0 END) + {right + wrong}), (sum(CASE WHEN v{j} = -1 THEN n - q ELSE 0 END) + {right}) / (sum(CASE WHEN v{j} <> 0 THEN n - q ELSE 0 END) + {right + wrong})"
        for j in rules
    )
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
pos AS (SELECT rid, unnest(list_transform(range(1, len(w) - 3), lambda i: {{'i': i, 'five': array_to_string(w[i:i + 4], ' ')}})) AS p FROM w WHERE len(w) >= 5),
win AS MATERIALIZED (SELECT rid, p.i AS i, count(*) OVER (PARTITION BY rid, p.five) AS times FROM pos),
rep AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS place FROM win WHERE times > 1) GROUP BY rid),
c AS MATERIALIZED (SELECT w.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(lines) AS n_lines, length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS n_letters, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals,
    len(list_filter(w, lambda x: regexp_matches(x, '[.!?]$'))) AS n_ends, len(regexp_extract_all(text, '[^\p{{L}}\p{{N}}\x20\x09-\x0D]{{2,}}')) AS n_runs
  FROM w LEFT JOIN rep USING (rid)),
v AS MATERIALIZED (SELECT *, {vote} FROM c),
t AS MATERIALIZED (SELECT {", ".join(f"v{j}" for j in rules)}, count(*) AS n FROM v GROUP BY ALL),
em(r, p, {", ".join(f"g{j}, b{j}" for j in rules)}) AS (
  SELECT 0, {START[0]}::DOUBLE, {", ".join(f"{START[1]}::DOUBLE, {START[2]}::DOUBLE" for _ in rules)}
  UNION ALL
  SELECT r + 1, (sum(q) + {right}) / (sum(n) + {right + wrong}), {new}
  FROM (SELECT *, n / (1 + exp(-({odds}))) AS q FROM t, em WHERE r < {ROUNDS}) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed, NOT ({BASE_FAILED}) AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept,
  {" || ".join(f"CASE v{j} WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '0' END" for j in rules)} AS votes
FROM v, (SELECT * FROM em WHERE r = {ROUNDS})"""


def spelling_groups() -> str:
    """crc32 by bits over UTF-8 bytes (letters up to U+00FF have two at most); near words by common wildcards, not by tiles."""
    byte = "CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END"
    bit = "lambda x, _: xor(x >> 1, 3988292384 * (x & 1))"
    return rf"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{spelling.UPPER}', '{spelling.LOWER}') AS run FROM documents),
one AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= {spelling.SHORTEST} GROUP BY ALL),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, CAST(flatten(list_transform(string_split(id || ':' || run, ''), lambda c: {byte})) AS BIGINT[])), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], {bit})), 4294967295) AS h FROM one),
w AS (SELECT CASE WHEN h % {spelling.DROPS} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM h),
n AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= {spelling.SHORTEST} GROUP BY word HAVING sum(k) >= {spelling.OFTEN}),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM n),
cut AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS less FROM p),
replaced AS (SELECT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.less = b.less AND a.word <> b.word AND length(a.word) = length(b.word)),
deleted AS (SELECT DISTINCT c.word AS long, c.n AS long_n, n.word AS short, n.n AS short_n FROM cut c JOIN n ON c.less = n.word),
near AS (SELECT * FROM replaced UNION ALL SELECT long, short, short_n FROM deleted UNION ALL SELECT short, long, long_n FROM deleted),
best AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS best, max(n) AS best_n FROM near GROUP BY a),
form AS (SELECT n.word, n.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n.n THEN best END AS form, CASE WHEN best_n >= 2 * n.n THEN best_n END AS form_n FROM n LEFT JOIN best USING (word)),
walk AS (SELECT word, coalesce(form, word) AS place, form AS more FROM form UNION ALL SELECT walk.word, form.form, form.form FROM walk JOIN form ON walk.place = form.word WHERE walk.more IS NOT NULL AND form.form IS NOT NULL),
root AS (SELECT word, place FROM walk JOIN form USING (word) JOIN (SELECT word AS last FROM form WHERE form IS NULL) e ON walk.place = e.last)
SELECT form.word, form.form, root.place AS root, form.n, form.n_near, form.form_n FROM form JOIN root USING (word)"""
