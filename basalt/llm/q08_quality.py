"""Query op8: quality rules over all documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .quality import ALPHA, DELTA, RULES, judge


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _sql() -> str:
    cells = [(r[0], f"n{i}", r[1], r[2], k, c) for i, r in enumerate(RULES) for k, c in enumerate(r[3])]
    grid = ", ".join(f"('{name}', '{num}', '{den}', {k}, CAST({c} AS DOUBLE))" for name, _, num, den, k, c in cells)
    values = " UNION ALL ".join(f"SELECT doc_id, stratum, good, '{r[0]}' AS rule, CASE WHEN {r[2]} = 0 THEN 0.0 ELSE CAST({r[1]} AS DOUBLE) / {r[2]} END AS v FROM known" for r in RULES)
    all_values = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r[0]}' AS rule, CASE WHEN {r[2]} = 0 THEN 0.0 ELSE CAST({r[1]} AS DOUBLE) / {r[2]} END AS v FROM f" for r in RULES)
    space = r"\x20\x09-\x0D"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, stratum, t, list_filter(regexp_split_to_array(t, '[{space}]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS lines
  FROM d
),
g AS (
  SELECT doc_id, i, list_aggregate(words[i : i + 7], 'string_agg', ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 8) r(k) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, stratum, t, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[{space}]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper
  FROM w LEFT JOIN covered USING (doc_id)
),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
known AS (
  SELECT min(b.doc_id) AS doc_id, stratum, t, quality > 0 AS good, any_value(COLUMNS(['n_words', 'word_chars', 'n_symbols', 'n_dup_lines', 'n_repeat_words', 'n_lines', 'n_upper']))
  FROM b JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IS NOT NULL GROUP BY stratum, t, quality > 0
),
top AS (SELECT stratum, count(*) FILTER (good) AS n FROM known GROUP BY stratum),
grid(rule, num, den, k, cutoff) AS (VALUES {grid}),
v AS ({values}),
cell AS (
  SELECT top.stratum, n, grid.rule, k, cutoff, count(*) FILTER (v.v > cutoff AND good) AS lost, count(*) FILTER (v.v > cutoff AND NOT good) AS caught
  FROM top JOIN v USING (stratum) JOIN grid ON grid.rule = v.rule GROUP BY ALL
),
tested AS (
  SELECT *, CASE WHEN lost >= n * {ALPHA} THEN 0 WHEN
    list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))))
    <= {DELTA} / ((SELECT count(*) FROM top) * {len(RULES)}) THEN 1 ELSE 0 END AS ok
  FROM cell
),
walked AS (SELECT *, min(ok) OVER (PARTITION BY stratum, rule ORDER BY k) AS so_far FROM tested),
best AS (
  SELECT stratum, rule, cutoff FROM (
    SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY caught - lost DESC, k) AS r FROM walked WHERE so_far = 1 AND caught > lost)
  WHERE r = 1
),
rejected AS (SELECT DISTINCT a.doc_id FROM ({all_values}) a JOIN best USING (stratum, rule) WHERE a.v > best.cutoff)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rejected.doc_id IS NULL AS kept
FROM b LEFT JOIN rejected USING (doc_id)
"""


QUERIES = {"op8_quality": op8_quality}
ORACLES = {"op8_quality": _sql()}
