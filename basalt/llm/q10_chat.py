"""Query op10: all conversations, linked by quotations, without quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat import build_conversations
from .common import table


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_conversations(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
raw AS (SELECT conv_id, turn, role, text, unnest(string_split(text, chr(10))) AS raw FROM m),
l AS (
  SELECT conv_id, turn, role, text, length(translate(regexp_extract(raw, '^((?:[ \t]*>)+)', 1), ' ' || chr(9), '')) AS level,
         lower(trim(regexp_replace(regexp_replace(raw, '^((?:[ \t]*>)+)', ''), '[ \t]+', ' ', 'g'))) AS line
  FROM raw
),
own AS (SELECT conv_id, line, min(turn) AS source FROM l WHERE level = 0 AND line <> '' AND turn IS NOT NULL GROUP BY conv_id, line),
q AS (
  SELECT l.conv_id, l.turn, l.role, l.text, level, source, count(*) AS n
  FROM l LEFT JOIN own ON l.conv_id IS NOT DISTINCT FROM own.conv_id AND l.line = own.line AND own.source < l.turn
  WHERE level > 0 AND l.line <> '' GROUP BY ALL
),
linked AS (
  SELECT conv_id, turn, role, text, sum(n) AS n_quoted, sum(CASE WHEN source IS NULL THEN 0 ELSE n END) AS n_linked,
         first(source ORDER BY level, n DESC, source DESC) FILTER (source IS NOT NULL) AS answers
  FROM q GROUP BY ALL
),
p AS (
  SELECT *, row_number() OVER w AS position, lag(turn) OVER w AS before FROM m
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text)
)
SELECT p.conv_id, p.turn, p.role, coalesce(list_aggregate(list_filter(string_split(p.text, chr(10)), lambda x: NOT regexp_matches(x, '^[ \t]*>')), 'string_agg', chr(10)), '') AS body,
       CAST(coalesce(n_quoted, 0) AS BIGINT) AS n_quoted, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked,
       coalesce(answers, before) AS parent_turn, CAST(position AS BIGINT) AS position
FROM p LEFT JOIN linked k ON p.conv_id IS NOT DISTINCT FROM k.conv_id AND p.turn IS NOT DISTINCT FROM k.turn
  AND p.role IS NOT DISTINCT FROM k.role AND p.text = k.text
"""

QUERIES = {"op10_chat": op10_chat}
ORACLES = {"op10_chat": SQL}
