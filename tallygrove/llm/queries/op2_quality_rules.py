"""Quality rules on suffix-array repetition, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm import repetition
from tallygrove.llm.queries import table

RULES = repetition.Rules()


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = repetition.quality(table(spark, folder, "documents"), RULES)
    return found.withColumn("long_repeat", F.col("longest_repeat") > RULES.longest_run).drop("spans", "longest_repeat")


def _repeated(size: int, name: str) -> str:
    """Words inside windows of ``size`` words found twice or more in their document, counted by ``rid``."""
    return f"""
  {name}_all AS (
    SELECT rid, unnest(range(1, n - {size} + 2)) AS i,
           unnest(list_transform(range(1, n - {size} + 2), lambda i: array_to_string(ws[i:i + {size - 1}], ' '))) AS w
    FROM docs WHERE n >= {size}),
  {name}_twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM {name}_all) WHERE c > 1),
  {name} AS (SELECT rid, count(DISTINCT i + k) AS c FROM {name}_twice, (SELECT unnest(range({size})) AS k) GROUP BY rid)"""


# a run of more than longest_run words repeats if and only if a window of one word more does
SQL = rf"""
  WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, len(ws) AS n
    FROM documents),
  base AS (
    SELECT rid, doc_id, n AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM docs),
  {_repeated(3, "triples")},
  {_repeated(RULES.run_words, "runs")},
  {_repeated(RULES.longest_run + 1, "long_runs")},
  counted AS (
    SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(triples.c, 0) AS n_repeat_words, coalesce(runs.c, 0) AS n_covered, long_runs.c IS NOT NULL AS long_repeat
    FROM base LEFT JOIN triples USING (rid) LEFT JOIN runs USING (rid) LEFT JOIN long_runs USING (rid)),
  judged AS (
    SELECT *, n_words < {RULES.min_words} OR 100 * n_repeat_words > {RULES.repeat_share} * n_words AS base_failed FROM counted)
  SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
         CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
         CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_covered AS BIGINT) AS n_covered, base_failed,
         NOT base_failed AND 100 * n_covered <= {RULES.covered_share} * n_words AND NOT long_repeat AS kept, long_repeat
  FROM judged"""
