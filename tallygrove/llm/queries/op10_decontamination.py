"""Benchmark windows in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm import decontamination
from tallygrove.llm.queries import table


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
SQL = f"""
  WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
  items AS (SELECT item_id, ws, least(len(ws), 13) AS size FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
  wanted AS (SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(ws) - size + 2),
               lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS w FROM items),
  sizes AS (SELECT DISTINCT size FROM items),
  held AS (SELECT rid, size, unnest(range(1, len(ws) - size + 2)) AS p,
             unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS w
           FROM docs, sizes WHERE len(ws) >= size),
  found AS (SELECT rid, p, wanted.size AS size, item_id FROM held JOIN wanted ON held.w = wanted.w AND held.size = wanted.size),
  hit AS (SELECT rid, count(DISTINCT p + k) AS n FROM found, (SELECT unnest(range(13)) AS k) WHERE k < size GROUP BY rid),
  named AS (SELECT rid, count(*) AS n, string_agg(i, ',' ORDER BY i) AS i
            FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY rid)
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
         CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(named.i, '')) AS items_sha256,
         coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated
  FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)"""
