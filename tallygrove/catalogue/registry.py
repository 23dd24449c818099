"""Where queries and twins are entered, and the SQL fragments the twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}
DIGITS = 6  # doubles are compared to this many digits: sums run in another order elsewhere


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def register(name: str, sql: str | None = None, cols: str = "", digits: int = DIGITS) -> Callable:
    """Enter a query. ``cols`` names the twin's columns, ``~`` marking those to round."""

    def enter(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, folder: rounded(fn(spark, folder), digits)
        if sql is not None:
            TWINS[name] = rounded_sql(sql, cols, digits) if cols else sql
        return fn

    return enter


def rounded_sql(sql: str, cols: str, digits: int = DIGITS) -> str:
    picks = []
    for c in cols.split():
        n = c.rstrip("~")
        picks.append(f'round("{n}", {digits}) + 0.0 AS "{n}"' if c.endswith("~") else f'"{n}"')
    return f"SELECT {', '.join(picks)} FROM ({sql}) AS twin"


SCORED = """
  SELECT o_orderkey AS id,
         CAST(CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_totalprice > 350000)
                   THEN 1 ELSE 0 END AS INTEGER) AS label,
         o_totalprice / (o_totalprice + CAST(250000.0 AS DOUBLE)) AS p
  FROM orders"""


def hash_sql(id_col: str, seed: int) -> str:
    return f"substr(md5(CAST({id_col} AS VARCHAR) || ':{seed}'), 1, 13)"


# stratified 60/20/20 split of the scored view, class quotas by largest remainder
STRATIFIED = f"""
  WITH s AS ({SCORED}),
  c AS (SELECT label, count(*) AS c FROM s GROUP BY label),
  t AS (SELECT sum(c) AS n, ceil(0.20 * sum(c)) AS nt FROM c),
  q AS (SELECT label, c, n, nt, floor(c * nt / n) AS base,
               row_number() OVER (ORDER BY (c * nt) % n DESC, label) AS rk FROM c, t),
  qt AS (SELECT label, c, n, nt,
                base + CASE WHEN rk <= nt - sum(base) OVER () THEN 1 ELSE 0 END AS test FROM q),
  v AS (SELECT label, test, c - test AS lft, n - nt AS nl, ceil(0.25 * (n - nt)) AS nv FROM qt),
  w AS (SELECT label, test, lft, nl, nv, floor(lft * nv / nl) AS base,
               row_number() OVER (ORDER BY (lft * nv) % nl DESC, label) AS rk FROM v),
  z AS (SELECT label, test,
               base + CASE WHEN rk <= nv - sum(base) OVER () THEN 1 ELSE 0 END AS val FROM w),
  r AS (SELECT s.*, row_number() OVER (PARTITION BY label ORDER BY {hash_sql('id', 42)}, id) AS rn FROM s)
  SELECT r.id, r.label, r.p,
         CASE WHEN rn <= test THEN 'test' WHEN rn <= test + val THEN 'validation' ELSE 'train' END AS split
  FROM r JOIN z ON r.label = z.label"""

# monthly mean unit price per brand, and its returns
PANEL = """
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, p_brand AS ticker,
         avg(l_extendedprice / l_quantity) AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""
RETURNS = f"""
  SELECT month, ticker, ret FROM (
    SELECT month, ticker, price / lag(price) OVER (PARTITION BY ticker ORDER BY month) - 1 AS ret
    FROM ({PANEL})) WHERE ret IS NOT NULL"""
