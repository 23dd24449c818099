"""Date x ticker panels in long form ``(date, ticker, price)``.

One ticker may hold a large part of all rows, so no window spans a whole ticker: rows are windowed
per (ticker, time block) and what crosses a block boundary travels through a table with one row per
ticker and block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.operators.order_stats import sketched
from tallygrove.operators.ranking import bucket

MAX_BLOCKS = 1024  # bounds the window over a ticker's blocks


def with_blocks(df: DataFrame, date: str, blocks: int | None = None) -> DataFrame:
    """Add ``_block``: non-decreasing in the date, about equal row counts of all tickers per block.

    A ticker's rows of a block are no more than the block's, however unevenly tickers and dates are filled.
    """
    blocks = blocks or min(MAX_BLOCKS, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    moment = F.unix_micros(F.col(date).cast("timestamp")).cast("double")
    (cuts,), _ = sketched(df, [(moment, [i / blocks for i in range(1, blocks)])])
    return bucket(df.withColumn("_moment", moment), "_moment", sorted(set(cuts or [])), "_block").drop("_moment")


def previous_value(
    df: DataFrame, ticker: str, date: str, value: str, out: str, skip_null: bool = False, block: Column | None = None
) -> DataFrame:
    """Add the value of the row before (per ticker, by date); with ``skip_null`` the last one present."""
    blocked = with_blocks(df, date) if block is None else df.withColumn("_block", block)
    when = F.when(F.col(value).isNotNull(), F.col(date)) if skip_null else F.col(date)
    ends = blocked.groupBy(ticker, "_block").agg(F.max_by(value, when).alias("_end"))
    # one row per ticker and block: their number bounds the window
    earlier = Window.partitionBy(ticker).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(ticker, "_block", F.last("_end", ignorenulls=skip_null).over(earlier).alias("_carry"))
    order = Window.partitionBy(ticker, "_block").orderBy(date)
    if skip_null:
        before = F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        previous = F.coalesce(before, F.col("_carry"))
    else:
        previous = F.when(F.row_number().over(order) == 1, F.col("_carry")).otherwise(F.lag(value).over(order))
    return blocked.join(carried, [ticker, "_block"]).withColumn(out, previous).drop("_block", "_carry")


def forward_fill(df: DataFrame, ticker: str, date: str, value: str, block: Column | None = None) -> DataFrame:
    """Null -> last value present before it."""
    filled = previous_value(df, ticker, date, value, "_last", True, block)
    return filled.withColumn(value, F.coalesce(value, "_last")).drop("_last")


def pct_change(
    df: DataFrame, ticker: str, date: str, price: str, fill: bool = True, block: Column | None = None
) -> DataFrame:
    """Return against the row before, ``price / previous - 1``; rows without one are dropped.

    With ``fill`` gaps take the last price present first. That price is also what the next row is
    compared with, so one look back serves both.
    """
    prev = previous_value(df, ticker, date, price, "_prev", fill, block)
    now = F.coalesce(price, "_prev") if fill else F.col(price)
    ret = F.try_divide(now, "_prev") - 1
    return prev.select(date, ticker, ret.alias("ret")).where(F.col("ret").isNotNull())


def tail_dates(df: DataFrame, date: str, n: int) -> DataFrame:
    """Rows of the last n distinct dates."""
    cutoff = df.select(date).distinct().orderBy(F.col(date).desc()).limit(n).agg(F.min(date))
    return df.where(F.col(date) >= cutoff.scalar())


def date_align(df: DataFrame, ticker: str, date: str, value: str) -> DataFrame:
    """Rows of the dates on which every ticker has a value."""
    tickers = df.agg(F.count_distinct(ticker))
    full = (
        df.where(F.col(value).isNotNull())
        .groupBy(date)
        .agg(F.count_distinct(ticker).alias("_n"))
        .where(F.col("_n") == tickers.scalar())
        .select(date)
    )
    return df.join(full, date, "left_semi")


def to_wide(df: DataFrame, ticker: str, date: str, value: str, tickers: Sequence[str]) -> DataFrame:
    """One row per date, one column per ticker."""
    return df.groupBy(date).pivot(ticker, list(tickers)).agg(F.first(value))
