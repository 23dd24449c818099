import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallygrove.operators import panel


@pytest.fixture(scope="module")
def prices(spark):
    rng = np.random.default_rng(2)
    rows = []
    for t in ("A", "B", "C"):
        for i in range(900):
            if t == "B" and 300 <= i < 700:
                continue  # a whole year without rows
            gap = rng.random() < 0.2 or (t == "C" and 300 <= i < 760)  # a year of rows without a price
            rows.append((dt.date(2020, 1, 1) + dt.timedelta(i), t, None if gap else float(rng.uniform(1, 9))))
    return spark.createDataFrame(rows, "date date, ticker string, price double").repartition(5), pd.DataFrame(rows, columns=["date", "ticker", "price"])


@pytest.mark.parametrize("fill", [True, False])
def test_returns_across_blocks(prices, fill):
    df, pdf = prices
    got = panel.pct_change(df, "ticker", "date", "price", fill).toPandas().sort_values(["ticker", "date"])
    pdf = pdf.sort_values(["ticker", "date"]).copy()
    if fill:
        pdf["price"] = pdf.groupby("ticker")["price"].ffill()
    pdf["ret"] = pdf["price"] / pdf.groupby("ticker")["price"].shift() - 1
    want = pdf.dropna(subset=["ret"])
    assert got["ret"].to_numpy() == pytest.approx(want["ret"].to_numpy())
    assert got["date"].tolist() == want["date"].tolist()


def test_forward_fill(prices):
    df, pdf = prices
    got = panel.forward_fill(df, "ticker", "date", "price").toPandas().sort_values(["ticker", "date"])
    pdf = pdf.sort_values(["ticker", "date"])
    want = pdf.groupby("ticker")["price"].ffill()
    assert np.allclose(got["price"].to_numpy(), want.to_numpy(), equal_nan=True)


def test_finer_blocks_agree(prices):
    df, _ = prices
    month = F.trunc("date", "month")
    a = panel.pct_change(df, "ticker", "date", "price", block=month)
    b = panel.pct_change(df, "ticker", "date", "price")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_a_large_ticker_is_divided(spark):
    one = spark.range(9000).select(F.lit("A").alias("ticker"), F.expr("date_add(date'2021-01-01', cast(id % 300 as int))").alias("date"))
    rest = spark.range(1000).select(F.lit("B").alias("ticker"), F.expr("date_add(date'2001-01-01', cast(id * 7 as int))").alias("date"))
    sizes = panel.with_blocks(one.union(rest), "date", 20).groupBy("ticker", "_block").count().collect()
    assert max(r["count"] for r in sizes) < 700 and sum(r.ticker == "A" for r in sizes) > 12
    ends = panel.with_blocks(one, "date", 20).groupBy("_block").agg(F.min("date").alias("a"), F.max("date").alias("b")).orderBy("_block").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:]))


def test_tail_and_align(prices):
    df, pdf = prices
    kept = panel.tail_dates(df, "date", 100)
    assert kept.select("date").distinct().count() == 100
    full = panel.date_align(df, "ticker", "date", "price").toPandas()
    have = pdf.dropna().groupby("date")["ticker"].nunique()
    assert set(full["date"]) == set(have[have == 3].index)
    wide = panel.to_wide(panel.date_align(df, "ticker", "date", "price"), "ticker", "date", "price", ["A", "B", "C"])
    assert wide.dropna().count() == (have == 3).sum()
