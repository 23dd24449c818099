import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallygrove.functions import scalars as fx
from tallygrove.operators import cleaning


def values(spark, schema, rows, expr):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(expr.alias("v")).collect()]


def test_percent(spark):
    assert values(spark, "c string", [" 13.5% ", "7", "n/a", None, "nan"], fx.parse_percent("c")) == [13.5, 7.0, None, None, None]


def test_strict_number_raises(spark):
    assert values(spark, "c string", ["2.5"], fx.to_number("c")) == [2.5]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        values(spark, "c string", ["--"], fx.to_number("c"))


def test_logs(spark):
    got = values(spark, "c double", [math.e, -math.e, 0.0, 0.5, -0.5, None], fx.signed_log("c"))
    assert got[:3] == pytest.approx([1, -1, 0])
    assert got[3:5] == pytest.approx([-0.693147, 0.693147], abs=1e-6)
    assert got[5] is None
    assert values(spark, "c double", [math.e, -3.0, 0.0], fx.floor_log("c")) == pytest.approx([1, 0, 0])


def test_month_year(spark):
    got = values(spark, "c string", ["Jan-85", "Jan-05", "Feb-69", "xx"], fx.parse_month_year("c", "MMM-yy"))
    assert got == [dt.date(1985, 1, 1), dt.date(2005, 1, 1), dt.date(1969, 2, 1), None]
    assert values(spark, "c string", ["Dec-2011", "2011"], fx.parse_month_year("c")) == [dt.date(2011, 12, 1), None]


def test_membership_and_ordinals(spark):
    assert values(spark, "c string", ["a", "b", None], fx.label_from_classes("c", ["a"])) == [1, 0, 0]
    assert values(spark, "c string", ["Po", "Ex", "?", None], fx.ordinal_encode("c", {"Po": 1, "Ex": 5})) == [1, 5, None, None]


def test_clip_keeps_null(spark):
    assert values(spark, "c double", [-1.0, 0.5, 9.0, None], fx.clip("c", 0.0, 1.0)) == [0.0, 0.5, 1.0, None]


def test_recency(spark):
    rows = [(3.0, 1), (999.0, 0), (60.0, 1)]
    assert values(spark, "m double, e int", rows, fx.recency_flag("m", "e", 24)) == [1, 0, 0]
    assert values(spark, "m double, e int", rows, fx.recency_score("m", "e"))[:2] == [0.25, 0.0]


def test_fills(spark):
    df = spark.createDataFrame([(None, None, 1.0), ("x", 2, None)], "s string, i int, d double")
    assert sorted(map(tuple, cleaning.fill_all_zero(df).collect())) == [("0", 0, 1.0), ("x", 2, 0.0)]
    summed = cleaning.add_columns(df, "t", ["i", "d"])
    assert [r.t for r in summed.collect()] == [None, None]
    assert cleaning.fill_median(df.select(F.lit(None).cast("double").alias("z")), "z").first().z is None


def test_hash_order_is_exact_as_double(spark):
    top = spark.range(1000).select(F.max(fx.hash_order("id", 1)).alias("m")).first().m
    assert 0 < top < 2**52
