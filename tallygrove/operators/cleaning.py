"""Row and column level cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.operators.order_stats import exact_quantiles


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[f"`{c}`" for c in cols])


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Absent names are ignored."""
    return df.drop(*cols)


def fill_missing(df: DataFrame, values: Mapping[str, float | int | str]) -> DataFrame:
    """Null -> constant, per column."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v).cast(kinds[c])) for c, v in values.items()})


def fill_all_zero(df: DataFrame) -> DataFrame:
    """Null -> 0 in number columns and the text ``'0'`` in text columns."""
    zero: dict[str, int | str] = {}
    for f in df.schema:
        if isinstance(f.dataType, T.NumericType):
            zero[f.name] = 0
        elif isinstance(f.dataType, T.StringType):
            zero[f.name] = "0"
    return fill_missing(df, zero)


def fill_median(df: DataFrame, col: str, **limits: int) -> DataFrame:
    """Null -> exact median of the same column."""
    [median] = exact_quantiles(df, {col: F.col(col)}, [0.5], **limits)[col]
    return df if median is None else fill_missing(df, {col: median})


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=list(subset))


def add_columns(df: DataFrame, name: str, cols: Sequence[str]) -> DataFrame:
    """Sum of columns; null if any is null, so call it before any fill."""
    total: Column = F.col(cols[0])
    for c in cols[1:]:
        total = total + F.col(c)
    return df.withColumn(name, total)


def align_by_id(left: DataFrame, right: DataFrame, id_col: str = "id") -> DataFrame:
    """One-to-one match of two sources. Not needed where both come from one DataFrame."""
    return left.join(right, id_col, "inner")
