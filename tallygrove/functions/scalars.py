"""Scalar column functions. All are built-in expressions, so they stay inside codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def parse_percent(c: str | Column) -> Column:
    """``' 13.5% '`` -> 13.5; text that is no number -> null."""
    text = F.regexp_replace(F.trim(_col(c).cast("string")), "%", "")
    return nan_to_null(text.try_cast("double"))


def to_number(c: str | Column) -> Column:
    """Strict text -> double. Under ANSI mode (Spark 4's default) bad text raises."""
    return _col(c).cast("double")


def missing_flag(c: str | Column) -> Column:
    """1 where the value is present ("ever happened"), else 0."""
    return _col(c).isNotNull().cast("int")


def recency_flag(months: str | Column, ever: str | Column, limit: float) -> Column:
    """1 if it ever happened and at most ``limit`` months ago."""
    inside = (_col(months) <= F.lit(limit)) & (_col(ever) == 1)
    return F.coalesce(inside, F.lit(False)).cast("int")


def recency_score(months: str | Column, ever: str | Column) -> Column:
    return _col(ever).cast("double") / (F.lit(1.0) + _col(months))


def parse_month_year(c: str | Column, fmt: str = "MMM-yyyy") -> Column:
    """Month-year text -> date, bad text -> null.

    Two-digit years follow the POSIX pivot (69-99 -> 19xx, 00-68 -> 20xx); Spark's own puts every
    two-digit year after 2000.
    """
    parsed = F.try_to_date(_col(c), fmt)
    if fmt.count("y") != 2:
        return parsed
    return F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed)


def year_gap(later: str | Column, earlier: str | Column) -> Column:
    """Calendar-year difference, never below 0; null if either date is null."""
    gap = F.year(_col(later)) - F.year(_col(earlier))
    return F.when(gap < 0, F.lit(0)).otherwise(gap)


def label_from_classes(c: str | Column, classes: Sequence[str]) -> Column:
    """1 if the value is one of ``classes``; anything else, null included, is 0."""
    return F.coalesce(_col(c).isin(list(classes)), F.lit(False)).cast("int")


def ordinal_encode(c: str | Column, mapping: Mapping[str, int]) -> Column:
    """Dictionary lookup; a value outside the mapping becomes null."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), _col(c))


def signed_log(c: str | Column) -> Column:
    """ln x above 0, -ln(-x) below 0, 0 at 0."""
    c = _col(c)
    return F.when(c > 0, F.ln(c)).when(c < 0, -F.ln(-c)).when(c == 0, F.lit(0.0))


def floor_log(c: str | Column) -> Column:
    """ln x above 0, else 0."""
    c = _col(c)
    return F.when(c > 0, F.ln(c)).when(c <= 0, F.lit(0.0))


def clip(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound the value on either or both sides; null stays null."""
    c = _col(c)
    out = c
    if hi is not None:
        out = F.when(c > F.lit(hi), F.lit(hi)).otherwise(out)
    if lo is not None:
        out = F.when(c < F.lit(lo), F.lit(lo)).otherwise(out)
    return out


def polynomial(c: str | Column, degree: int = 2, prefix: str = "x") -> list[Column]:
    """Columns ``prefix0 .. prefix<degree>`` holding 1, x, x^2, ..."""
    c = _col(c).cast("double")
    out, power = [F.lit(1.0).alias(f"{prefix}0")], None
    for k in range(1, degree + 1):
        power = c if power is None else power * c
        out.append(power.alias(f"{prefix}{k}"))
    return out


def apply_threshold(p: str | Column, t: float) -> Column:
    return (_col(p) >= F.lit(float(t))).cast("int")


def hash_order(id_col: str | Column, seed: int) -> Column:
    """52 bits of md5(id:seed) as a bigint: the order behind every split and shuffle here.

    It depends on the row only, not on partitioning, so a retried task gives the same split; 52
    bits are exact as a double.
    """
    digest = F.md5(F.concat(_col(id_col).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
