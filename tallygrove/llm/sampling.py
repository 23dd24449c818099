"""Bounded samples for fitting, and the hold-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 30


def remainder(key: str, modulus: int) -> Column:
    """crc32 of a column's text, modulo ``modulus``; of a null, 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")


def bounded_by_class(rows: DataFrame, key: str, label: str, per_class: int, total: int | None = None) -> DataFrame:
    """About ``per_class`` rows (with ``total``, fewer of many classes) of each label, never more than 1.5 times that in all.

    Counts cover all rows; a row is taken by the hash of its ``key`` and, where too many are, by the least hashes, so a rerun
    takes the same.
    """
    found = rows.filter(F.col(label).isNotNull()).groupBy(label).count().collect()  # a row a class
    if not found:
        return rows.limit(0)
    if total:
        per_class = max(1, min(per_class, total // len(found)))
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(20240229)), F.lit(_RANGE))
    shares = [x for value, count in sorted(found) for x in (F.lit(value), F.lit(int(min(1.0, per_class / count) * _RANGE)))]
    taken = rows.filter(draw < F.coalesce(F.try_element_at(F.create_map(*shares), F.col(label)), F.lit(0)))
    return taken.orderBy(draw, F.xxhash64(*rows.columns)).limit(per_class * len(found) * 3 // 2)
