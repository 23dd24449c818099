"""Exact, repeatable splits.

Rows are ordered by a hash of their id. The hash value standing at the cut is found by exact
selection, after which every row knows its side by comparing its own hash: no sort of the table, no
shuffle, the same split whatever the partitioning and after any retry.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.functions.scalars import hash_order
from tallygrove.operators.order_stats import order_statistics

Cut = tuple[int, int | None]  # last hash inside, and the last id inside if that hash is shared


HASH = "_h"


def _hashed(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """The hash as a column of its own: it is used many times and computed once."""
    return df.withColumn(HASH, hash_order(id_col, seed))


def _cuts(hashed: DataFrame, id_col: str, sizes: Mapping[object, tuple[Column, int, Sequence[int]]]) -> dict:
    """For every group (condition, rows) the cut after each given number of rows."""
    h = F.col(HASH)
    targets, counts, brackets = {}, {}, {}
    for name, (cond, rows, firsts) in sizes.items():
        for m in firsts:
            if 0 < m < rows:
                targets[name, m] = (F.when(cond, h), m - 1)
                counts[name, m] = rows
                # hashes are even, so the cut lies within a few deviations of its share
                share, off = m / rows, 8 * math.sqrt(m * (rows - m) / rows) / rows
                brackets[name, m] = tuple(int(min(max(share + d, 0.0), 1.0) * 2**52) for d in (-off, off))
    stats = order_statistics(hashed, targets, counts, brackets) if targets else {}
    shared = {k: s for k, s in stats.items() if s.equal > 1}
    ids = {}
    if shared:  # equal hashes are divided by id
        ids = order_statistics(
            hashed,
            {
                k: (F.when(targets[k][0] == F.lit(s.value), F.col(id_col).cast("bigint")), targets[k][1] - s.below)
                for k, s in shared.items()
            },
            {k: s.equal for k, s in shared.items()},
        )
    return {k: (s.value, ids[k].value if k in ids else None) for k, s in stats.items()}


def _first_rows(cuts: dict, name: object, m: int, rows: int, id_col: str) -> Column:
    """Is the row among the first m of its group?"""
    if m <= 0:
        return F.lit(False)
    if m >= rows:
        return F.lit(True)
    h = F.col(HASH)
    value, last_id = cuts[name, m]
    if last_id is None:
        return h <= F.lit(value)
    return (h < F.lit(value)) | ((h == F.lit(value)) & (F.col(id_col) <= F.lit(last_id)))


def split_by_sizes(df: DataFrame, sizes: Sequence[tuple[str, int]], rest: str, seed: int, id_col: str = "id") -> DataFrame:
    """Add ``split``: the first rows in hash order get the first name, and so on; others ``rest``."""
    rows = df.count()
    ends, total = [], 0
    for _, m in sizes:
        total += m
        ends.append(total)
    if total > rows:
        raise ValueError(f"{total} rows wanted, {rows} present")
    hashed = _hashed(df, id_col, seed)
    cuts = _cuts(hashed.select(id_col, HASH), id_col, {"all": (F.lit(True), rows, ends)})
    side = F.lit(rest)
    for (name, _), end in reversed(list(zip(sizes, ends))):
        side = F.when(_first_rows(cuts, "all", end, rows, id_col), F.lit(name)).otherwise(side)
    return hashed.withColumn("split", side).drop(HASH)


def split_random(df: DataFrame, test_fraction: float, seed: int, id_col: str = "id") -> DataFrame:
    """``ceil(fraction * n)`` test rows, the rest train."""
    test = math.ceil(test_fraction * df.count())
    return split_by_sizes(df, [("test", test)], "train", seed, id_col)


def split_exact(df: DataFrame, n_train: int, n_test: int, seed: int, id_col: str = "id") -> DataFrame:
    return split_by_sizes(df, [("train", n_train), ("test", n_test)], "validation", seed, id_col)


def quotas(counts: Mapping[object, int], total: int) -> dict:
    """Largest-remainder shares of ``total`` proportional to ``counts``; ties by class order."""
    n = sum(counts.values())
    base = {k: c * total // n for k, c in counts.items()}
    order = sorted(counts, key=lambda k: (-(counts[k] * total % n), k))
    for k in order[: total - sum(base.values())]:
        base[k] += 1
    return base


def split_stratified(
    df: DataFrame,
    seed: int,
    label: str = "label",
    test_fraction: float = 0.20,
    validation_fraction: float = 0.25,
    id_col: str = "id",
) -> DataFrame:
    """Test rows first, validation rows from what is left (60/20/20 by default), each class in
    proportion."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per class
    n = sum(counts.values())
    n_test = math.ceil(test_fraction * n)
    test = quotas(counts, n_test)
    left = {k: c - test[k] for k, c in counts.items()}
    val = quotas(left, math.ceil(validation_fraction * (n - n_test)))
    groups = {k: (F.col(label) == F.lit(k), c, [test[k], test[k] + val[k]]) for k, c in counts.items()}
    hashed = _hashed(df, id_col, seed)
    cuts = _cuts(hashed.select(id_col, label, HASH), id_col, groups)
    is_test, is_val = F.lit(False), F.lit(False)
    for k, (cond, c, (a, b)) in groups.items():
        is_test = is_test | (cond & _first_rows(cuts, k, a, c, id_col))
        is_val = is_val | (cond & _first_rows(cuts, k, b, c, id_col))
    side = F.when(is_test, "test").when(is_val, "validation").otherwise("train")
    return hashed.withColumn("split", side).drop(HASH)


def shuffle_rows(df: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    """Rows in hash order, features and label together."""
    return df.orderBy(hash_order(id_col, seed), id_col)
