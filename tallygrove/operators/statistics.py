"""Column statistics. One aggregation serves all columns wherever the measure allows it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.operators.order_stats import exact_quantiles, sketched


def _unstack(row: DataFrame, cells: Sequence[Column]) -> DataFrame:
    """One aggregate row -> one row per struct."""
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _per_column(df: DataFrame, cols: Sequence[str], measures: dict[str, object]) -> DataFrame:
    aggs = [f(c).alias(f"{m}_{i}") for i, c in enumerate(cols) for m, f in measures.items()]
    cells = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{m}_{i}").alias(m) for m in measures])
        for i, c in enumerate(cols)
    ]
    return _unstack(df.agg(*aggs), cells)


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label)


def class_balance(df: DataFrame, by: str = "split", label: str = "label") -> DataFrame:
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) == 1).alias("ones"),
        F.count_if(F.col(label) == 0).alias("zeros"),
        F.avg(label).alias("positive_rate"),
        F.count_distinct(label).alias("labels"),
    )


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def binary_like(df: DataFrame, cols: Sequence[str], declared: Sequence[str] = ()) -> DataFrame:
    """Which columns hold nothing but 0 and 1 (nulls aside), or are declared to."""

    def only_01(c: str) -> Column:
        return F.coalesce(F.bool_and(F.col(c).isin(0, 1)), F.lit(True)) | F.lit(c in declared)

    return _per_column(df, cols, {"is_binary": only_01})


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean with population variance and standard deviation, as scaling uses.

    Merging partial means may leave a constant column a last-digit spread, so a constant is told by
    its ends and gets exactly 0.
    """

    def unless_constant(measure: Callable) -> Callable:
        return lambda c: F.when(F.min(c) < F.max(c), measure(c)).when(F.count(c) > 0, F.lit(0.0))

    mean = lambda c: F.when(F.min(c) < F.max(c), F.avg(c)).otherwise(F.min(c).cast("double"))
    return _per_column(
        df, cols, {"n": F.count, "mean": mean, "var_pop": unless_constant(F.var_pop), "std_pop": unless_constant(F.stddev_pop)}
    )


WIDE = 12  # beyond this many columns one aggregate per pair makes the plan too large; the answers are the same


def _value(name: str) -> Column:
    """A column as a number; NaN is missing, like null."""
    x = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(x), x)


def _pair_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per pair of columns (i, j), over their complete rows: n, the sums of x, y, xx, yy, xy, and whether x and y vary.

    Every task adds up its Arrow batches as matrices and emits one row per pair, so the shuffle
    does not grow with the table. Values are taken around the column means (a constant column
    around its value, which leaves exact zeros), so that no large sums are subtracted.
    """
    k = len(cols)
    x = [_value(c) for c in cols]
    middle = df.agg(*[F.when(F.min(v) == F.max(v), F.min(v)).otherwise(F.avg(v)) for v in x]).first()
    centre = np.array([v or 0.0 for v in middle])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, k, k))
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64) - centre
            there = ~np.isnan(x)
            for j in range(k):
                both = there & there[:, j : j + 1]
                low[:, j] = np.minimum(low[:, j], np.where(both, x, np.inf).min(axis=0, initial=np.inf))
                high[:, j] = np.maximum(high[:, j], np.where(both, x, -np.inf).max(axis=0, initial=-np.inf))
            x, m = np.where(there, x, 0.0), there.astype(np.float64)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        i, j = np.divmod(np.arange(k * k), k)
        ends = [e.reshape(-1) for e in (low, high, low.T, high.T)]
        columns = [i.astype(np.int32), j.astype(np.int32), *total.reshape(6, -1), *ends]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", *sums, "x0", "x1", "y0", "y1"])

    sums = ["n", "x", "y", "xx", "yy", "xy"]
    fields = ", ".join(f"{c} double" for c in (*sums, "x0", "x1", "y0", "y1"))
    parts = df.select(*[v.alias(f"_x{n}") for n, v in enumerate(x)]).mapInArrow(task, f"i int, j int, {fields}")
    varies = (F.min("x0") < F.max("x1")) & (F.min("y0") < F.max("y1"))
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in sums], varies.alias("varies"))


def _named(pairs: DataFrame, cols: Sequence[str], value: Column) -> DataFrame:
    names = F.lit(list(cols))
    return pairs.select(F.get(names, F.col("i")).alias("col_a"), F.get(names, F.col("j")).alias("col_b"), value.alias("value"))


def covariance_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample covariance of every pair of columns, long form; each pair uses the rows where neither is null or NaN."""
    if len(cols) > WIDE:
        value = F.try_divide(F.col("xy") - F.try_divide(F.col("x") * F.col("y"), F.col("n")), F.col("n") - 1)
        return _named(_pair_sums(df, cols), cols, value)
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    aggs = [F.covar_samp(_value(cols[i]), _value(cols[j])).alias(f"v_{i}_{j}") for i, j in pairs]
    return _unstack(df.agg(*aggs), _square(cols))


def _square(cols: Sequence[str]) -> list[Column]:
    return [
        F.struct(
            F.lit(a).alias("col_a"),
            F.lit(b).alias("col_b"),
            F.col(f"v_{min(i, j)}_{max(i, j)}").alias("value"),
        )
        for i, a in enumerate(cols)
        for j, b in enumerate(cols)
    ]


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation, long form, over each pair's complete rows; null where a column is constant on them."""
    if len(cols) > WIDE:
        n, x, y = F.col("n"), F.col("x"), F.col("y")
        spread = F.sqrt((F.col("xx") - x * x / n) * (F.col("yy") - y * y / n))
        value = F.when((n > 1) & F.col("varies"), F.try_divide(F.col("xy") - x * y / n, spread))
        return _named(_pair_sums(df, cols), cols, value)
    aggs = []
    for i, j in combinations_with_replacement(range(len(cols)), 2):
        a, b = _value(cols[i]), _value(cols[j])
        both = a.isNotNull() & b.isNotNull()
        x, y = F.when(both, a), F.when(both, b)
        varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        value = F.when(varies, F.try_divide(F.covar_samp(a, b), F.stddev_samp(x) * F.stddev_samp(y)))
        aggs.append(value.alias(f"v_{i}_{j}"))
    return _unstack(df.agg(*aggs), _square(cols))


def high_corr_pairs(corr: DataFrame, cols: Sequence[str], threshold: float = 0.75, top: int = 50) -> DataFrame:
    """Upper triangle, |value| at or above the threshold, by signed value descending, first ``top``."""
    place = F.lit(list(cols))
    upper = F.array_position(place, F.col("col_a")) < F.array_position(place, F.col("col_b"))
    return (
        corr.where(upper & (F.abs("value") >= threshold)).orderBy(F.col("value").desc(), "col_a", "col_b").limit(top)
    )


def near_constant_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.9995) -> DataFrame:
    """Number columns whose most frequent value (null counts as one) has at least this share.

    Columns of whole numbers within 0..1, as one-hot blocks are, need only their sum. For the others
    a share above one half makes the value the column's median even by a rough sketch, so one
    candidate per column is enough: the sketch names it, a second pass counts it exactly. For lower
    thresholds all values are counted.
    """
    if threshold <= 0.501:
        return _frequent(df, cols, threshold)
    whole = {f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)}
    pos = {c: i for i, c in enumerate(cols)}
    aggs = [F.count(F.lit(1)).alias("n")]
    for c, i in pos.items():
        aggs.append(F.count(f"`{c}`").alias(f"k{i}"))
        if c in whole:
            aggs += [F.min(f"`{c}`").alias(f"a{i}"), F.max(f"`{c}`").alias(f"b{i}"), F.sum(f"`{c}`").alias(f"s{i}")]
    got = df.agg(*aggs).first()
    top: dict[str, int] = {}
    for c, i in pos.items():
        there = got[f"k{i}"]
        if there == 0:
            top[c] = got.n
        elif c in whole and got[f"a{i}"] >= 0 and got[f"b{i}"] <= 1:
            top[c] = max(got[f"s{i}"], there - got[f"s{i}"], got.n - there)
    rest = [c for c in cols if c not in top]
    if rest:
        value = {c: F.col(f"`{c}`").cast("double") for c in rest}
        mid = [q[0] if q else None for q in sketched(df, [(value[c], [0.5]) for c in rest])[0]]
        hits = df.agg(*[F.count_if(value[c] == F.lit(m)) for c, m in zip(rest, mid)]).first()
        for c, h in zip(rest, hits):
            top[c] = max(h, got.n - got[f"k{pos[c]}"])
    rows = [(c, top[c] / got.n) for c in cols if got.n and top[c] / got.n >= threshold]
    return df.sparkSession.createDataFrame(rows, "column string, top_share double")


def _frequent(df: DataFrame, cols: Sequence[str], threshold: float) -> DataFrame:
    """The same by counting the values of all columns in one shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in cols])
    counts = df.select(F.explode(cells).alias("c")).groupBy("c.column", "c.v").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("column").agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    share = F.col("top") / F.col("all")
    return top.where(share >= threshold).select("column", share.alias("top_share"))


def describe(df: DataFrame, cols: Sequence[str], **limits: int) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max per column."""
    quart = exact_quantiles(df, {c: F.col(c) for c in cols}, [0.25, 0.5, 0.75], **limits)
    base = _per_column(df, cols, {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    table = df.sparkSession.createDataFrame(
        [(c, *quart[c]) for c in cols], "column string, q25 double, q50 double, q75 double"
    )
    return base.join(F.broadcast(table), "column").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def info(df: DataFrame) -> DataFrame:
    """Rows, non-null count and type per column."""
    kinds = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("n_rows")] + [F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(df.columns)]
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(kinds[c]).alias("type"),
            F.col(f"n{i}").alias("non_null"),
            F.col("n_rows").alias("n_rows"),
        )
        for i, c in enumerate(df.columns)
    ]
    return _unstack(df.agg(*aggs), cells)


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def missing_counts(df: DataFrame) -> DataFrame:
    """Nulls per column."""
    return _per_column(df, df.columns, {"missing": lambda c: F.count_if(F.col(f"`{c}`").isNull())})


def require_complete(df: DataFrame) -> None:
    """Raise, naming the columns, if any value is missing."""
    bad = missing_counts(df).where("missing > 0").collect()  # one row per column at most
    if bad:
        raise ValueError("missing values: " + ", ".join(f"{r['column']} ({r['missing']})" for r in bad))


def scaling_check(df: DataFrame, cols: Sequence[str], top: int = 10) -> DataFrame:
    """Columns farthest from mean 0 and population std 1, the ``top`` of either kind."""
    m = moments(df, cols)
    off_mean = m.select(F.lit("mean").alias("measure"), "column", F.abs("mean").alias("off"))
    off_std = m.select(F.lit("std").alias("measure"), "column", F.abs(F.col("std_pop") - 1).alias("off"))
    return _first(off_mean, top).unionByName(_first(off_std, top))


def _first(df: DataFrame, top: int) -> DataFrame:
    return df.orderBy(F.col("off").desc(), "column").limit(top)


def scaling_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return moments(df, cols).agg(
        F.avg(F.abs("mean")).alias("mean_abs_mean"), F.avg("std_pop").alias("mean_std")
    )


def histogram(df: DataFrame, col: str, bins: int = 40, by: str | None = None) -> DataFrame:
    """Equal-width bins over min..max, the last one closed; with ``by`` each group has its own range."""
    group = [by] if by else []
    value = F.col(col).cast("double")
    clean = df.where(value.isNotNull())
    ranges = {
        (r[by] if by else None): (r.lo, r.hi)
        for r in clean.groupBy(*group).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).collect()
    }  # one row per label
    bin_no, low = F.lit(None).cast("int"), F.lit(None).cast("double")
    for key, (lo, hi) in ranges.items():
        if lo == hi:  # a constant gets a unit range around it
            lo, hi = lo - 0.5, hi + 0.5
        mine = F.lit(True) if by is None else F.col(by).eqNullSafe(F.lit(key))
        width = (hi - lo) / bins
        at = F.least(F.floor((value - lo) / F.lit(width)), F.lit(bins - 1)).cast("int")
        bin_no = F.when(mine, at).otherwise(bin_no)
        low = F.when(mine, F.lit(lo) + F.col("bin") * F.lit(width)).otherwise(low)
    counts = clean.groupBy(*group, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*group, "bin", low.alias("bin_start"), "n")
