"""Exact order statistics and quantiles without gathering a column in one task.

``percentile`` keeps one map of all distinct values per column in a single task. Here sketches
only *locate* a rank: each round asks them for a narrow bracket, counts exactly how many rows fall
below, on and between its ends, and goes on inside the part that holds the rank. What is left after
one or two rounds is sorted. Sketch errors cost rounds, never accuracy. Sketches of scan tasks are
merged in two steps, so no task takes one from every scan task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GATHER_ROWS = 200_000  # rows of one bracket that may be sorted together
GATHER_AT_ONCE = 10_000  # the same where a bracket is at hand, counting being cheaper than sorting
SKETCH_ACCURACY = 8192  # size parameter of the sketches
SKETCH_GROUPS = 512  # sketches that the last step of a merge takes at most


@dataclass(frozen=True)
class OrderStat:
    value: float | int
    below: int  # rows smaller than the value
    equal: int  # rows equal to the value


@dataclass
class _Search:
    expr: Column
    rank: int  # 0-based, among the non-null values of expr
    rows: int
    lo: float | int | None = None  # open interval (lo, hi) still to be searched
    hi: float | int | None = None
    below: int = 0  # rows at or under lo
    found: OrderStat | None = None

    def inside(self) -> Column:
        cond = self.expr.isNotNull()
        if self.lo is not None:
            cond = cond & (self.expr > F.lit(self.lo))
        if self.hi is not None:
            cond = cond & (self.expr < F.lit(self.hi))
        return cond


def order_statistics(
    df: DataFrame,
    targets: Mapping[object, tuple[Column, int]],
    counts: Mapping[object, int],
    brackets: Mapping[object, tuple[float | int, float | int]] | None = None,
    gather_rows: int = GATHER_ROWS,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[object, OrderStat]:
    """Value at each 0-based rank. ``targets``: name -> (expression, rank); all expressions have
    one type (numbers exact as doubles), and ``counts`` gives the number of non-null values behind each. ``brackets`` are
    guesses of where a target lies; a wrong one costs a round."""
    searches: dict[object, _Search] = {}
    for name, (expr, rank) in targets.items():
        if not 0 <= rank < counts[name]:
            raise ValueError(f"rank {rank} of {counts[name]} values")
        searches[name] = _Search(expr, rank, counts[name])

    guesses = dict(brackets or {})
    while True:
        wide = {
            name: s
            for name, s in searches.items()
            if s.found is None and s.rows > min(gather_rows, GATHER_AT_ONCE if name in guesses else gather_rows)
        }
        if not wide:
            break
        ends = _sketch(df, {n: s for n, s in wide.items() if n not in guesses}, accuracy)
        ends.update({n: guesses.pop(n) for n in list(guesses) if n in wide})
        _narrow(df, wide, ends)
    _finish(df, [s for s in searches.values() if s.found is None])
    return {name: s.found for name, s in searches.items()}


def sketched(
    df: DataFrame, asks: Sequence[tuple[Column, Sequence[float]]], accuracy: int = SKETCH_ACCURACY, also: Sequence[Column] = ()
) -> tuple[list[list[float] | None], list]:
    """For each (expression, shares): approximate quantiles at the shares, None without values; and the sums of ``also``.

    Scan tasks' sketches meet in groups by partition number, then the groups' sketches in one task.
    """
    values = [e.cast("double").alias(f"_v{i}") for i, (e, _) in enumerate(asks)]
    rows = df.select(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("_g"), *values, *[c.alias(f"_a{i}") for i, c in enumerate(also)])
    parts = rows.groupBy("_g").agg(
        *[F.kll_sketch_agg_double(f"_v{i}", accuracy).alias(f"_s{i}") for i in range(len(asks))],
        *[F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(asks))],
        *[F.sum(f"_a{i}").alias(f"_a{i}") for i in range(len(also))],
    )
    # a group without values has no sketch to merge
    held = [F.when(F.col(f"_n{i}") > 0, F.col(f"_s{i}")) for i in range(len(asks))]
    merged = parts.agg(
        *[F.kll_merge_agg_double(h).alias(f"_s{i}") for i, h in enumerate(held)],
        *[F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(asks))],
        *[F.sum(f"_a{i}").alias(f"_a{i}") for i in range(len(also))],
    )
    out = [
        F.when(F.col(f"_n{i}") > 0, F.kll_sketch_get_quantile_double(f"_s{i}", F.array(*[F.lit(float(p)) for p in shares])))
        for i, (_, shares) in enumerate(asks)
    ]
    row = merged.select(*out, *[F.col(f"_a{i}") for i in range(len(also))]).first()
    return [None if q is None else list(q) for q in row[: len(asks)]], list(row[len(asks) :])


def _groups(searches: Mapping[object, _Search]) -> list[list[object]]:
    """Names of the searches that go on in the same interval of the same expression."""
    out: dict[tuple, list[object]] = {}
    for name, s in searches.items():
        out.setdefault((str(s.expr), s.lo, s.hi), []).append(name)
    return list(out.values())


def _around(at: float, accuracy: int) -> list[float]:
    """Shares of rows very likely on either side of share ``at`` by a sketch's error."""
    off = 2.5 / accuracy**0.94
    return [max(0.0, at - off), min(1.0, at + off)]


def _sketch(df: DataFrame, searches: Mapping[object, _Search], accuracy: int) -> dict[object, tuple]:
    """A bracket for every search; those in one interval share one sketch."""
    if not searches:
        return {}
    asks, groups = [], _groups(searches)
    for names in groups:
        first = searches[names[0]]
        shares = [p for n in names for p in _around((searches[n].rank - searches[n].below) / first.rows, accuracy)]
        asks.append((F.when(first.inside(), first.expr), shares))
    row, _ = sketched(df, asks, accuracy)
    return {n: (row[i][2 * k], row[i][2 * k + 1]) for i, names in enumerate(groups) for k, n in enumerate(names)}


def _count_around(df: DataFrame, groups: list[tuple[Column, list[float]]]) -> list[dict[float, tuple[int, int]]]:
    """Per group (expression, ascending cuts): rows below and rows at every cut.

    Each row finds its bin by binary search and is counted once per group; a cut has a bin of its
    own, which ends at the next larger double. Cuts are exact as doubles.
    """
    binned, cells, spots = df, [], []
    for g, (expr, cuts) in enumerate(groups):
        splits = sorted({float(c) for c in cuts} | {math.nextafter(c, math.inf) for c in cuts})
        spots.append(splits)
        binned = binned.withColumn(f"_v{g}", expr.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
        stage = Bucketizer(
            splits=[-math.inf, *splits, math.inf], inputCol=f"_v{g}", outputCol=f"_b{g}", handleInvalid="keep"
        )
        binned = stage.transform(binned)
        bin_no = F.col(f"_b{g}").cast("int")
        cells.append(F.when(bin_no.isNotNull(), F.struct(F.lit(g).alias("g"), bin_no.alias("b"))))
    rows = (
        binned.select(F.explode(F.array_compact(F.array(*cells))).alias("c"))
        .groupBy("c.g", "c.b")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()  # twice the number of cuts at most
    )
    out = []
    for g, (_, cuts) in enumerate(groups):
        sizes = {r.b: r.n for r in rows if r.g == g}
        found = {}
        for c in cuts:
            at = spots[g].index(float(c)) + 1
            found[c] = (sum(n for b, n in sizes.items() if b < at), sizes.get(at, 0))
        out.append(found)
    return out


def _narrow(df: DataFrame, searches: Mapping[object, _Search], ends: Mapping[object, tuple]) -> None:
    """Count exactly at both ends of every bracket and keep the part that holds the rank."""
    names_of = _groups(searches)
    asked = []
    for names in names_of:
        first = searches[names[0]]
        asked.append((F.when(first.inside(), first.expr), sorted({e for n in names for e in ends[n]})))
    counted = _count_around(df, asked)

    for names, found in zip(names_of, counted):
        for name in names:
            s, (a, b) = searches[name], ends[name]
            (lt_a, on_a), (lt_b, on_b) = found[a], found[b]
            at = s.rank - s.below
            if at < lt_a:
                s.hi, s.rows = a, lt_a
            elif at < lt_a + on_a:
                s.found = OrderStat(a, s.below + lt_a, on_a)
            elif at < lt_b:
                s.lo, s.hi, s.below, s.rows = a, b, s.below + lt_a + on_a, lt_b - lt_a - on_a
            elif at < lt_b + on_b:
                s.found = OrderStat(b, s.below + lt_b, on_b)
            else:
                s.lo, s.below, s.rows = b, s.below + lt_b + on_b, s.rows - lt_b - on_b


def _finish(df: DataFrame, searches: list[_Search]) -> None:
    """Count the values of every remaining (small) bracket and read off the ranks."""
    if not searches:
        return
    # brackets that agree are counted once (neighbouring ranks of one column mostly do)
    brackets: dict[tuple, list[_Search]] = {}
    for s in searches:
        brackets.setdefault((str(s.expr), s.lo, s.hi), []).append(s)
    groups = list(brackets.values())
    cells = [
        F.when(g[0].inside(), F.struct(F.lit(i).alias("b"), g[0].expr.alias("v")))
        for i, g in enumerate(groups)
    ]
    running = Window.partitionBy("b").orderBy("v")
    values = (
        df.select(F.explode(F.array_compact(F.array(*cells))).alias("c"))
        .groupBy(F.col("c.b").alias("b"), F.col("c.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(running))
    )
    wanted = F.lit(False)
    for i, g in enumerate(groups):
        for at in sorted({s.rank - s.below for s in g}):
            hit = (F.col("b") == i) & (F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)
            wanted = wanted | hit
    rows = values.where(wanted).collect()  # one row per distinct target at most
    for i, g in enumerate(groups):
        for s in g:
            at = s.rank - s.below
            row = next(r for r in rows if r.b == i and r.upto > at >= r.upto - r.n)
            s.found = OrderStat(row.v, s.below + row.upto - row.n, row.n)


def exact_quantiles(
    df: DataFrame,
    exprs: Mapping[str, Column],
    probs: Sequence[float],
    gather_rows: int = GATHER_ROWS,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between neighbouring values; None for an empty column."""
    exprs = {name: e.cast("double") for name, e in exprs.items()}
    # one pass gives the sizes and, a quantile being a share, the first brackets too
    shares = [x for p in probs for x in _around(p, accuracy)]
    first, held = sketched(df, [(e, shares) for e in exprs.values()], accuracy, [e.isNotNull().cast("long") for e in exprs.values()])
    sizes = {name: held[i] or 0 for i, name in enumerate(exprs)}
    targets, counts, brackets = {}, {}, {}
    for i, (name, e) in enumerate(exprs.items()):
        if not sizes[name]:
            continue
        for k, p in enumerate(probs):
            at = p * (sizes[name] - 1)
            for rank in {math.floor(at), math.ceil(at)}:
                targets[name, rank] = (e, rank)
                counts[name, rank] = sizes[name]
                brackets[name, rank] = (first[i][2 * k], first[i][2 * k + 1])
    stats = order_statistics(df, targets, counts, brackets, gather_rows, accuracy) if targets else {}
    out: dict[str, list[float | None]] = {}
    for name in exprs:
        if not sizes[name]:
            out[name] = [None] * len(probs)
            continue
        line = []
        for p in probs:
            at = p * (sizes[name] - 1)
            a, b = stats[name, math.floor(at)].value, stats[name, math.ceil(at)].value
            line.append(a + (b - a) * (at - math.floor(at)))
        out[name] = line
    return out


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], **limits: int) -> DataFrame:
    """Table ``(column, prob, value)``."""
    found = exact_quantiles(df, {c: F.col(c) for c in cols}, probs, **limits)
    rows = [(c, float(p), v) for c in cols for p, v in zip(probs, found[c])]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")
