"""Global ranks and running sums by score, without a one-task window.

Rows are cut into slots by value: the cut points come from a sketch, so they only balance the
work; a row's slot depends on its values alone, so a retried task puts it in the same place. Each
slot is ranked by itself, and the totals of the slots before it (a table of a few thousand rows at
most) are added. A score shared by very many rows spans several cut points; its rows are divided
further by id, in proportion to their number; ids may be numbers or texts.
"""

from __future__ import annotations

import math
import os
from collections.abc import Sequence
from itertools import groupby

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tallygrove.operators.order_stats import sketched

SLOT = "_slot"
MAX_SLOTS = 8192  # bounds the sketch and the broadcast of slot totals


def with_slots(df: DataFrame, key: str, tie: str | None = None, slots: int | None = None) -> DataFrame:
    """Add ``_slot``: non-decreasing in (key, tie), about equal row counts per slot."""
    slots = slots or min(MAX_SLOTS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / slots for i in range(1, slots)]
    bad = F.col(key).isNull() | F.isnan(F.col(key).cast("double"))
    accuracy = min(32_768, max(4096, 4 * slots))
    (cuts,), (missing,) = sketched(df, [(F.col(key), probs)], accuracy, [bad.cast("long")])
    if missing:
        raise ValueError(f"{missing} rows have no value in '{key}'")
    runs = [(v, len(list(g))) for v, g in groupby(cuts or [])]
    hot = {v: n for v, n in runs if n > 1 and math.isfinite(v)} if tie else {}
    splits = sorted({v for v, _ in runs if math.isfinite(v)} | {math.nextafter(v, math.inf) for v in hot})
    out = bucket(df.withColumn("_key", F.col(key).cast("double") + F.lit(0.0)), "_key", splits, SLOT)
    if not hot:
        return out.drop("_key")

    # sub-slots by id inside the scores that fill more than one slot
    tied = df.where(F.col(key).cast("double").isin(list(hot)))
    number = _in_order(tied, tie)
    (id_cuts,), _ = sketched(tied, [(number, probs)], accuracy)
    fine = sorted(set(id_cuts or []))
    parts = [1] * (len(splits) + 1)
    for v, n in hot.items():
        parts[splits.index(v) + 1] = n
    starts = [sum(parts[:i]) for i in range(len(parts))]
    out = bucket(out.withColumn("_tie", number.cast("double")), "_tie", fine, "_fine")
    share = F.floor(F.col("_fine") * F.get(F.lit(parts), F.col(SLOT)) / F.lit(len(fine) + 1))
    return out.withColumn(SLOT, F.get(F.lit(starts), F.col(SLOT)) + share.cast("int")).drop("_key", "_tie", "_fine")


def _in_order(rows: DataFrame, tie: str) -> Column:
    """A number that never falls where ``tie`` rises among these rows: itself, or the six bytes of its text after what all
    texts begin with. Other types go by their text, if that keeps their order (dates and times do)."""
    if isinstance(rows.schema[tie].dataType, NumericType):
        return F.col(tie)
    text = F.col(tie).cast("string")
    low, high = rows.agg(F.min(text), F.max(text)).first()
    shared = os.path.commonprefix([(low or "").encode(), (high or "").encode()])
    after = F.substring(text.cast("binary"), len(shared) + 1, 6)
    return F.coalesce(F.conv(F.rpad(F.hex(after), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))


def bucket(df: DataFrame, col: str, splits: Sequence[float], out: str) -> DataFrame:
    if not splits:
        return df.withColumn(out, F.lit(0))
    stage = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol=col, outputCol=out, handleInvalid="keep")
    # never null (checked above), and said so: the join on the slot then needs no filter of its own
    return stage.transform(df).withColumn(out, F.coalesce(F.col(out).cast("int"), F.lit(0)))


def _offsets(slotted: DataFrame, sums: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per slot: rows and sums of all earlier slots, and the totals."""
    totals = slotted.groupBy(*by, SLOT).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums]
    )
    group = Window.partitionBy(*(by or [F.lit(0)]))
    earlier = group.orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    pick = [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("n_rows")]
    for c in sums:
        s = F.col(f"_s_{c}")
        pick += [
            F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_before_{c}"),
            F.sum(s).over(group).alias(f"total_{c}"),
        ]
    return totals.select(*by, SLOT, *pick)


def _few(offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row per slot is always small enough to broadcast; of many groups the planner decides."""
    return offsets if by else F.broadcast(offsets)


def running_rows(
    df: DataFrame,
    key: str,
    tie: str,
    sums: Sequence[str] = (),
    by: Sequence[str] = (),
    slots: int | None = None,
) -> DataFrame:
    """Per row: ``row_no`` (1-based, by key then tie), ``run_<c>`` inclusive running sums,
    ``n_rows`` and ``total_<c>``. ``by`` names a column of few values (split, label)."""
    slotted = with_slots(df, key, tie, slots)
    win = Window.partitionBy(*by, SLOT).orderBy(key, tie)
    upto = win.rowsBetween(Window.unboundedPreceding, 0)
    local = slotted.withColumns(
        {"_no": F.row_number().over(win), **{f"_run_{c}": F.sum(c).over(upto) for c in sums}}
    )
    joined = local.join(_few(_offsets(slotted, sums, by), by), [*by, SLOT])
    return joined.select(
        *df.columns,
        (F.col("_before") + F.col("_no")).alias("row_no"),
        *[(F.col(f"_before_{c}") + F.col(f"_run_{c}")).alias(f"run_{c}") for c in sums],
        "n_rows",
        *[f"total_{c}" for c in sums],
    )


def running_points(
    df: DataFrame,
    key: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    slots: int | None = None,
) -> DataFrame:
    """Per distinct key: ``n`` rows and summed ``sums`` at the key, ``run_n`` and ``run_<c>`` up to
    and with it, ``n_rows`` and ``total_<c>``. Ties are merged before the shuffle."""
    slotted = with_slots(df.select(*by, key, *sums), key, None, slots)
    points = slotted.groupBy(*by, SLOT, key).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums]
    )
    upto = Window.partitionBy(*by, SLOT).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    local = points.withColumns(
        {"_run_n": F.sum("n").over(upto), **{f"_run_{c}": F.sum(c).over(upto) for c in sums}}
    )
    joined = local.join(_few(_offsets(slotted, sums, by), by), [*by, SLOT])
    return joined.select(
        *by,
        key,
        "n",
        *sums,
        (F.col("_before") + F.col("_run_n")).alias("run_n"),
        *[(F.col(f"_before_{c}") + F.col(f"_run_{c}")).alias(f"run_{c}") for c in sums],
        "n_rows",
        *[f"total_{c}" for c in sums],
    )


def gains_table(df: DataFrame, p: str = "p", label: str = "label", tie: str = "id", bins: int = 10) -> DataFrame:
    """Riskiest first: bin 1 holds the highest scores. Rank r of n goes to the bin whose interval
    (lo, hi] of the evenly spaced cuts of 1..n holds r."""
    ranked = running_rows(df.select(tie, label, p, (-F.col(p)).alias("_down")), "_down", tie)
    r, n = F.col("row_no"), F.col("n_rows")
    bin_no = F.when(n == 1, F.lit(1)).otherwise(
        F.expr(f"greatest(1, ((row_no - 1) * {bins} + n_rows - 2) div greatest(n_rows - 1, 1))")
    )
    per_bin = ranked.groupBy(bin_no.cast("int").alias("decile")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("bads"), F.avg(p).alias("avg_p")
    )
    upto = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)  # over `bins` rows
    every = Window.partitionBy(F.lit(0))
    cum_n, cum_bads = F.sum("n").over(upto), F.sum("bads").over(upto)
    all_bads = F.sum("bads").over(every)
    base = all_bads / F.sum("n").over(every)
    rate = F.col("bads") / F.col("n")
    return per_bin.select(
        "decile",
        "n",
        "bads",
        rate.alias("bad_rate"),
        "avg_p",
        F.try_divide(rate, base).alias("lift"),
        cum_n.alias("cum_n"),
        cum_bads.alias("cum_bads"),
        (cum_bads / cum_n).alias("cum_bad_rate"),
        F.try_divide(cum_bads, all_bads).alias("capture"),
    )


def safest_first_table(df: DataFrame, p: str = "p", label: str = "label", tie: str = "id", bins: int = 10) -> DataFrame:
    """Safest first: 0-based rank r of n goes to bin r*bins div n. Empty bins are kept."""
    ranked = running_rows(df.select(tie, label, p), p, tie, [label])
    bin_no = F.expr(f"least((row_no - 1) * {bins} div n_rows, {bins - 1}) + 1").cast("int")
    per_bin = ranked.groupBy(bin_no.alias("decile")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(p).alias("avg_p"),
        F.avg(label).alias("bad_rate"),
        F.first(F.col(f"total_{label}") / F.col("n_rows")).alias("base"),
    )
    all_bins = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("decile"))
    return all_bins.join(F.broadcast(per_bin), "decile", "left").select(
        "decile",
        F.coalesce("n", F.lit(0)).alias("n"),
        "avg_p",
        "bad_rate",
        (F.col("bad_rate") / (F.col("base") + F.lit(1e-12))).alias("lift"),
    )


def topk_capture(
    df: DataFrame,
    fractions: Sequence[float] = (0.01, 0.05, 0.10, 0.20),
    p: str = "p",
    label: str = "label",
    tie: str = "id",
) -> DataFrame:
    """Positives caught in the m = max(1, half-even round of k*n) highest scores."""
    ranked = running_rows(df.select(tie, label, (-F.col(p)).alias("_down")), "_down", tie, [label])
    cells = []
    for k in fractions:
        m = F.greatest(F.lit(1), F.bround(F.lit(float(k)) * F.col("n_rows"), 0)).cast("bigint")
        cells.append(F.when(F.col("row_no") <= m, F.struct(F.lit(float(k)).alias("fraction"), m.alias("m"))))
    return (
        ranked.select(label, f"total_{label}", F.explode(F.array_compact(F.array(*cells))).alias("c"))
        .groupBy("c.fraction", "c.m")
        .agg(F.sum(label).alias("captured"), F.first(f"total_{label}").alias("positives"))
        .select(
            "fraction",
            "m",
            "captured",
            F.try_divide("captured", "positives").alias("capture_rate"),
            (F.col("captured") / F.col("m")).alias("bad_rate"),
        )
    )


def rank_by_abs(coefficients: DataFrame, prefix: str | None = None) -> DataFrame:
    """Coefficients, largest magnitude first; ``prefix`` keeps one block of features."""
    if prefix is not None:
        coefficients = coefficients.where(F.col("feature").startswith(prefix))
    return coefficients.orderBy(F.abs("coefficient").desc(), "feature")
