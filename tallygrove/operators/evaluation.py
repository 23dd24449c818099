"""Evaluation of scored rows ``(id, label 0/1, p)``. Curves come back as tables.

All curve measures derive from one table of distinct scores with running counts
(:func:`score_points`); ties are merged before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions.scalars import clip
from tallygrove.operators.order_stats import exact_quantiles
from tallygrove.operators.ranking import running_points, running_rows, safest_first_table, topk_capture

# fixed values
TINY = 1e-12
STABLE_BELOW, DRIFT_ABOVE = 0.10, 0.25
F1_GRID = [i / 100 for i in range(1, 100)]


def _over(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return a / (b + F.lit(TINY))


# ---------------------------------------------------------------- threshold counts


def _counts(t: float, p: str, label: str) -> list[Column]:
    hit, pos = F.col(p) >= F.lit(float(t)), F.col(label) == 1
    return [
        F.count_if(~hit & ~pos).alias("tn"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"),
        F.count_if(hit & pos).alias("tp"),
    ]


def confusion(df: DataFrame, t: float, by: Sequence[str] = (), p: str = "p", label: str = "label") -> DataFrame:
    """tn, fp, fn, tp; absent classes count 0."""
    return df.groupBy(*by).agg(*_counts(t, p, label))


def confusion_shares(df: DataFrame, t: float, p: str = "p", label: str = "label") -> DataFrame:
    """Row-normalised confusion matrix in long form."""
    c = confusion(df, t, (), p, label)
    neg, pos = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    cells = [(0, 0, "tn", neg), (0, 1, "fp", neg), (1, 0, "fn", pos), (1, 1, "tp", pos)]
    return c.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("actual"),
                        F.lit(b).alias("predicted"),
                        F.col(n).alias("n"),
                        _over(n, total).alias("share"),
                    )
                    for a, b, n, total in cells
                ]
            )
        ).alias("c")
    ).select("c.*")


def classification_report(df: DataFrame, t: float, p: str = "p", label: str = "label") -> DataFrame:
    """Per class and averaged precision, recall, F1 and support, to four digits; x/0 counts as 0."""
    c = confusion(df, t, (), p, label)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp

    def safe(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    def line(hit: Column, false_alarm: Column, miss: Column) -> list[Column]:
        pr, rc = safe(hit, hit + false_alarm), safe(hit, hit + miss)
        return [pr, rc, safe(2 * pr * rc, pr + rc), hit + miss]

    zero, one = line(tn, fn, fp), line(tp, fp, fn)
    accuracy = safe(tn + tp, n)
    macro = [(a + b) / 2 for a, b in zip(zero[:3], one[:3])]
    weighted = [safe(a * zero[3] + b * one[3], n) for a, b in zip(zero[:3], one[:3])]
    lines = [
        ("0", *zero),
        ("1", *one),
        ("accuracy", accuracy, accuracy, accuracy, n),
        ("macro avg", *macro, n),
        ("weighted avg", *weighted, n),
    ]
    cells = [
        F.struct(
            F.lit(name).alias("class"),
            F.round(pr, 4).alias("precision"),
            F.round(rc, 4).alias("recall"),
            F.round(f1, 4).alias("f1"),
            support.alias("support"),
        )
        for name, pr, rc, f1, support in lines
    ]
    return c.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def accuracy(df: DataFrame, prediction: str, label: str = "label") -> DataFrame:
    return df.agg(F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"))


def regression_metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Mean absolute error and R2 = 1 - SSE/SST around the truth's mean."""
    err = F.col(truth) - F.col(prediction)
    sums = df.agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("_sse"),
        (F.var_pop(truth) * F.count(truth)).alias("_sst"),
    )
    return sums.select("mae", (F.lit(1.0) - F.try_divide("_sse", "_sst")).alias("r2"))


# ---------------------------------------------------------------- losses


def log_loss_expr(p: str = "p", label: str = "label") -> Column:
    q = clip(p, TINY, 1 - TINY)
    return -F.avg(F.when(F.col(label) == 1, F.ln(q)).otherwise(F.ln(F.lit(1.0) - q)))


def brier_expr(p: str = "p", label: str = "label") -> Column:
    return F.avg((F.col(p) - F.col(label)) * (F.col(p) - F.col(label)))


def log_loss(df: DataFrame, p: str = "p", label: str = "label") -> DataFrame:
    return df.agg(log_loss_expr(p, label).alias("log_loss"))


def brier(df: DataFrame, p: str = "p", label: str = "label") -> DataFrame:
    return df.agg(brier_expr(p, label).alias("brier"))


# ---------------------------------------------------------------- curves over distinct scores


def score_points(df: DataFrame, by: Sequence[str] = (), p: str = "p", label: str = "label") -> DataFrame:
    """Per distinct score, highest first: counts at the score (n, pos) and at or above it
    (run_n, tp, fp), with the totals n_rows, positives, negatives."""
    points = running_points(
        df.select(*by, F.col(label).cast("bigint").alias("pos"), (-F.col(p).cast("double")).alias("_down")),
        "_down",
        ["pos"],
        by,
    )
    return points.select(
        *by,
        (-F.col("_down")).alias("threshold"),
        "n",
        "pos",
        "run_n",
        F.col("run_pos").alias("tp"),
        (F.col("run_n") - F.col("run_pos")).alias("fp"),
        "n_rows",
        F.col("total_pos").alias("positives"),
        (F.col("n_rows") - F.col("total_pos")).alias("negatives"),
    )


def _roc_of(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return points.select(
        *by,
        "threshold",
        F.try_divide("fp", "negatives").alias("fpr"),
        F.try_divide("tp", "positives").alias("tpr"),
    )


def _pr_of(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return points.select(
        *by,
        "threshold",
        (F.col("tp") / F.col("run_n")).alias("precision"),
        F.try_divide("tp", "positives").alias("recall"),
    )


def roc_points(df: DataFrame, by: Sequence[str] = (), p: str = "p", label: str = "label") -> DataFrame:
    return _roc_of(score_points(df, by, p, label), by)


def pr_points(df: DataFrame, by: Sequence[str] = (), p: str = "p", label: str = "label") -> DataFrame:
    return _pr_of(score_points(df, by, p, label), by)


def auc_expr() -> Column:
    """Aggregate over score points: share of (positive, negative) pairs ranked right, ties half."""
    neg = (F.col("n") - F.col("pos")).cast("double")
    area = F.sum(neg * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    return F.try_divide(area, F.first("positives").cast("double") * F.first("negatives"))


def average_precision_expr() -> Column:
    """Aggregate over score points: sum of recall steps times precision."""
    return F.try_divide(F.sum(F.col("pos") * (F.col("tp") / F.col("run_n"))), F.first("positives"))


def _gap() -> Column:
    return F.try_divide("tp", "positives") - F.try_divide("fp", "negatives")


def _ks_value() -> Column:
    """The gap of :func:`ks_expr` alone, which needs no sorting."""
    return F.when(F.max(_gap()).isNotNull(), F.greatest(F.max(_gap()), F.lit(0.0)))


def ks_expr() -> Column:
    """Aggregate over score points: struct(gap, threshold) of the largest signed TPR-FPR, counting
    the empty start of the curve; of equal gaps the highest threshold. Null if one class is absent."""
    best = F.max(F.struct(_gap().alias("gap"), F.col("threshold").alias("threshold")))
    start = F.struct(F.lit(0.0).alias("gap"), F.lit(float("inf")).alias("threshold"))
    return F.when(best["gap"].isNotNull(), F.greatest(best, start))


def auc(df: DataFrame, by: Sequence[str] = (), p: str = "p", label: str = "label") -> DataFrame:
    area = score_points(df, by, p, label).groupBy(*by).agg(auc_expr().alias("auc"))
    return area.withColumn("gini", 2 * F.col("auc") - 1)


def average_precision(df: DataFrame, by: Sequence[str] = (), p: str = "p", label: str = "label") -> DataFrame:
    return score_points(df, by, p, label).groupBy(*by).agg(average_precision_expr().alias("average_precision"))


def ks_roc(df: DataFrame, by: Sequence[str] = (), p: str = "p", label: str = "label") -> DataFrame:
    """Largest signed TPR-FPR and its threshold, the latter clipped to 0..1."""
    best = score_points(df, by, p, label).groupBy(*by).agg(ks_expr().alias("ks"))
    return best.select(
        *by, F.col("ks.gap").alias("ks"), clip(F.col("ks.threshold"), 0.0, 1.0).alias("ks_threshold")
    )


def ks_cdf_curve(df: DataFrame, p: str = "p", label: str = "label") -> DataFrame:
    """Cumulative share of each class by ascending score, at the end of every tie group."""
    points = running_points(df.select(p, F.col(label).cast("bigint").alias("pos")), p, ["pos"])
    bad = F.try_divide("run_pos", "total_pos")
    good = F.try_divide(F.col("run_n") - F.col("run_pos"), F.col("n_rows") - F.col("total_pos"))
    return points.select(
        F.col(p).alias("score"), bad.alias("cdf_bad"), good.alias("cdf_good"), F.abs(bad - good).alias("gap")
    )


def ks_cdf(df: DataFrame, p: str = "p", label: str = "label") -> DataFrame:
    """Largest absolute gap of the two class CDFs and the lowest score where it occurs."""
    best = F.max(F.struct("gap", (-F.col("score")).alias("down")))
    return ks_cdf_curve(df, p, label).agg(best.alias("b")).select(
        F.col("b.gap").alias("ks"), (-F.col("b.down")).alias("ks_score")
    )


def cap_curve(df: DataFrame, p: str = "p", label: str = "label", tie: str = "id") -> DataFrame:
    """Per row, riskiest first: share of rows seen and share of positives caught."""
    ranked = running_rows(df.select(tie, label, (-F.col(p)).alias("_down")), "_down", tie, [label])
    return ranked.select(
        tie,
        (F.col("row_no") / F.col("n_rows")).alias("x"),
        F.try_divide(f"run_{label}", f"total_{label}").alias("y"),
    )


def accuracy_ratio(df: DataFrame, p: str = "p", label: str = "label", tie: str = "id") -> DataFrame:
    """Area under the CAP curve (trapezoid from x = 1/n) against the perfect one.

    The running count at row i is the number of positives at or above it, so its sum over all rows
    is the sum of n - r + 1 over the positives' ranks r.
    """
    ranked = running_rows(df.select(tie, label, (-F.col(p)).alias("_down")), "_down", tie, [label])
    n, bads = F.first("n_rows").cast("double"), F.first(f"total_{label}").cast("double")
    sums = ranked.agg(
        n.alias("n"),
        bads.alias("bads"),
        F.sum(F.when(F.col(label) == 1, (F.col("n_rows") - F.col("row_no") + 1).cast("double"))).alias("_runs"),
        F.max(F.when(F.col("row_no") == 1, F.col(label))).cast("double").alias("_first"),
    )
    area = F.try_divide("_runs", F.col("bads") * F.col("n")) - F.try_divide(
        F.col("_first") + F.col("bads"), 2 * F.col("bads") * F.col("n")
    )
    base = F.col("bads") / F.col("n")
    return sums.select(
        area.alias("cap_area"),
        _over(area - 0.5, F.lit(0.5) - base / 2).alias("accuracy_ratio"),
    )


def perfect_cap(df: DataFrame, label: str = "label", points: int = 300) -> DataFrame:
    """The perfect model's curve on evenly spaced x: min(x / base rate, 1)."""
    base = df.agg((F.sum(label) / F.count(F.lit(1))).alias("base"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    x = F.col("i") / F.lit(float(points - 1))
    return base.select("base", steps).select(
        x.alias("x"), F.least(_over(x, F.greatest("base", F.lit(0.0))), F.lit(1.0)).alias("y")
    )


# ---------------------------------------------------------------- calibration and stability


def _interval(p: str, edges: Sequence[float]) -> Column:
    """0-based number of the interval (lo, hi] among the inner edges; the outer ones are open."""
    no = F.lit(0)
    for e in edges:
        no = no + (F.col(p) > F.lit(float(e))).cast("int")
    return no


def quantile_edges(df: DataFrame, p: str = "p", bins: int = 10) -> list[float]:
    """Distinct inner quantile edges."""
    inner = [i / bins for i in range(1, bins)]
    return sorted({v for v in exact_quantiles(df, {p: F.col(p)}, inner)[p] if v is not None})


def calibration_table(
    df: DataFrame, bins: int = 10, p: str = "p", label: str = "label", edges: Sequence[float] | None = None
) -> DataFrame:
    """Mean prediction against observed rate per quantile bin; empty bins are absent."""
    edges = quantile_edges(df, p, bins) if edges is None else edges
    return (
        df.groupBy((_interval(p, edges) + 1).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(label).alias("observed"))
    )


def _ece_of(calibration: DataFrame) -> DataFrame:
    gap = F.col("n") * F.abs(F.col("observed") - F.col("mean_p"))
    return calibration.agg((F.sum(gap) / F.sum("n")).alias("ece"))


def ece(df: DataFrame, bins: int = 10, strategy: str = "quantile", p: str = "p", label: str = "label") -> DataFrame:
    """Expected calibration error. Uniform bins are (lo, hi] over 0..1, so p = 0 is in no bin but
    still counts in n."""
    if strategy == "quantile":
        return _ece_of(calibration_table(df, bins, p, label))
    if strategy != "uniform":
        raise ValueError(f"unknown strategy '{strategy}'")
    inside = (F.col(p) > 0) & (F.col(p) <= 1)
    per_bin = df.groupBy(F.when(inside, _interval(p, [i / bins for i in range(1, bins)])).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("conf"), F.avg(label).alias("acc")
    )
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0)
    return per_bin.agg((F.sum(gap) / F.sum("n")).alias("ece"))


def psi_table(df: DataFrame, split: str, expected: str, actual: str, bins: int = 10, p: str = "p") -> DataFrame:
    """Shares per bin of the expected split's quantiles, and each bin's stability term."""
    edges = quantile_edges(df.where(F.col(split) == expected), p, bins)
    counted = (
        df.where(F.col(split).isin(expected, actual))
        .groupBy((_interval(p, edges) + 1).alias("bin"))
        .agg(F.count_if(F.col(split) == expected).alias("e"), F.count_if(F.col(split) == actual).alias("a"))
    )
    every = Window.partitionBy(F.lit(0))  # over one row per bin
    bin_rows = df.sparkSession.range(1, len(edges) + 2).select(F.col("id").cast("int").alias("bin"))
    shares = bin_rows.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        *[
            (F.coalesce(c, F.lit(0)) / F.sum(c).over(every) + F.lit(TINY)).alias(name)
            for c, name in (("e", "expected_share"), ("a", "actual_share"))
        ],
    )
    e, a = F.col("expected_share"), F.col("actual_share")
    return shares.withColumn("term", (a - e) * F.ln(a / e))


def psi(df: DataFrame, split: str, expected: str, actual: str, bins: int = 10, p: str = "p") -> DataFrame:
    """Population stability index with its reading: stable, watch or drift."""
    total = psi_table(df, split, expected, actual, bins, p).agg(F.sum("term").alias("psi"))
    reading = (
        F.when(F.col("psi") < STABLE_BELOW, "stable").when(F.col("psi") <= DRIFT_ABOVE, "watch").otherwise("drift")
    )
    return total.withColumn("reading", reading)


# ---------------------------------------------------------------- thresholds


def f1_by_threshold(df: DataFrame, p: str = "p", label: str = "label") -> DataFrame:
    """F1 at 0.01 .. 0.99. Each row is counted once, at the highest threshold it reaches."""
    stage = Bucketizer(
        splits=[float("-inf"), *F1_GRID, float("inf")], inputCol="_p", outputCol="_step", handleInvalid="keep"
    )
    counted = (
        stage.transform(df.select(F.col(p).cast("double").alias("_p"), F.col(label).alias("_y")))
        .groupBy(F.col("_step").cast("int").alias("_step"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"))
    )
    grid = F.lit([0.0, *F1_GRID])
    steps = df.sparkSession.range(len(F1_GRID) + 1).select(F.col("id").cast("int").alias("_step"))
    above = Window.orderBy(F.col("_step").desc()).rowsBetween(Window.unboundedPreceding, 0)  # 100 rows
    every = Window.partitionBy(F.lit(0))
    filled = steps.join(F.broadcast(counted), "_step", "left").select(
        "_step",
        F.sum(F.coalesce("n", F.lit(0))).over(above).alias("flagged"),
        F.sum(F.coalesce("pos", F.lit(0))).over(above).alias("tp"),
        F.sum(F.coalesce("pos", F.lit(0))).over(every).alias("positives"),
    )
    pr, rc = _over("tp", "flagged"), _over("tp", "positives")
    return filled.where("_step > 0").select(F.get(grid, F.col("_step")).alias("threshold"), _over(2 * pr * rc, pr + rc).alias("f1"))


def choose_threshold(
    df: DataFrame,
    mode: str,
    value: float | None = None,
    fp_cost: float = 1.0,
    fn_cost: float = 1.0,
    p: str = "p",
    label: str = "label",
) -> float:
    """Decision threshold: ``fixed`` value, ``reject_rate`` share, ``cost`` ratio, best ``f1`` or ``ks``."""
    if mode == "fixed":
        return float(0.5 if value is None else value)
    if mode == "cost":
        return float(fp_cost / (fp_cost + fn_cost))
    if mode == "reject_rate":
        return float(exact_quantiles(df, {p: F.col(p)}, [1 - value])[p][0])
    if mode == "f1":
        best = f1_by_threshold(df, p, label).agg(
            F.max(F.struct("f1", (-F.col("threshold")).alias("down"))).alias("b")
        ).first().b
        return -best.down if best.f1 > 0 else 0.5
    if mode == "ks":
        # absolute gap, from the top: of equal gaps the highest threshold
        gap = F.abs(_gap()).alias("gap")
        b = score_points(df, (), p, label).agg(F.max(F.struct(gap, "threshold")).alias("b")).first().b
        if b is None or b.gap is None:
            return 0.5
        return min(max(b.threshold, 0.0), 1.0)
    raise ValueError(f"unknown threshold mode '{mode}'")


def decisions(df: DataFrame, t: float, keep: Sequence[str] = ("id",), p: str = "p") -> DataFrame:
    """Score table: probability and 1 = reject, 0 = approve."""
    return df.select(*keep, F.col(p).alias("p"), (F.col(p) >= F.lit(float(t))).cast("int").alias("reject"))


def cumulative_capture(gains: DataFrame) -> DataFrame:
    """Bin against cumulative capture, from a gains table."""
    return gains.select("decile", "capture")


# ---------------------------------------------------------------- packs


def binary_metrics(df: DataFrame, t: float, by: str = "split", p: str = "p", label: str = "label") -> DataFrame:
    """One line per split: size, rate, ranking measures, losses and threshold counts."""
    rows = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(label).alias("positive_rate"),
        log_loss_expr(p, label).alias("log_loss"),
        brier_expr(p, label).alias("brier"),
        *_counts(t, p, label),
    )
    curves = score_points(df, [by], p, label).groupBy(by).agg(
        auc_expr().alias("auc"), average_precision_expr().alias("average_precision"), _ks_value().alias("ks")
    )
    pr = _over("tp", F.col("tp") + F.col("fp"))
    rc = _over("tp", F.col("tp") + F.col("fn"))
    return rows.join(curves, by).select(
        by,
        "n",
        "positive_rate",
        "auc",
        "average_precision",
        "log_loss",
        "brier",
        "ks",
        "tp",
        "fp",
        "tn",
        "fn",
        _over(F.col("tp") + F.col("tn"), "n").alias("accuracy"),
        pr.alias("precision"),
        rc.alias("recall"),
        _over(2 * pr * rc, pr + rc).alias("f1"),
    )


def evaluation_pack(df: DataFrame, t: float, split: str = "split", reference: str = "train") -> Mapping[str, DataFrame]:
    """Every table of the credit-risk report, each a lazy DataFrame. ``df`` should be persisted.

    The curves share one ordering of the test scores, the calibration tables one set of edges.
    """
    test = df.where(F.col(split) == "test")
    points = score_points(test)
    calibration = calibration_table(test)
    return {
        "metrics": binary_metrics(df, t, split),
        "report": classification_report(test, t),
        "confusion": confusion_shares(test, t),
        "roc": _roc_of(points),
        "pr": _pr_of(points),
        "ks": ks_cdf(test),
        "calibration": calibration,
        "ece": _ece_of(calibration),
        "psi": psi(df, split, reference, "test"),
        "cap": accuracy_ratio(test),
        "deciles": safest_first_table(test),
        "topk": topk_capture(test),
        "decisions": decisions(test, t),
    }
