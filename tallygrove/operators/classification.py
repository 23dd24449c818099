"""Logistic regression and the linear support vector machine."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.functions.scalars import hash_order
from tallygrove.operators.evaluation import TINY
from tallygrove.operators.vector_sums import blocks, summed

# fixed values: thirteen penalties, evenly spaced in the exponent from 1e-3 to 1e3
C_GRID = [10.0 ** (-3 + i / 2) for i in range(13)]


def logistic(
    df: DataFrame, c: float = 1.0, features: str = "features", label: str = "label", rows: int | None = None, max_iter: int = 4000
) -> LogisticRegressionModel:
    """Minimises ||w||^2 / 2 + c * total log loss with a free intercept."""
    n = rows or df.count()
    return LogisticRegression(
        featuresCol=features,
        labelCol=label,
        regParam=1.0 / (n * c),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=1e-8,
    ).fit(df)


@dataclass(frozen=True)
class LogisticWeights:
    """A fitted logistic model."""

    intercept: float
    weights: Sequence[float]

    def transform(self, df: DataFrame, features: str = "features", out: str = "p") -> DataFrame:
        x = vector_to_array(features)
        score = F.aggregate(
            F.zip_with(x, F.lit(list(self.weights)), lambda a, b: a * b), F.lit(self.intercept), lambda s, v: s + v
        )
        return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-score)))


def logistic_penalised(
    df: DataFrame, c: float = 1.0, features: str = "features", label: str = "label", id_col: str = "id", max_iter: int = 2000
) -> LogisticWeights:
    """As :func:`logistic`, the intercept being the weight of a constant 1 and penalised with them.

    The library zeroes the weight of a constant column. The loss is unchanged when a row's vector
    and label are both flipped, so every other row (by hash) is flipped: the column of ones then
    varies.
    """
    flip = F.pmod(hash_order(id_col, 0), F.lit(2)) == 1
    sign = F.when(flip, F.lit(-1.0)).otherwise(F.lit(1.0))
    x = vector_to_array(features)
    rows = df.select(
        F.transform(F.concat(F.array(F.lit(1.0)), x), lambda v: v * sign).alias("_x"),
        F.when(flip, 1 - F.col(label)).otherwise(F.col(label)).cast("double").alias("_y"),
    )
    # the fit reads its vectors twice before it has blocks of its own
    rows = rows.withColumn("_x", array_to_vector("_x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = LogisticRegression(
            featuresCol="_x",
            labelCol="_y",
            regParam=1.0 / (rows.count() * c),
            elasticNetParam=0.0,
            standardization=False,
            fitIntercept=False,
            maxIter=max_iter,
            tol=1e-8,
        ).fit(rows)
    finally:
        rows.unpersist()
    first, *rest = fitted.coefficients.toArray().tolist()
    return LogisticWeights(first, rest)


def predict_proba(model: LogisticRegressionModel | LogisticWeights, df: DataFrame, out: str = "p") -> DataFrame:
    """Add P(label = 1) and the predicted class."""
    if isinstance(model, LogisticWeights):
        return model.transform(df, out=out).withColumn("predicted", (F.col(out) > 0.5).cast("int"))
    scored = model.transform(df)
    return scored.select(
        *df.columns,
        vector_to_array(model.getProbabilityCol())[1].alias(out),
        F.col(model.getPredictionCol()).cast("int").alias("predicted"),
    )


@dataclass(frozen=True)
class LogisticPath:
    best: LogisticWeights
    c: float
    losses: Sequence[tuple[float, float]]
    models: Sequence[LogisticWeights] = field(repr=False, default=())
    gradients: Sequence[float] = ()  # greatest component of each fit's gradient, by row
    passes: int = 0


WIDEST = 1024  # features up to which a path carries curvature: a task's sums are that many squared for each penalty
HALVINGS = 30


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a constant 1 in front, and their labels."""
    n = batch.num_rows
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return np.column_stack([np.ones(n), x]), batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)


def _logistic_rows(df: DataFrame, features: str, label: str) -> DataFrame:
    return df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))


def _total_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0.0, z) - y * z).sum())


def newton_path(train: DataFrame, grid: Sequence[float], features: str = "features", label: str = "label", tol: float = 1e-9, max_iter: int = 60) -> tuple[list[LogisticWeights], list[float], int]:
    """Minimises ||w||^2 / 2 + c * total log loss with a free intercept, for all penalties side by side.

    One job an iteration: a pass adds up loss, gradient and curvature at every penalty's point. A step that raised its loss is
    halved; a penalty whose gradient, by row, is below ``tol`` or whose loss no longer falls has arrived and leaves. Returns
    the models, the greatest component of each gradient by row, and the number of passes.
    """
    rows = _logistic_rows(train, features, label)
    first = rows.first()
    width = len(first.x) + 1
    free = np.ones(width)
    free[0] = 0.0  # the intercept isn't penalised
    points = [np.zeros(width) for _ in grid]
    # penalty -> point before, its loss, step, share of the step taken
    tracks: dict[int, tuple[np.ndarray, float, np.ndarray, float] | None] = dict.fromkeys(range(len(grid)))
    ends = [float("inf")] * len(grid)
    passes = 0
    while tracks and passes < max_iter:
        passes += 1
        now = {k: points[k] for k in tracks}

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {k: np.zeros(1 + width + width * width) for k in now}
            seen = 0
            for batch in batches:
                x, y = _rows(batch)
                seen += len(y)
                for k, w in now.items():
                    z = x @ w
                    p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                    out = sums[k]
                    out[0] += _total_loss(z, y)
                    out[1 : 1 + width] += x.T @ (p - y)
                    out[1 + width :] += ((x * (p * (1 - p))[:, None]).T @ x).reshape(-1)
            if seen:
                for k, out in sums.items():
                    yield from blocks(k, out, seen)

        for k, (total, n) in summed(rows, task).items():
            w, c = points[k], grid[k]
            loss = total[0] + (free * w) @ w / (2 * c)
            grad = total[1 : 1 + width] + free * w / c
            before = tracks[k]
            if before is not None and not loss <= before[1] + 1e-12 * abs(before[1]):
                share = before[3] / 2
                points[k] = before[0] + share * before[2]
                if share < 0.5**HALVINGS:  # no step lowers the loss any more
                    points[k] = before[0]
                    del tracks[k]
                else:
                    tracks[k] = (*before[:3], share)
                continue
            ends[k] = float(np.abs(grad).max() / n)
            if ends[k] <= tol:
                del tracks[k]
                continue
            curve = total[1 + width :].reshape(width, width) + np.diag(free / c)
            curve[np.diag_indices(width)] += 1e-12 * max(1.0, float(np.trace(curve)) / width)
            step = -np.linalg.solve(curve, grad)
            points[k] = w + step
            tracks[k] = (w, loss, step, 1.0)
    for k, before in tracks.items():  # out of passes: the last measured point
        if before is not None:
            points[k] = before[0]
    return [LogisticWeights(float(w[0]), w[1:].tolist()) for w in points], ends, passes


def validation_losses(models: Sequence[LogisticWeights], df: DataFrame, features: str = "features", label: str = "label") -> list[float]:
    """Mean log loss of every model, in one pass."""
    weights = np.array([[m.intercept, *m.weights] for m in models])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(weights)), 0
        for batch in batches:
            x, y = _rows(batch)
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ weights.T, -700, 700)))
            q = np.clip(p, TINY, 1 - TINY)
            total -= np.where(y[:, None] == 1, np.log(q), np.log1p(-q)).sum(axis=0)
            seen += len(y)
        if seen:
            yield from blocks(0, total, seen)

    total, n = summed(_logistic_rows(df, features, label), task)[0]
    return (total / n).tolist()


def logistic_path(
    train: DataFrame, validation: DataFrame, grid: Sequence[float] = C_GRID, features: str = "features", label: str = "label",
) -> LogisticPath:
    """A fit for every penalty; the smallest validation log loss wins, the first of equals.

    Newton steps of all penalties side by side, one job an iteration; beyond ``WIDEST`` features, whose curvature a task could
    not hold, one quasi-Newton fit after another. Both inputs should be persisted: every pass reads them again.
    """
    if len(train.select(features).first()[0]) <= WIDEST:
        models, gradients, passes = newton_path(train, grid, features, label)
    else:
        n = train.count()
        fitted = [logistic(train, c, features, label, n) for c in grid]
        models = [LogisticWeights(float(m.intercept), m.coefficients.toArray().tolist()) for m in fitted]
        gradients, passes = [], 0
    losses = validation_losses(models, validation, features, label)
    at = min(range(len(grid)), key=lambda i: losses[i])
    return LogisticPath(models[at], grid[at], list(zip(grid, losses)), models, gradients, passes)


def linear_score(df: DataFrame, cols: Sequence[str], weights: Sequence[float], intercept: float, out: str = "p") -> DataFrame:
    """Logistic score from given coefficients on plain columns."""
    z = F.lit(float(intercept))
    for c, w in zip(cols, weights, strict=True):
        z = z + F.col(c) * F.lit(float(w))
    return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def svm_linear(df: DataFrame, c: float = 1.0, features: str = "features", label: str = "label") -> LinearSVCModel:
    """Minimises ||w||^2 / 2 + c * total hinge loss."""
    return LinearSVC(
        featuresCol=features, labelCol=label, regParam=1.0 / (df.count() * c), standardization=False, maxIter=500, tol=1e-8
    ).fit(df)


def boundary_line(df: DataFrame, x1: str, model: LinearSVCModel, points: int = 100) -> DataFrame:
    """The line where a two-feature model changes class, over evenly spaced x1 in its range."""
    w, b = model.coefficients.toArray(), model.intercept
    slope, intercept = float(-w[0] / w[1]), float(-b / w[1])
    return curve_points(df, x1, points).withColumn("x2", F.lit(slope) * F.col("x1") + F.lit(intercept))


def curve_points(df: DataFrame, x: str, points: int = 100, out: str = "x1") -> DataFrame:
    """Evenly spaced values over a column's range, to draw a fitted curve on."""
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    ends = df.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"))
    return ends.select("lo", "hi", i.alias("i")).select(
        (F.col("lo") + F.col("i") * ((F.col("hi") - F.col("lo")) / F.lit(float(points - 1)))).alias(out)
    )
