"""Linear models: gradient descent, ridge and lasso."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.functions.scalars import polynomial


@dataclass(frozen=True)
class Descent:
    """Fitted parameters, one per column, with the steps taken."""

    names: Sequence[str]
    theta: Sequence[float]
    steps: int
    converged: bool

    def table(self, spark: SparkSession) -> DataFrame:
        return coefficient_table(spark, self.names, self.theta)


def coefficient_table(spark: SparkSession, names: Sequence[str], values: Sequence[float]) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(names, values, strict=True)]
    return spark.createDataFrame(rows, "feature string, coefficient double")


def model_coefficients(model: object, scored: DataFrame, features: str = "features") -> DataFrame:
    """Feature name and weight of a fitted linear model, the intercept first; the names come from
    the attributes of the assembled vector column."""
    groups = scored.schema[features].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for block in groups.values() for a in block}
    weights = model.coefficients.toArray()
    return coefficient_table(
        scored.sparkSession,
        ["intercept", *[names[i] for i in range(len(weights))]],
        [model.intercept, *weights],
    )


def gram(df: DataFrame, xs: Sequence[str], y: str) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, X'y and the row count in one aggregation; only k x k numbers reach the driver."""
    k = len(xs)
    aggs = [F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"g_{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.sum(F.col(x) * F.col(y)).alias(f"b_{i}") for i, x in enumerate(xs)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    g = np.empty((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"]
    return g, np.array([row[f"b_{i}"] for i in range(k)]), row.n


def linreg_gd(
    df: DataFrame,
    xs: Sequence[str],
    y: str,
    rate: float = 0.01,
    steps: int = 10_000,
    tol: float | None = None,
) -> Descent:
    """Least squares by gradient descent from zero.

    The gradient needs the data only through X'X and X'y, so one scan gives every iterate a scan
    per step would give. With ``tol``, stops when a step's L1 norm falls below it and returns the
    parameters before that step. Data on which the descent diverges raises.
    """
    g, b, n = gram(df, xs, y)
    theta = np.zeros(len(xs))
    with np.errstate(over="ignore", invalid="ignore"):
        for done in range(steps):
            move = rate * ((g @ theta - b) / n)
            if tol is not None and np.abs(move).sum() < tol:
                return Descent(xs, theta.tolist(), done, True)
            theta = theta - move
    if not np.isfinite(theta).all():
        raise ValueError("the descent diverges: scale the features or lower the rate")
    return Descent(xs, theta.tolist(), steps, tol is None)


def polyreg_gd(
    df: DataFrame, x: str, y: str, degree: int = 2, rate: float = 0.01, steps: int = 10_000, tol: float = 1e-8
) -> Descent:
    """The same on 1, x, x^2, ..."""
    wide = df.select(*polynomial(x, degree, "x"), F.col(y).alias("_y"))
    return linreg_gd(wide, [f"x{k}" for k in range(degree + 1)], "_y", rate, steps, tol)


# widest vector the library's one-pass normal equations take; wider ones iterate over the rows
NORMAL_FEATURES = 4096


def _width(df: DataFrame, features: str) -> int:
    row = df.select(features).first()
    if row is None:
        raise ValueError("no rows to fit on")
    return row[0].size


def ridge(
    df: DataFrame, alpha: float, features: str = "features", label: str = "label", fit_intercept: bool = True
) -> LinearRegressionModel:
    """Minimises ||y - Xw - b||^2 + alpha ||w||^2 with a free intercept.

    The library divides the objective by n and scales the label by its deviation s, so the equal
    penalty is alpha * s / n. Its normal equations (one pass over the rows) use the population
    deviation, its iterative solver the sample one.
    """
    one_pass = _width(df, features) <= NORMAL_FEATURES
    spread = F.stddev_pop(label) if one_pass else F.stddev_samp(label)
    stat = df.agg(F.count(label).alias("n"), spread.alias("s")).first()
    return LinearRegression(
        featuresCol=features,
        labelCol=label,
        solver="normal" if one_pass else "l-bfgs",
        elasticNetParam=0.0,
        standardization=False,
        regParam=alpha * stat.s / stat.n,
        fitIntercept=fit_intercept,
        maxIter=1000,
        tol=1e-12,
    ).fit(df)


def lasso(df: DataFrame, alpha: float, features: str = "features", label: str = "label") -> LinearRegressionModel:
    """Minimises ||y - Xw - b||^2 / 2n + alpha ||w||_1. Up to a few thousand features the rows are
    read once, for their moments."""
    return LinearRegression(
        featuresCol=features,
        labelCol=label,
        solver="normal" if _width(df, features) <= NORMAL_FEATURES else "l-bfgs",
        elasticNetParam=1.0,
        standardization=False,
        regParam=alpha,
        maxIter=1000,
        tol=1e-12,
    ).fit(df)
