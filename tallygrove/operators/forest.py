"""Random forest regression and randomised search."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.functions.scalars import hash_order
from tallygrove.operators.forest_growth import Forest, ForestParams, Unusable, fold_scores, grow_forest
from tallygrove.operators.regression import ridge

# fixed values: the search spaces
FOREST_SPACE = {
    "trees": [100, 200, 500],
    "depth": [10, 20, None],
    "min_split": [2, 5, 10],
    "features": ["sqrt", "log2"],
    "bootstrap": [True, False],
    "leaves": [None, 10, 20, 100],
    "criterion": ["squared_error", "absolute_error"],
    "out_of_bag": [False, True],
}
RIDGE_SPACE = {"alpha": [0.1, 0.3, 0.6], "fit_intercept": [True, False]}


def random_forest_regressor(df: DataFrame, features_col: str = "features", label: str = "label", id_col: str = "id", **params) -> Forest:
    """A forest of ``ForestParams`` parameters; an out-of-bag score needs bootstrapping."""
    return grow_forest(df, ForestParams(**params), features_col, label, id_col)


def fit_ridge(df: DataFrame, alpha: float, fit_intercept: bool) -> LinearRegressionModel:
    return ridge(df, alpha, fit_intercept=fit_intercept)


@dataclass(frozen=True)
class Search:
    best: object
    params: Mapping[str, object]
    trials: Sequence[tuple[Mapping[str, object], float | None]]  # mean score; None where unusable

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i + 1, str(dict(p)), s) for i, (p, s) in enumerate(self.trials)]
        return spark.createDataFrame(rows, "trial int, params string, score double")


def draws(space: Mapping[str, Sequence], n_iter: int, seed: int) -> list[dict[str, object]]:
    """Different combinations of a space, drawn at random."""
    grid = [dict(zip(space, values)) for values in itertools.product(*space.values())]
    return random.Random(seed).sample(grid, min(n_iter, len(grid)))


def search_forest(df: DataFrame, n_iter: int = 10, folds: int = 3, seed: int = 42, space: Mapping[str, Sequence] = FOREST_SPACE) -> Search:
    """Random search over the forest's whole space: all draws and folds are grown side by side, the best is fitted on all rows.

    Draws that can't be fitted (an out-of-bag score without bootstrapping) have no score and are passed over.
    """
    chosen = draws(space, n_iter, seed)
    scores = fold_scores(df, [ForestParams(**c, seed=seed) for c in chosen], folds, seed)
    usable = [i for i, s in enumerate(scores) if s is not None]
    if not usable:
        raise Unusable("no sampled combination can be fitted")
    at = max(usable, key=lambda i: scores[i])
    return Search(grow_forest(df, ForestParams(**chosen[at], seed=seed)), chosen[at], list(zip(chosen, scores)))


def random_search(
    df: DataFrame,
    fit: Callable[..., object],
    space: Mapping[str, Sequence],
    n_iter: int = 10,
    folds: int = 3,
    seed: int = 42,
    id_col: str = "id",
    label: str = "label",
    parallel: int = 3,
) -> Search:
    """Sample combinations, score each by mean R2 over the folds, refit the best on all rows.

    Folds come from the id's hash, so they survive recomputation. ``df`` should be persisted. An
    unusable combination has no score and is passed over.
    """
    chosen = draws(space, n_iter, seed)
    folded = df.withColumn("_fold", F.pmod(hash_order(id_col, seed), F.lit(folds)))
    r2 = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="r2")

    def trial(params: Mapping[str, object]) -> float | None:
        scores = []
        for k in range(folds):
            try:
                model = fit(folded.where(F.col("_fold") != k), **params)
            except Unusable:
                return None
            scores.append(r2.evaluate(model.transform(folded.where(F.col("_fold") == k))))
        return sum(scores) / folds

    with ThreadPoolExecutor(parallel) as pool:
        results = list(pool.map(trial, chosen))
    usable = [i for i, s in enumerate(results) if s is not None]
    if not usable:
        raise Unusable("no sampled combination can be fitted")
    at = max(usable, key=lambda i: results[i])
    return Search(fit(df, **chosen[at]), chosen[at], list(zip(chosen, results)))
