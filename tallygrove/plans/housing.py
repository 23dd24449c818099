"""House-price flow: derive, fill, encode, split, fit on train, compare regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.functions.scalars import ordinal_encode
from tallygrove.operators import cleaning, evaluation, forest, ranking, regression, splits
from tallygrove.operators.preprocessing import StandardScale, assemble, one_hot_fixed
from tallygrove.operators.statistics import distinct_values

# fixed values: the columns of a house table
NUMBERS = [
    "lot_area", "overall_qual", "overall_cond", "year_built", "year_remod_add", "finished_basement", "bsmt_unf_sf",
    "total_bsmt_sf", "first_flr_sf", "second_flr_sf", "gr_liv_area", "full_bath", "half_bath", "bedroom_abv_gr",
    "tot_rms_abv_grd", "fireplaces", "garage_cars", "garage_area", "wood_deck_sf", "open_porch_sf", "enclosed_porch",
    "bsmt_qual",
]
QUALITY = {"0": 0, "Po": 1, "Fa": 2, "TA": 3, "Gd": 4, "Ex": 5}
RIDGE_ALPHAS = [0.10, 0.30, 0.60]
LASSO_ALPHAS = [0.02, 0.06, 0.10]


def prepare(houses: DataFrame, categories: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Derived sum, zero fill, ordinal quality and one-hot neighbourhoods; feature names returned."""
    summed = cleaning.add_columns(houses, "finished_basement", ["bsmt_fin_sf1", "bsmt_fin_sf2"])
    filled = cleaning.fill_all_zero(summed).withColumn("bsmt_qual", ordinal_encode("bsmt_qual", QUALITY).cast("double"))
    if categories is None:
        rows = distinct_values(filled, "neighborhood").collect()  # the categories
        categories = [r[0] for r in rows]
    hot = one_hot_fixed({"neighborhood": categories})
    table = hot.transform(filled).withColumn("label", F.col("sale_price").cast("double"))
    return table.select("id", "label", *NUMBERS, *hot.names()), [*NUMBERS, *hot.names()]


def split_and_scale(table: DataFrame, features: Sequence[str], n_train: int, n_test: int, seed: int = 42) -> DataFrame:
    """Persisted rows (id, label, split, features), scaled by the training rows."""
    split = splits.split_exact(table, n_train, n_test, seed)
    scale = StandardScale(NUMBERS).fit(split.where("split = 'train'"))
    rows = assemble(scale.transform(split), features, ["id", "label", "split"])
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def compare(rows: DataFrame, search: int = 10, trees: int = 10) -> DataFrame:
    """Test error of every ridge and lasso penalty, the searched ridge and the searched forest, ``search`` and ``trees`` draws."""
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    models = [(f"ridge {a}", regression.ridge(train, a)) for a in RIDGE_ALPHAS]
    models += [(f"lasso {a}", regression.lasso(train, a)) for a in LASSO_ALPHAS]
    if search:
        found = forest.random_search(train, forest.fit_ridge, forest.RIDGE_SPACE, search)
        models.append(("ridge searched", found.best))
    if trees:
        models.append(("forest searched", forest.search_forest(train, trees).best))
    out = None
    for name, model in models:
        line = evaluation.regression_metrics(model.transform(test), "label", "prediction").withColumn("model", F.lit(name))
        out = line if out is None else out.unionByName(line)
    return out


def strongest(rows: DataFrame, alpha: float, prefix: str | None = None) -> DataFrame:
    """Ridge weights by magnitude; ``prefix`` for the one-hot block alone."""
    table = regression.model_coefficients(regression.ridge(rows.where("split = 'train'"), alpha), rows)
    return ranking.rank_by_abs(table.where("feature != 'intercept'"), prefix)
