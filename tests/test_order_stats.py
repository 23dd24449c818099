import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.operators.order_stats import exact_quantiles, order_statistics, quantiles

PROBS = [0.0, 0.001, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def columns(spark):
    rng = np.random.default_rng(1)
    n = 6000
    data = {
        "spread": rng.normal(size=n),
        "hot": np.where(np.arange(n) % 3 == 0, 0.5, rng.random(n)),
        "few": rng.integers(0, 4, n).astype(float),
        "constant": np.full(n, 2.0),
    }
    rows = list(zip(*[c.tolist() for c in data.values()]))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)
    return df.persist(), data


@pytest.mark.parametrize("limits", [{}, {"gather_rows": 50, "accuracy": 100}, {"gather_rows": 1, "accuracy": 20}])
def test_matches_numpy(columns, limits):
    df, data = columns
    got = exact_quantiles(df, {c: F.col(c) for c in data}, PROBS, **limits)
    for c, v in data.items():
        assert got[c] == pytest.approx(np.quantile(v, PROBS).tolist(), rel=1e-12, abs=1e-12)


def test_nulls_do_not_count(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    assert exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.5]) == {"a": [2.0], "b": [None]}
    assert quantiles(df, ["a"], [0.5]).collect()[0].value == 2.0


def test_wrong_bracket_only_costs_a_round(columns):
    df, data = columns
    rank = 1000
    stats = order_statistics(
        df, {"x": (F.col("spread"), rank)}, {"x": 6000}, {"x": (2.5, 2.6)}, gather_rows=40, accuracy=100
    )
    assert stats["x"].value == np.sort(data["spread"])[rank]
    assert stats["x"].below == rank and stats["x"].equal == 1


def test_rank_outside_raises(columns):
    with pytest.raises(ValueError):
        order_statistics(columns[0], {"x": (F.col("few"), 6000)}, {"x": 6000})
