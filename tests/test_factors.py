"""Components of long panels against numpy."""

import datetime as dt

import numpy as np
import pytest

from tallygrove.operators import factors as fa


def long_panel(spark, x, start=dt.date(2024, 1, 1)):
    days, names = x.shape
    rows = [(start + dt.timedelta(d), f"t{c:05d}", float(x[d, c])) for d in range(days) for c in range(names)]
    return spark.createDataFrame(rows, "date date, ticker string, ret double").repartition(6)


@pytest.mark.parametrize("shape", [(40, 7), (12, 30)])
def test_as_numpy(spark, shape, monkeypatch):
    monkeypatch.setattr(fa, "BLOCK", 4)
    x = np.random.default_rng(1).normal(size=shape) * np.linspace(1, 3, shape[1])
    found = fa.panel_factors(long_panel(spark, x), "ticker", "date", "ret", 3)
    cov = np.cov(x.T)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    assert found.eigenvalues == pytest.approx(values[order][: min(shape)].clip(0), abs=1e-9)
    table = found.loadings().toPandas().pivot(index="column", columns="component", values="loading").to_numpy()
    for i in range(3):
        want = vectors[:, order[i]]
        want = want * np.sign(want[np.argmax(np.abs(want))])
        assert table[:, i] == pytest.approx(want, abs=1e-8)
    scores = found.scores(spark).orderBy("date").toPandas()
    assert scores[["pc1", "pc2", "pc3"]].to_numpy() == pytest.approx(x @ table, abs=1e-8)
    pairs = fa.covariance_blocks(found.panel).toPandas().pivot(index="col_a", columns="col_b", values="value").to_numpy()
    assert pairs == pytest.approx(cov, abs=1e-10)
    trace, residual = found.checks()
    assert trace == pytest.approx(np.trace(cov)) == pytest.approx(found.eigenvalues.sum()) and residual < 1e-10


def test_five_thousand_columns(spark):
    rng = np.random.default_rng(2)
    market = rng.normal(size=(20, 1))
    x = market * rng.normal(1, 0.2, size=(1, 5000)) + 0.1 * rng.normal(size=(20, 5000))
    found = fa.panel_factors(long_panel(spark, x), "ticker", "date", "ret", 2)
    trace, residual = found.checks()
    assert len(found.eigenvalues) == 20 and found.eigenvalues[0] / trace > 0.9 and residual < 1e-10
    assert found.panel.blocks.count() == 20 and found.loadings().count() == 10_000


def test_incomplete_panels_are_refused(spark):
    x = np.arange(12.0).reshape(4, 3)
    rows = long_panel(spark, x)
    with pytest.raises(Exception, match="lacks a value"):
        fa.panel_factors(rows.where("not (ticker = 't00001' and date = date'2024-01-02')"), "ticker", "date", "ret")
    with pytest.raises(ValueError, match="two dates"):
        fa.panel_factors(rows.where("date = date'2024-01-02'"), "ticker", "date", "ret")
