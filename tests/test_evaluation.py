import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.operators import evaluation as ev


@pytest.fixture(scope="module")
def arrays(scored):
    pdf = scored.toPandas()
    return pdf["label"].to_numpy(), pdf["p"].to_numpy()


def test_auc_is_the_pair_share(scored, arrays):
    y, p = arrays
    diff = p[y == 1][:, None] - p[y == 0][None, :]
    want = ((diff > 0) + 0.5 * (diff == 0)).mean()
    got = ev.auc(scored).first()
    assert got.auc == pytest.approx(want) and got.gini == pytest.approx(2 * want - 1)
    flipped = ev.auc(scored.withColumn("p", 1 - F.col("p"))).first().auc
    assert flipped == pytest.approx(1 - want)


def test_one_class(scored):
    df = scored.withColumn("label", F.lit(1))
    assert ev.auc(df).first().auc is None
    assert ev.ks_roc(df).first().ks is None
    assert ev.choose_threshold(df, "ks") == 0.5


def test_all_tied(scored):
    df = scored.withColumn("p", F.lit(0.4))
    assert ev.auc(df).first().auc == pytest.approx(0.5)
    row = ev.ks_roc(df).first()
    assert (row.ks, row.ks_threshold) == (0.0, 1.0)  # the empty start of the curve, clipped


def test_average_precision(scored, arrays):
    y, p = arrays
    want = 0.0
    for t in np.unique(p):
        at, over = p == t, p >= t
        want += y[at].sum() / y.sum() * y[over].mean()
    assert ev.average_precision(scored).first().average_precision == pytest.approx(want)


def test_ks_both_forms(scored, arrays):
    y, p = arrays
    gaps = [(p[y == 1] >= t).mean() - (p[y == 0] >= t).mean() for t in np.unique(p)]
    assert ev.ks_roc(scored).first().ks == pytest.approx(max(gaps))
    cdf = [abs((p[y == 1] <= t).mean() - (p[y == 0] <= t).mean()) for t in np.unique(p)]
    assert ev.ks_cdf(scored).first().ks == pytest.approx(max(cdf))


def test_accuracy_ratio_is_the_trapezoid(scored):
    curve = ev.cap_curve(scored).toPandas().sort_values("x")
    area = np.trapezoid(curve["y"], curve["x"])
    base = scored.agg(F.avg("label")).first()[0]
    got = ev.accuracy_ratio(scored).first()
    assert got.cap_area == pytest.approx(area)
    assert got.accuracy_ratio == pytest.approx((area - 0.5) / (0.5 - base / 2 + 1e-12))


def test_psi_of_itself_is_zero(scored):
    twice = scored.withColumn("split", F.lit("train")).unionByName(scored.withColumn("split", F.lit("test")))
    row = ev.psi(twice, "split", "train", "test").first()
    assert row.psi == pytest.approx(0, abs=1e-12) and row.reading == "stable"
    moved = scored.withColumn("split", F.when(F.col("p") < 0.5, "train").otherwise("test"))
    assert ev.psi(moved, "split", "train", "test").first().reading == "drift"


def test_uniform_ece_leaves_zero_out(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (2, 1, 0.95), (3, 0, 0.15)], "id bigint, label int, p double")
    assert ev.ece(df, strategy="uniform").first().ece == pytest.approx((0.05 + 0.15) / 3)


def test_f1_table(scored, arrays):
    y, p = arrays
    got = {round(r.threshold, 2): r.f1 for r in ev.f1_by_threshold(scored).collect()}
    assert len(got) == 99
    for t in (0.01, 0.25, 0.26, 0.5, 0.99):
        hit = p >= t
        pr, rc = y[hit].mean(), y[hit].sum() / y.sum()
        assert got[t] == pytest.approx(2 * pr * rc / (pr + rc), abs=1e-9)


def test_thresholds(scored, arrays):
    assert ev.choose_threshold(scored, "fixed", 0.3) == 0.3
    assert ev.choose_threshold(scored, "cost", fp_cost=1, fn_cost=3) == 0.25
    assert ev.choose_threshold(scored, "reject_rate", 0.1) == pytest.approx(np.quantile(arrays[1], 0.9))
    with pytest.raises(ValueError):
        ev.choose_threshold(scored, "guess")


def test_log_loss_clips(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 1.0)], "label int, p double")
    assert ev.log_loss(df).first().log_loss == pytest.approx(-math.log(1e-12) / 2, rel=1e-4)


def test_report_without_hits(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.2)], "id bigint, label int, p double")
    rows = {r["class"]: r for r in ev.classification_report(df, 0.9).collect()}
    assert rows["1"].precision == 0.0 and rows["1"].f1 == 0.0 and rows["0"].recall == 1.0


def test_pack(scored):
    df = scored.withColumn("split", F.when(F.col("id") % 2 == 0, "train").otherwise("test")).persist()
    tables = {k: v.count() for k, v in ev.evaluation_pack(df, 0.5).items()}
    assert tables["metrics"] == 2 and tables["deciles"] == 10 and tables["decisions"] == 1000
