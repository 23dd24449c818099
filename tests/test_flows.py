import pytest
from pyspark.sql import functions as F

from tallygrove.operators import classification as cl
from tallygrove.plans import credit, fixtures as fx, housing, market
from tallygrove.session import fresh_path
from tallygrove.streaming.scoring import decide_stream


def test_credit(spark, small):
    run = credit.run(fx.loans(spark, small), grid=[0.1, 10.0])
    metrics = {r.split: r for r in run.tables["metrics"].collect()}
    assert set(metrics) == {"train", "validation", "test"}
    assert 0.5 < metrics["test"].auc <= 1 and 0 <= run.threshold <= 1
    assert run.path.c in (0.1, 10.0)
    assert run.tables["deciles"].agg(F.sum("n")).first()[0] == metrics["test"].n
    assert "application_type_INDIVIDUAL" not in run.model.features  # constant on train


def test_credit_cleaning(spark, small):
    loans = fx.loans(spark, small)
    broken = loans.withColumn("issue_d", F.when(F.col("id") < 10, "?").otherwise(F.col("issue_d")))
    broken = broken.withColumn("open_acc", F.when(F.col("id").between(10, 19), None).otherwise(F.col("open_acc")))
    rate = F.when(F.col("id").between(20, 24), None).when(F.col("id").between(25, 29), "n/a").otherwise(F.col("revol_util"))
    broken = broken.withColumn("revol_util", rate)
    kept = {r.id for r in credit.engineer(broken).select("id").collect()}
    assert kept == {r.id for r in credit.engineer(loans).where("id >= 30").select("id").collect()}
    bad = loans.withColumn("dti", F.when(F.col("id") == 5, None).otherwise(F.col("dti")))
    with pytest.raises(ValueError, match="dti"):
        credit.prepare(bad)


def test_credit_loans_are_engineered_once(spark, small):
    loans = fx.loans(spark, small).persist()
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def status(value):
        seen.add(1)
        return value

    rows, _ = credit.prepare(loans.withColumn("loan_status", status("loan_status")))
    assert 0 < rows.count() <= seen.value <= loans.count()  # not once for every pass that the split needs
    rows.unpersist()
    loans.unpersist()


def test_housing(spark, small):
    table, features = housing.prepare(fx.iowa(spark, small))
    assert len(features) == 22 + 25
    n = table.count()
    rows = housing.split_and_scale(table, features, int(0.6 * n), int(0.2 * n))
    table = {r.model: r for r in housing.compare(rows, search=0, trees=0).collect()}
    assert set(table) == {f"ridge {a}" for a in housing.RIDGE_ALPHAS} | {f"lasso {a}" for a in housing.LASSO_ALPHAS}
    top = housing.strongest(rows, 0.3, "neighborhood_").collect()
    assert len(top) == 25
    assert [abs(r.coefficient) for r in top] == sorted((abs(r.coefficient) for r in top), reverse=True)


def test_return_factors(spark, small):
    prices = fx.price_panel(spark, small).withColumnRenamed("month", "date")
    tickers = ["Brand#1", "Brand#2", "Brand#3"]
    got = market.return_factors(prices.where(F.col("ticker").isin(tickers)), 50, 2)
    assert got.returns.dropna().count() == got.returns.count() == 3 * got.projection.count()
    assert got.covariance.count() == 9 and len(got.components.eigenvalues) == 3


def test_equities(spark):
    raw = spark.createDataFrame([(1, "2.5", "--"), (2, "--", "10"), (3, "-4", "7")], "id bigint, peg string, cap string")
    clean = market.clean_equities(raw).orderBy("id").collect()
    assert [r.peg for r in clean] == pytest.approx([0.9162907, 0.0, 0.0])
    assert clean[0].cap == 0.0
    signed = market.log_equities(spark.createDataFrame([(1, -4.0, None)], "id bigint, peg double, cap double")).first()
    assert signed.peg == pytest.approx(-1.3862944) and signed.cap == 0.0
    rows, centres = market.cluster_equities(market.clean_equities(raw), k=2)
    assert rows.count() == 3 and len(centres) == 2


def test_general_regression(spark):
    df = spark.createDataFrame([(float(i), 3.0 + 2.0 * i) for i in range(5)], "x double, target double")
    got = {r.feature: r.coefficient for r in market.run_regression(df, rate=0.1).collect()}
    assert got == {"intercept": pytest.approx(3, abs=1e-4), "x": pytest.approx(2, abs=1e-4)}


def test_stream_gives_the_batch_decisions(spark, small):
    source, out, check = (fresh_path(spark, n) for n in ("rows", "out", "check"))
    rows = fx.scored(spark, small)
    rows.where("id < 700").write.parquet(source)

    def score(df):
        return cl.linear_score(df.withColumnRenamed("p", "x"), ["x"], [3.0], -1.0)

    def go():
        stream = spark.readStream.schema(rows.schema).parquet(source)
        decide_stream(stream, score, 0.5, out, checkpoint=check).awaitTermination(120)

    go()
    rows.where("id >= 700").write.mode("append").parquet(source)
    go()  # continues where it stopped
    got = {(r.id, r.reject) for r in spark.read.parquet(out).collect()}
    want = {(r.id, int(r.p >= 0.5)) for r in score(rows).collect()}
    assert got == want and spark.read.parquet(out).count() == rows.count()
