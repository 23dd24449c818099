import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.operators import statistics as st


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 3.0, size=(400, 15))
    x[:, 4] = x[:, 3] * 2 + rng.normal(size=400)
    x[:, 14] = 7.0
    cols = [f"c{i}" for i in range(15)]
    rows = [[None if (i + j) % 50 == 0 else float(v) for j, v in enumerate(r)] for i, r in enumerate(x)]
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} double" for c in cols)).repartition(4), cols


def as_dict(df):
    return {(r.col_a, r.col_b): r.value for r in df.collect()}


def test_wide_and_narrow_covariance_agree_with_pandas(table):
    df, cols = table
    want = df.toPandas().cov()
    for some in (cols, cols[:5]):  # both plans
        got = as_dict(st.covariance_matrix(df, some))
        for a in some:
            for b in some:
                assert got[a, b] == pytest.approx(want.loc[a, b], rel=1e-6, abs=1e-6)


def test_correlation(table):
    df, cols = table
    want = df.toPandas().corr()
    for some in (cols, [*cols[:4], "c14"]):
        got = as_dict(st.correlation_matrix(df, some))
        for a in some:
            for b in some:
                if "c14" in (a, b):
                    assert got[a, b] is None
                else:
                    assert got[a, b] == pytest.approx(want.loc[a, b], abs=1e-6)
    pairs = st.high_corr_pairs(st.correlation_matrix(df, cols), cols).collect()
    assert [(r.col_a, r.col_b) for r in pairs] == [("c3", "c4")]


def test_near_constant(spark):
    df = spark.range(2000).select(
        (F.col("id") == 5).cast("int").alias("rare"),
        (F.col("id") % 2).cast("int").alias("even"),
        F.when(F.col("id") == 7, 1.5).otherwise(3.25).alias("odd_one"),
        F.when(F.col("id") == 7, F.col("id")).alias("absent"),
        F.rand(1).alias("spread"),
    )
    got = {r["column"]: r.top_share for r in st.near_constant_columns(df, df.columns, 0.999).collect()}
    assert got == {c: pytest.approx(1999 / 2000) for c in ("rare", "odd_one", "absent")}
    low = {r["column"]: r.top_share for r in st.near_constant_columns(df, df.columns, 0.4).collect()}
    assert low == {**got, "even": 0.5}


def test_describe_matches_pandas(table):
    df, cols = table
    want = df.toPandas()[cols[:2]].describe()
    for r in st.describe(df, cols[:2]).collect():
        w = want[r["column"]]
        assert [r["count"], r["mean"], r["std"], r["min"], r["q25"], r["q50"], r["q75"], r["max"]] == pytest.approx(
            [w["count"], w["mean"], w["std"], w["min"], w["25%"], w["50%"], w["75%"], w["max"]]
        )


def test_binary_like(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, None, None)], "a int, b double, c int").withColumn("d", F.lit(2))
    got = {r["column"]: r.is_binary for r in st.binary_like(df, ["a", "b", "c", "d"]).collect()}
    assert got == {"a": True, "b": True, "c": True, "d": False}


def test_require_complete(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "a int, b double")
    with pytest.raises(ValueError, match=r"b \(1\)"):
        st.require_complete(df)
    st.require_complete(df.dropna())


def test_histogram_matches_numpy(scored):
    p = scored.toPandas()
    got = {r.bin: r.n for r in st.histogram(scored, "p", 10).collect()}
    want, _ = np.histogram(p["p"], 10)
    assert sum(got.values()) == len(p)
    assert sum(abs(got.get(i, 0) - w) for i, w in enumerate(want)) <= 2  # a value on an edge may round either way
    one = st.histogram(scored.withColumn("p", F.lit(0.5)), "p", 4).collect()
    assert [(r.bin, r.n) for r in one] == [(2, 2000)]


def test_missing_values_and_constants_count_alike_at_every_width(spark):
    rows = [(1.0, 2.0, 0.1), (2.0, 1.0, 0.1), (float("nan"), 5.0, 0.1), (4.0, None, 0.1), (5.0, 7.0, 0.1), (3.0, 3.5, 0.1)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    wide = df.select("*", *[(F.col("a") * k).alias(f"x{k}") for k in range(10)])
    assert len(wide.columns) == st.WIDE + 1
    for matrix in (st.covariance_matrix, st.correlation_matrix):
        pair = lambda cols: {
            (r.col_a, r.col_b): None if r.value is None else round(r.value, 9)
            for r in matrix(wide, cols).collect()
            if {r.col_a, r.col_b} <= {"a", "b", "c"}
        }
        assert pair(wide.columns) == pair(wide.columns[:-1])
        assert pair(wide.columns)["a", "b"] is not None
        assert pair(wide.columns)["c", "a"] == (0.0 if matrix is st.covariance_matrix else None)


def test_missing_values_of_odd_names(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "`a.b` int, `c d.e` int")
    assert {r["column"]: r["missing"] for r in st.missing_counts(df).collect()} == {"a.b": 0, "c d.e": 1}
    with pytest.raises(ValueError, match="c d.e"):
        st.require_complete(df)
