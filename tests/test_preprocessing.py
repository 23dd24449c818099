import pytest
from pyspark.sql import functions as F

from tallygrove.operators import preprocessing as prep


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, i % 2, "train" if i < 80 else "test", float(i), "abc"[i % 3] if i % 10 else None, 5.0, int(i % 4 == 0)) for i in range(100)]
    return spark.createDataFrame(data, "id bigint, label int, split string, x double, c string, k double, flag int")


def fitted(rows):
    pre = prep.Preprocess(["x", "k", "flag"], ["c"])
    return pre.fit(rows.where("split = 'train'"))


def test_test_rows_do_not_leak(rows):
    changed = rows.withColumn("x", F.when(F.col("split") == "test", F.col("x") * 1e6).otherwise(F.col("x"))).withColumn(
        "c", F.when(F.col("split") == "test", "new").otherwise(F.col("c"))
    )
    assert fitted(rows) == fitted(changed)


def test_columns_and_scaling(rows):
    model = fitted(rows)
    assert model.features == ["x", "flag", "c_a", "c_b", "c_c", "c_nan"]  # the constant is gone
    out = model.transform(rows)
    train = out.where("split = 'train'").agg(F.avg("x"), F.stddev_pop("x")).first()
    assert train[0] == pytest.approx(0, abs=1e-12) and train[1] == pytest.approx(1)
    assert {r.flag for r in out.select("flag").distinct().collect()} == {0, 1}


def test_unknown_category_gives_zeros(spark, rows):
    hot = prep.OneHot(["c"]).fit(rows)
    got = hot.transform(spark.createDataFrame([("zzz",), ("a",), (None,)], "c string")).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 0), (1, 0, 0, 0), (0, 0, 0, 1)]


def test_fixed_categories_raise_on_unknown(spark):
    hot = prep.one_hot_fixed({"c": ["a", "b"]})
    with pytest.raises(Exception, match="unknown c: z"):
        hot.transform(spark.createDataFrame([("z",)], "c string")).collect()


def test_too_many_categories(rows):
    with pytest.raises(ValueError, match="not a category"):
        prep.OneHot(["x"], max_categories=10).fit(rows)


@pytest.mark.parametrize("unknown", ["ignore", "error"])
def test_vector_form_agrees(spark, rows, unknown):
    hot = prep.OneHotModel({"c": ["a", "b", "c"]}, unknown)
    known = rows.where("c is not null").select("id", "c", "x")
    vectors = prep.column_transformer(["x"], hot).fit(known).transform(known).orderBy("id").collect()
    columns = hot.transform(known).orderBy("id").collect()
    for v, r in zip(vectors, columns):
        assert v.features.toArray().tolist() == [r.x, r.c_a, r.c_b, r.c_c]


def test_epsilon_scaling(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert [r.x for r in prep.standardize_train_only(["x"]).fit(df).transform(df).collect()] == pytest.approx([-1, 1])
    assert [r.x for r in prep.StandardScale(["x"]).fit(df.limit(1)).transform(df.limit(1)).collect()] == [0.0]
