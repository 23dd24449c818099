import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.operators import classification as cl
from tallygrove.operators import clustering, components, forest, regression
from tallygrove.operators.preprocessing import assemble


def line(spark, xs, ys):
    return spark.createDataFrame(list(zip(map(float, xs), map(float, ys))), "x double, y double").withColumn("one", F.lit(1.0))


# the twelve points of the quadratic golden come from the survey's inputs
LINE = ([1, 2, 3, 4, 5], [3, 8, 5, 14, 19])


def test_descent_golden(spark):
    got = regression.linreg_gd(line(spark, *LINE), ["one", "x"], "y", 0.01, 10_000)
    assert got.theta == pytest.approx([-1.59999989, 3.79999997], abs=1e-8)
    assert got.converged


def test_tolerance_returns_the_parameters_before_the_last_step(spark):
    df = line(spark, *LINE)
    stopped = regression.linreg_gd(df, ["one", "x"], "y", 0.01, 100_000, 1e-7)
    assert stopped.converged and stopped.steps < 100_000
    same = regression.linreg_gd(df, ["one", "x"], "y", 0.01, stopped.steps)
    assert same.theta == stopped.theta


def test_quadratic_descent_equals_row_by_row(spark):
    x = np.arange(0.1, 2.4, 0.2)
    y = 5 - 11 * x + 7 * x * x + np.sin(9 * x)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = regression.polyreg_gd(df, "x", "y")
    m = np.column_stack([np.ones_like(x), x, x * x])
    theta = np.zeros(3)
    for _ in range(got.steps):
        theta -= 0.01 / len(x) * (m.T @ (m @ theta - y))
    assert got.theta == pytest.approx(theta.tolist(), abs=1e-8)
    assert got.steps == 10_000 and not got.converged


def test_divergence_raises(spark):
    with pytest.raises(ValueError, match="diverges"):
        regression.linreg_gd(line(spark, [100, 200, 300], [1, 2, 3]), ["one", "x"], "y", 0.1, 5000, 1e-7)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4)) * [1, 2, 0.5, 3] + [0, 5, 1, -2]
    y = x @ [1.5, -2.0, 0.0, 0.3] + 4 + rng.normal(size=400)
    c = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.4 * x[:, 1] + 2)))).astype(int)
    rows = [(i, *map(float, x[i]), float(y[i]), int(c[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double, y double, label int")
    return assemble(df, ["a", "b", "c", "d"], ["id", "y", "label"]).persist(), x, y, c


@pytest.mark.parametrize("alpha", [0.1, 30.0])
@pytest.mark.parametrize("limit", [4096, 1])
def test_ridge_solves_its_normal_equations(data, alpha, limit, monkeypatch):
    df, x, y, _ = data
    monkeypatch.setattr(regression, "NORMAL_FEATURES", limit)  # both solvers
    m = regression.ridge(df, alpha, label="y")
    xc = x - x.mean(0)
    want = np.linalg.solve(xc.T @ xc + alpha * np.eye(4), xc.T @ (y - y.mean()))
    assert m.coefficients.toArray() == pytest.approx(want, abs=1e-5)
    table = {r.feature: r.coefficient for r in regression.model_coefficients(m, df).collect()}
    assert table["b"] == pytest.approx(want[1], abs=1e-5) and set(table) == {"intercept", "a", "b", "c", "d"}


def test_ridge_without_intercept(data):
    df, x, y, _ = data
    m = regression.ridge(df, 3.0, label="y", fit_intercept=False)
    assert m.coefficients.toArray() == pytest.approx(np.linalg.solve(x.T @ x + 3 * np.eye(4), x.T @ y), abs=1e-8)


@pytest.mark.parametrize("alpha", [0.05, 0.5])
def test_lasso_optimality(data, alpha):
    df, x, y, _ = data
    w = regression.lasso(df, alpha, label="y").coefficients.toArray()
    xc = x - x.mean(0)
    g = xc.T @ (y - y.mean() - xc @ w) / len(y)
    for wi, gi in zip(w, g):
        assert gi == pytest.approx(alpha * np.sign(wi), abs=1e-4) if abs(wi) > 1e-8 else abs(gi) <= alpha + 1e-6


def test_logistic_gradient_vanishes(data):
    df, x, _, c = data
    m = cl.logistic(df, 0.7)
    w = m.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + m.intercept)))
    assert w + 0.7 * x.T @ (p - c) == pytest.approx(np.zeros(4), abs=1e-3)
    assert (p - c).sum() == pytest.approx(0, abs=1e-3)
    got = cl.predict_proba(m, df).orderBy("id").toPandas()
    assert got["p"].to_numpy() == pytest.approx(p) and (got["predicted"] == (got["p"] > 0.5)).all()


def test_penalised_intercept(data):
    df, x, _, c = data
    m = cl.logistic_penalised(df, 0.7)
    theta, z = np.array([m.intercept, *m.weights]), np.column_stack([np.ones(len(x)), x])
    p = 1 / (1 + np.exp(-(z @ theta)))
    assert theta + 0.7 * z.T @ (p - c) == pytest.approx(np.zeros(5), abs=1e-3)
    assert m.transform(df).orderBy("id").toPandas()["p"].to_numpy() == pytest.approx(p)


def test_penalised_rows_are_made_once(spark, data):
    df, *_ = data
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(value):
        seen.add(1)
        return value

    rows = df.persist()
    m = cl.logistic_penalised(rows.withColumn("label", counted("label")), 0.7)
    assert seen.value == rows.count()
    want = cl.logistic_penalised(rows, 0.7)
    assert [m.intercept, *m.weights] == pytest.approx([want.intercept, *want.weights], rel=1e-9)
    rows.unpersist()


def test_path_keeps_the_smallest_loss(data):
    df, *_ = data
    path = cl.logistic_path(df.where("id < 300"), df.where("id >= 300"), [0.001, 1.0, 1.0])
    losses = [loss for _, loss in path.losses]
    assert path.c == [0.001, 1.0, 1.0][losses.index(min(losses))]


def test_svm_is_not_beaten_nearby(data):
    df, x, _, c = data
    m = cl.svm_linear(df, 1.0)

    def objective(w, b):
        return w @ w / 2 + np.maximum(0, 1 - (2 * c - 1) * (x @ w + b)).sum()

    w, b = m.coefficients.toArray(), m.intercept
    best, rng = objective(w, b), np.random.default_rng(1)
    tries = [objective(w + rng.normal(0, s, 4), b + rng.normal(0, s)) for s in (1e-1, 1e-2, 1e-3) for _ in range(200)]
    assert best <= min(tries) * (1 + 1e-3)


def test_boundary_line(spark):
    rows = [(i, float(i % 10), float(i // 10), int(i % 10 > i // 10)) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, x1 double, x2 double, label int")
    model = cl.svm_linear(assemble(df, ["x1", "x2"]))
    points = cl.boundary_line(df, "x1", model).collect()
    w, b = model.coefficients.toArray(), model.intercept
    assert len(points) == 100 and points[0].x1 == 0.0 and points[-1].x1 == 9.0
    assert all(abs(w[0] * r.x1 + w[1] * r.x2 + b) < 1e-9 for r in points)


def test_kmeans(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(m, 0.2, size=(60, 2)) for m in (0, 4, 9)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<double>")
    rows = assemble(df.select("id", F.col("vec")[0].alias("u"), F.col("vec")[1].alias("v")), ["u", "v"], ["id"])
    _, centres = clustering.kmeans(rows, 3, 42)
    assert centres == sorted(centres)
    want = np.array([x[i * 60 : (i + 1) * 60].mean(0) for i in range(3)])
    assert np.array(centres) == pytest.approx(want, abs=1e-6)
    step = {r.cluster: r.centre for r in clustering.lloyd_step(df, centres, "vec").collect()}
    assert np.array([step[i] for i in range(3)]) == pytest.approx(want, abs=1e-9)  # a fixed point
    total = sum(r.inertia for r in clustering.inertia(df, centres, "vec").collect())
    assert total == pytest.approx(sum(((x[i * 60 : (i + 1) * 60] - want[i]) ** 2).sum() for i in range(3)))


def test_kmeans_tasks_in_proportion_to_the_vectors(spark):
    points = [(float(i % 4 * 10 + i % 3), float(i % 4)) for i in range(400)]
    rows = assemble(spark.createDataFrame(points, "u double, v double"), ["u", "v"], []).repartition(40).persist()
    rows.count()
    context, status = spark.sparkContext, spark.sparkContext.statusTracker()
    context.setJobGroup("kmeans-tasks", "kmeans")
    _, centres = clustering.kmeans(rows, 4, 42)
    context.setLocalProperty("spark.jobGroup.id", None)
    rows.unpersist()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("kmeans-tasks") for s in status.getJobInfo(j).stageIds]
    tasks = [s.numTasks for s in stages if s]
    assert len(tasks) > 8 and sum(n > 1 for n in tasks) <= 8  # the rows are written and packed; iterations need one task
    assert len(centres) == 4


def test_components(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5)) + 3
    cols = [f"c{i}" for i in range(5)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id bigint, " + ", ".join(f"{c} double" for c in cols))
    got = components.pca(df, cols, 3)
    cov = np.cov(x.T)
    assert sum(got.eigenvalues) == pytest.approx(np.trace(cov))
    for value, v in zip(got.eigenvalues, got.loadings):
        assert cov @ v == pytest.approx(value * np.array(v), abs=1e-8)
        assert max(v, key=abs) > 0
    scores = got.project(df, ["id"]).orderBy("id").toPandas()[["pc1", "pc2", "pc3"]].to_numpy()
    assert scores == pytest.approx(x @ np.array(got.loadings).T)
    assert got.shares(spark).agg(F.sum("share")).first()[0] == pytest.approx(1)


def test_forest_and_search(data):
    df, _, y, _ = data
    rows = df.select("id", F.col("y").alias("label"), "features").persist()
    with pytest.raises(forest.Unusable):
        forest.random_forest_regressor(rows, bootstrap=False, out_of_bag=True)
    a, b = (forest.random_forest_regressor(rows, trees=5, depth=4).transform(rows).agg(F.sum("prediction")).first()[0] for _ in range(2))
    assert a == b

    def fit(df, alpha, out_of_bag):
        if out_of_bag:
            raise forest.Unusable("no")
        return regression.ridge(df, alpha)

    found = forest.random_search(rows, fit, {"alpha": [0.1, 1e6], "out_of_bag": [True, False]}, n_iter=4)
    assert found.params == {"alpha": 0.1, "out_of_bag": False}
    assert sorted(s is None for _, s in found.trials) == [False, False, True, True]


def test_path_side_by_side_is_stationary_and_as_single_fits(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 4)) * [1, 100, 0.01, 1]  # scales that a quasi-Newton fit finds hard
    x[:, 3] = x[:, 0] + 1e-3 * x[:, 3]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] + 0.02 * x[:, 1] - 0.5)))).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(400)], ["id", "label", *"abcd"])
    rows = assemble(df.repartition(3), list("abcd")).persist()
    path = cl.logistic_path(rows, rows, cl.C_GRID)
    assert path.passes < 30 and max(path.gradients) < 1e-8
    one = np.column_stack([np.ones(400), x])
    for c, m in zip(cl.C_GRID, path.models):
        w = np.array([m.intercept, *m.weights])
        p = 1 / (1 + np.exp(-one @ w))
        assert np.abs(one.T @ (p - y) + np.array([0, *m.weights]) / c).max() < 1e-5
    single = cl.logistic(rows, 1.0)
    assert path.models[6].weights[:2] == pytest.approx(single.coefficients.toArray()[:2], rel=2e-2, abs=1e-3)
    p = 1 / (1 + np.exp(-one @ np.array([path.best.intercept, *path.best.weights])))
    assert dict(path.losses)[path.c] == pytest.approx(-np.mean(np.where(y == 1, np.log(p), np.log1p(-p))), abs=1e-9)
    assert cl.predict_proba(path.best, rows).orderBy("id").toPandas().p.to_numpy() == pytest.approx(p, abs=1e-9)
    rows.unpersist()


def test_path_of_one_class_and_of_many_features(spark, monkeypatch):
    df = assemble(spark.createDataFrame([(i, 1, float(i)) for i in range(20)], "id long, label int, a double"), ["a"])
    path = cl.logistic_path(df, df, [0.1, 1.0])
    assert path.losses[0][1] < 0.01 and all(np.isfinite(m.intercept) for m in path.models)
    mixed = assemble(spark.createDataFrame([(i, i % 3 == 0, float(i % 7)) for i in range(90)], "id long, label boolean, a double").selectExpr("id", "int(label) label", "a"), ["a"])
    narrow = cl.logistic_path(mixed, mixed, [0.1, 10.0])
    monkeypatch.setattr(cl, "WIDEST", 0)
    wide = cl.logistic_path(mixed, mixed, [0.1, 10.0])
    assert [x for _, x in wide.losses] == pytest.approx([x for _, x in narrow.losses], abs=1e-6)
