"""Models (L), coefficients (L22, W8) and neighbours (J5)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from tallygrove.catalogue.registry import SCORED, STRATIFIED, register
from tallygrove.catalogue.statistics import ALIGNED
from tallygrove.operators import classification as cl
from tallygrove.operators import clustering, components, factors, forest, neighbours, network, panel, ranking, regression
from tallygrove.operators.evaluation import regression_metrics
from tallygrove.operators.preprocessing import assemble
from tallygrove.operators.splits import split_exact
from tallygrove.plans import fixtures as fx

# ------------------------------------------------------------------ gradient descent

LINES = """SELECT l_quantity / 50 AS q, l_discount * 10 AS d, l_tax * 10 AS t, l_extendedprice / 1000 AS y FROM lineitem"""


def descent_sql(xs: list[str], rate: float, steps: int, tol: float | None, names: list[str]) -> str:
    """The same iterates from the moments, by a recursive query."""
    k = len(xs)
    sums = [f"sum(({xs[i]}) * ({xs[j]})) AS g{i}{j}" for i in range(k) for j in range(k)]
    sums += [f"sum(({x}) * y) AS b{i}" for i, x in enumerate(xs)]
    move = [
        f"{rate} * ((" + " + ".join(f"g{i}{j} * t{j}" for j in range(k)) + f" - b{i}) / n)" for i in range(k)
    ]
    size = " + ".join(f"abs({m})" for m in move)
    go_on = f"i < {steps}" + (f" AND {size} >= {tol}" if tol else "")
    zeros = ", ".join(f"CAST(0.0 AS DOUBLE) AS t{i}" for i in range(k))
    nexts = ", ".join(f"t{i} - {m}" for i, m in enumerate(move))
    out = " UNION ALL ".join(f"SELECT '{n}' AS feature, t{i} AS coefficient FROM last" for i, n in enumerate(names))
    return f"""WITH RECURSIVE m AS MATERIALIZED (SELECT count(*) AS n, {', '.join(sums)} FROM ({LINES})),
      it AS (SELECT 0 AS i, {zeros} UNION ALL SELECT i + 1, {nexts} FROM it, m WHERE {go_on}),
      last AS (SELECT * FROM it ORDER BY i DESC LIMIT 1) {out}"""


def _ones(spark, folder):
    return fx.line_regression(spark, folder).withColumn("one", F.lit(1.0))


@register("l1_linreg_gd", descent_sql(["1.0", "q"], 0.01, 10_000, None, ["one", "q"]), "feature coefficient~")
def _(spark, folder):
    return regression.linreg_gd(_ones(spark, folder), ["one", "q"], "y", 0.01, 10_000).table(spark)


@register(
    "l2_linreg_gd_tolerance", descent_sql(["1.0", "q", "d"], 0.1, 100_000, 1e-7, ["one", "q", "d"]), "feature coefficient~", digits=4
)
def _(spark, folder):
    return regression.linreg_gd(_ones(spark, folder), ["one", "q", "d"], "y", 0.1, 100_000, 1e-7).table(spark)


@register(
    "l3_polyreg_gd", descent_sql(["1.0", "q", "q * q"], 0.01, 10_000, 1e-8, ["x0", "x1", "x2"]), "feature coefficient~", digits=4
)
def _(spark, folder):
    return regression.polyreg_gd(fx.line_regression(spark, folder), "q", "y", 2, 0.01, 10_000, 1e-8).table(spark)


# ------------------------------------------------------------------ ridge and lasso

RIDGE = f"""
  WITH m AS (SELECT count(*) AS n, avg(q) AS mq, avg(d) AS md, avg(y) AS my,
               var_pop(q) * count(*) + 0.3 AS a, covar_pop(q, d) * count(*) AS b, var_pop(d) * count(*) + 0.3 AS c,
               covar_pop(q, y) * count(*) AS u, covar_pop(d, y) * count(*) AS v FROM ({LINES})),
  w AS (SELECT *, (c * u - b * v) / (a * c - b * b) AS wq, (a * v - b * u) / (a * c - b * b) AS wd FROM m)
  SELECT 'intercept' AS feature, my - wq * mq - wd * md AS coefficient FROM w
  UNION ALL SELECT 'q', wq FROM w UNION ALL SELECT 'd', wd FROM w"""


def _ridge_table(spark, folder):
    rows = assemble(fx.line_regression(spark, folder), ["q", "d"], ["y"])
    return regression.model_coefficients(regression.ridge(rows, 0.3, label="y"), rows)


@register("l5_ridge", RIDGE, "feature coefficient~", digits=4)
def _(spark, folder):
    return _ridge_table(spark, folder)


@register("l22_coefficient_table", RIDGE, "feature coefficient~", digits=4)
def _(spark, folder):
    return _ridge_table(spark, folder)


@register("w8_rank_by_abs", f"SELECT * FROM ({RIDGE}) WHERE feature <> 'intercept' ORDER BY abs(coefficient) DESC", "feature coefficient~", digits=4)
def _(spark, folder):
    return ranking.rank_by_abs(_ridge_table(spark, folder).where("feature != 'intercept'"))


@register(
    "l6_lasso",
    f"""WITH m AS (SELECT covar_pop(q, y) AS c, var_pop(q) AS v, avg(q) AS mq, avg(y) AS my FROM ({LINES})),
        w AS (SELECT sign(c) * greatest(abs(c) - 0.1, 0.0) / v AS w, mq, my FROM m)
        SELECT 'intercept' AS feature, my - w * mq AS coefficient FROM w UNION ALL SELECT 'q', w FROM w""",
    "feature coefficient~",
    digits=4,
)
def _(spark, folder):
    rows = assemble(fx.line_regression(spark, folder), ["q"], ["y"])
    return regression.model_coefficients(regression.lasso(rows, 0.1, label="y"), rows)


# ------------------------------------------------------------------ logistic models and the linear SVM


def _newton_sql(penalised: bool, steps: int = 10) -> str:
    """Newton steps for one feature and an intercept, written out one after the other."""
    free = "b" if penalised else "0.0"
    own = 1.0 if penalised else 0.0
    ctes = [f"d AS MATERIALIZED (SELECT id, label AS y, p AS x FROM ({SCORED}))", "t0 AS (SELECT CAST(0.0 AS DOUBLE) AS b, CAST(0.0 AS DOUBLE) AS w)"]
    for i in range(steps):
        ctes.append(
            f"""s{i} AS (SELECT b, w, sum(1 / (1 + exp(-b - w * x)) - y) + {free} AS gb,
                  sum((1 / (1 + exp(-b - w * x)) - y) * x) + w AS gw,
                  sum(exp(-b - w * x) / pow(1 + exp(-b - w * x), 2)) + {own} AS hbb,
                  sum(x * exp(-b - w * x) / pow(1 + exp(-b - w * x), 2)) AS hbw,
                  sum(x * x * exp(-b - w * x) / pow(1 + exp(-b - w * x), 2)) + 1 AS hww FROM d, t{i} GROUP BY b, w)"""
        )
        ctes.append(
            f"""t{i + 1} AS (SELECT b - (hww * gb - hbw * gw) / (hbb * hww - hbw * hbw) AS b,
                  w - (hbb * gw - hbw * gb) / (hbb * hww - hbw * hbw) AS w FROM s{i})"""
        )
    return f"WITH {', '.join(ctes)} SELECT 'intercept' AS feature, b AS coefficient FROM t{steps} UNION ALL SELECT 'p', w FROM t{steps}"


def _one_feature(spark, folder):
    return assemble(fx.scored(spark, folder), ["p"])


@register("l7_logistic", _newton_sql(False), "feature coefficient~", digits=4)
def _(spark, folder):
    rows = _one_feature(spark, folder)
    return regression.model_coefficients(cl.logistic(rows), rows)


@register("l8_logistic_penalised", _newton_sql(True), "feature coefficient~", digits=4)
def _(spark, folder):
    m = cl.logistic_penalised(_one_feature(spark, folder))
    return regression.coefficient_table(spark, ["intercept", "p"], [m.intercept, *m.weights])


def _features(spark, folder):
    """Scored rows with two more features from the customer: id, label, split, features."""
    orders = fx.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_totalprice") / 100_000)
    orders = orders.toDF("id", "c_custkey", "price")
    customers = fx.table(spark, folder, "customer").select("c_custkey", (F.col("c_acctbal") / 5000).alias("balance"))
    split, orders = fx.dealt([fx.scored_split(spark, folder).drop("p"), orders], "id", fx.table(spark, folder, "orders").count())
    rows = split.join(orders, "id").join(customers, "c_custkey")
    rows = rows.withColumn("square", F.col("price") * F.col("price") / 5)
    return assemble(rows, ["price", "balance", "square"], ["id", "label", "split"])


@register("l9_logistic_path")
def _(spark, folder):
    rows = _features(spark, folder).persist()
    path = cl.logistic_path(rows.where("split = 'train'"), rows.where("split = 'validation'"))
    rows.unpersist()
    return spark.createDataFrame(
        [(c, loss, c == path.c) for c, loss in path.losses], "c double, validation_loss double, chosen boolean"
    )


def _path_sql(steps: int = 20) -> str:
    """Newton steps for one feature and an intercept at all penalties of the grid side by side, then the validation losses."""
    ctes = [
        f"d AS MATERIALIZED (SELECT label AS y, p AS x, split FROM ({STRATIFIED}))",
        f"t0 AS (SELECT unnest([{', '.join(map(repr, cl.C_GRID))}]::DOUBLE[]) AS c, 0.0::DOUBLE AS b, 0.0::DOUBLE AS w)",
    ]
    for i in range(steps):
        ctes.append(
            f"""s{i} AS MATERIALIZED (SELECT c, b, w, sum(1 / (1 + exp(-b - w * x)) - y) AS gb,
                  sum((1 / (1 + exp(-b - w * x)) - y) * x) + w / c AS gw,
                  sum(exp(-b - w * x) / pow(1 + exp(-b - w * x), 2)) AS hbb,
                  sum(x * exp(-b - w * x) / pow(1 + exp(-b - w * x), 2)) AS hbw,
                  sum(x * x * exp(-b - w * x) / pow(1 + exp(-b - w * x), 2)) + 1 / c AS hww
                FROM d, t{i} WHERE split = 'train' GROUP BY c, b, w)"""
        )
        ctes.append(
            f"""t{i + 1} AS (SELECT c, b - (hww * gb - hbw * gw) / (hbb * hww - hbw * hbw) AS b,
                  w - (hbb * gw - hbw * gb) / (hbb * hww - hbw * hbw) AS w FROM s{i})"""
        )
    return f"""WITH {', '.join(ctes)}
      SELECT c, avg(-y * ln(1 / (1 + exp(-b - w * x))) - (1 - y) * ln(1 - 1 / (1 + exp(-b - w * x)))) AS validation_loss
      FROM d, t{steps} WHERE split = 'validation' GROUP BY c"""


@register("l9_logistic_path_one_feature", _path_sql(), "c~ validation_loss~", digits=4)
def _(spark, folder):
    rows = assemble(fx.scored_split(spark, folder), ["p"], ["id", "label", "split"]).persist()
    path = cl.logistic_path(rows.where("split = 'train'"), rows.where("split = 'validation'"))
    rows.unpersist()
    return spark.createDataFrame([(float(c), loss) for c, loss in path.losses], "c double, validation_loss double")


LINEAR = f"SELECT id, 1 / (1 + exp(-(-0.5 + 1.25 * p + -0.75 * label))) AS p FROM ({SCORED})"


@register("l10_predict_proba", f"SELECT id, p, CAST(p >= 0.5 AS INTEGER) AS predicted FROM ({LINEAR})", "id p~ predicted")
def _(spark, folder):
    df = cl.linear_score(fx.scored(spark, folder), ["p", "label"], [1.25, -0.75], -0.5, "score")
    return df.select("id", F.col("score").alias("p"), (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register(
    "l10_fitted_curve",
    f"""SELECT x, 2.0 - 3.0 * x + x * x AS y FROM (SELECT lo + i * ((hi - lo) / 99.0::DOUBLE) AS x
        FROM (SELECT min(q) AS lo, max(q) AS hi FROM ({LINES})), (SELECT unnest(range(100)) AS i))""",
    "x~ y~",
)
def _(spark, folder):
    xs = cl.curve_points(fx.line_regression(spark, folder), "q", 100, "x")
    return xs.select("x", (2.0 - 3.0 * F.col("x") + F.col("x") * F.col("x")).alias("y"))


@register("l11_svm_boundary")
def _(spark, folder):
    rows = fx.scored(spark, folder).withColumn("x2", F.col("label") * 0.5 + F.col("p") / 4)
    vectors = assemble(rows, ["p", "x2"]).persist()
    model = cl.svm_linear(vectors)
    vectors.unpersist()
    return cl.boundary_line(rows, "p", model)


# ------------------------------------------------------------------ clustering and components


@register("l12_kmeans")
def _(spark, folder):
    df = fx.equities(spark, folder)
    rows = assemble(df, ["size", "style"], ["id", "size", "style"]).persist()
    _, centres = clustering.kmeans(rows, 9, 42)
    out = clustering.kmeans_assign(rows.withColumn("vec", F.array("size", "style")), centres, "vec")
    rows.unpersist()
    return out.select("id", "cluster", "cluster_distance")


CENTRES = """
  WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  x AS (SELECT vec_id, label, unnest(v) AS a, generate_subscripts(v, 1) AS i FROM e),
  m AS (SELECT label, i, avg(a) AS a FROM x GROUP BY label, i),
  r AS (SELECT DISTINCT label, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM e),
  d AS (SELECT x.vec_id, r.cluster, sum((x.a - m.a) * (x.a - m.a)) AS d FROM x JOIN m ON m.i = x.i JOIN r ON r.label = m.label GROUP BY 1, 2),
  n AS (SELECT vec_id, CAST(arg_min(cluster, d) AS INTEGER) AS cluster, min(d) AS cluster_distance FROM d GROUP BY vec_id)"""


def _vectors(spark, folder):
    return fx.table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


def _label_means(spark, folder):
    """Mean vector per label, in label order: ten rows at any scale."""
    means = _vectors(spark, folder).groupBy("label").agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("m"))
    return [list(r.m) for r in means.orderBy("label").collect()]


@register("l13_kmeans_assign", f"{CENTRES} SELECT vec_id, cluster, cluster_distance FROM n", "vec_id cluster cluster_distance~")
def _(spark, folder):
    return clustering.kmeans_assign(_vectors(spark, folder), _label_means(spark, folder), "vec").select(
        "vec_id", "cluster", "cluster_distance"
    )


@register(
    "l13_lloyd_step",
    f"""{CENTRES} SELECT n.cluster, CAST(x.i - 1 AS INTEGER) AS dim, count(*) AS n, avg(x.a) AS value
        FROM n JOIN x USING (vec_id) GROUP BY n.cluster, x.i""",
    "cluster dim n value~",
)
def _(spark, folder):
    step = clustering.lloyd_step(_vectors(spark, folder), _label_means(spark, folder), "vec")
    return step.select("cluster", "n", F.posexplode("centre").alias("dim", "value"))


def _wide_returns(spark, folder):
    prices = panel.tail_dates(fx.price_panel(spark, folder), "month", 400)
    returns = panel.date_align(panel.pct_change(prices, "ticker", "month", "price"), "ticker", "month", "ret")
    tickers = [r[0] for r in prices.select("ticker").distinct().orderBy("ticker").collect()]  # the columns
    return panel.to_wide(returns, "ticker", "month", "ret", tickers).checkpoint(), tickers


def _factors(spark, folder):
    prices = panel.tail_dates(fx.price_panel(spark, folder), "month", 400)
    returns = panel.date_align(panel.pct_change(prices, "ticker", "month", "price"), "ticker", "month", "ret").checkpoint()
    return factors.panel_factors(returns, "ticker", "month", "ret", 3)


@register("l14_pca_shares")
def _(spark, folder):
    return _factors(spark, folder).shares(spark)


@register("l14_pca_projection")
def _(spark, folder):
    return _factors(spark, folder).scores(spark, "month")


@register(
    "l14_factor_checks",
    f"""SELECT sum(v) AS trace, sum(v) AS eigenvalue_sum, true AS stationary
        FROM (SELECT var_samp(ret) AS v FROM ({ALIGNED}) GROUP BY ticker)""",
    "trace~ eigenvalue_sum~ stationary",
)
def _(spark, folder):
    found = _factors(spark, folder)
    trace, residual = found.checks()
    return spark.createDataFrame([(trace, float(found.eigenvalues.sum()), residual < 1e-9)], "trace double, eigenvalue_sum double, stationary boolean")


# the eigenpairs of a two by two covariance, written out; a vector's largest entry is positive
TWO_TICKERS = f"""
  WITH r AS ({ALIGNED}), t AS (SELECT DISTINCT ticker FROM r ORDER BY ticker LIMIT 2),
  x AS (SELECT month, max(ret) FILTER (ticker = (SELECT min(ticker) FROM t)) AS a,
          max(ret) FILTER (ticker = (SELECT max(ticker) FROM t)) AS b FROM r GROUP BY month),
  m AS (SELECT var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM x),
  e AS (SELECT va, c, (va + vb) / 2 + side * sqrt(pow((va - vb) / 2, 2) + c * c) AS l, CASE WHEN side > 0 THEN 1 ELSE 2 END AS k
        FROM m, (SELECT unnest([1.0::DOUBLE, -1.0]) AS side)),
  v AS (SELECT k, l, c / sqrt(c * c + (l - va) * (l - va)) AS v1, (l - va) / sqrt(c * c + (l - va) * (l - va)) AS v2 FROM e),
  s AS (SELECT k, l, v1, v2, CASE WHEN abs(v1) >= abs(v2) THEN sign(v1) ELSE sign(v2) END AS side FROM v)"""


@register(
    "l14_pca_two_shares",
    f"{TWO_TICKERS} SELECT CAST(k AS INTEGER) AS component, l AS eigenvalue, l / (SELECT sum(l) FROM s) AS share FROM s",
    "component eigenvalue~ share~",
)
def _(spark, folder):
    wide, tickers = _wide_returns(spark, folder)
    return components.pca(wide, tickers[:2], 2).shares(spark)


@register(
    "l14_pca_two_projection",
    f"""{TWO_TICKERS} SELECT month, max(side * (v1 * a + v2 * b)) FILTER (k = 1) AS pc1,
        max(side * (v1 * a + v2 * b)) FILTER (k = 2) AS pc2 FROM x, s GROUP BY month""",
    "month pc1~ pc2~",
)
def _(spark, folder):
    wide, tickers = _wide_returns(spark, folder)
    return components.pca(wide, tickers[:2], 2).project(wide, ["month"])


# ------------------------------------------------------------------ forest, searches, network


def _houses(spark, folder):
    """Parts as houses, one row each: id, label and a feature vector, split three ways."""
    df = fx.houses(spark, folder)
    n = df.count()
    return split_exact(assemble(df, ["size", "level", "list_price", "sold", "mean_quantity"]), int(0.6 * n), int(0.2 * n), 42)


@register("l15_random_forest")
def _(spark, folder):
    rows = _houses(spark, folder)
    model = forest.random_forest_regressor(rows.where("split = 'train'"), trees=100, depth=10, out_of_bag=True)
    table = regression_metrics(model.transform(rows.where("split = 'test'")), "label", "prediction")
    return table.withColumn("out_of_bag_r2", F.lit(model.out_of_bag_r2))


STUMP = """
  WITH r AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS size, CAST(p_partkey % 7 AS DOUBLE) AS shelf, p_retailprice AS y FROM part),
  v AS (SELECT id, 0 AS f, size AS x, y FROM r UNION ALL SELECT id, 1, shelf, y FROM r),
  g AS (SELECT f, x, count(*) AS n, sum(y) AS s FROM v GROUP BY f, x),
  c AS (SELECT f, x, lead(x) OVER (PARTITION BY f ORDER BY x) AS nx, sum(n) OVER w AS ln, sum(s) OVER w AS ls,
          sum(n) OVER (PARTITION BY f) AS n, sum(s) OVER (PARTITION BY f) AS s
        FROM g WINDOW w AS (PARTITION BY f ORDER BY x)),
  b AS (SELECT f, (x + nx) / 2 AS cut, ls / ln AS low, (s - ls) / (n - ln) AS high FROM c WHERE nx IS NOT NULL
        ORDER BY ls * ls / ln + (s - ls) * (s - ls) / (n - ln) DESC, f, x LIMIT 1)
  SELECT id, CASE WHEN (CASE WHEN f = 0 THEN size ELSE shelf END) <= cut THEN low ELSE high END AS prediction FROM r, b"""


@register("l15_tree_of_depth_one", STUMP, "id prediction~")
def _(spark, folder):
    parts = fx.table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 7).cast("double").alias("shelf"),
        F.col("p_retailprice").cast("double").alias("label"),
    )
    rows = assemble(parts, ["size", "shelf"], ["id", "label"])
    model = forest.random_forest_regressor(rows, trees=1, depth=1, features=None, bootstrap=False)
    return model.transform(rows).select("id", "prediction")


@register("l16_forest_search")
def _(spark, folder):
    train = _houses(spark, folder).where("split = 'train'").persist()
    found = forest.search_forest(train)
    train.unpersist()
    return found.table(spark)


@register("l16_random_search")
def _(spark, folder):
    train = _houses(spark, folder).where("split = 'train'").persist()
    found = forest.random_search(train, forest.fit_ridge, forest.RIDGE_SPACE)
    train.unpersist()
    return found.table(spark)


def _network_rows(spark, folder):
    rows = _features(spark, folder)
    return rows.where("split = 'train'"), rows.where("split = 'validation'")


@register("l17_mlp_classifier")
def _(spark, folder):
    train, validation = _network_rows(spark, folder)
    model = network.fit_mlp(train, validation, network.MlpParams(layers=1, units=64, alpha0=0.01, bn_momentum=0.9))
    return model.transform(validation).select("id", "label", "p")


@register("l19_early_stopping_history")
def _(spark, folder):
    train, validation = _network_rows(spark, folder)
    p = network.MlpParams(layers=1, units=64, activation="tanh", alpha0=0.02, bn_momentum=0.9)
    return network.fit_mlp(train, validation, p).history_table(spark)


@register("l20_mlp_random_search")
def _(spark, folder):
    train, validation = _network_rows(spark, folder)
    _, trials = network.mlp_random_search(train, validation)
    return spark.createDataFrame(
        [(i, p.layers, p.units, p.activation, loss) for i, (p, loss) in enumerate(trials)],
        "trial int, layers int, units int, activation string, validation_loss double",
    )


@register("l21_gradient_check")
def _(spark, folder):
    rows = network.training_rows(*_network_rows(spark, folder))
    p = network.MlpParams(layers=2, units=8, activation="tanh")
    off = network.gradient_check(rows, p, 3, network.initial(p, 3))
    rows.unpersist()
    return spark.createDataFrame([(off, off < 1e-5)], "relative_difference double, passed boolean")


# ------------------------------------------------------------------ neighbours

KNN = """
  WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  d AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, b.label, list_distance(a.v, b.v) AS distance FROM e a, e b WHERE a.vec_id <> b.vec_id),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS INTEGER) AS rank FROM d),
  n AS (SELECT * FROM r WHERE rank <= 5)"""


@register("j5_knn", f"{KNN} SELECT id, neighbour, distance, rank FROM n", "id neighbour distance~ rank")
def _(spark, folder):
    rows = fx.table(spark, folder, "embeddings").withColumnRenamed("embedding", "vec")
    return neighbours.knn(rows, rows, 5, "vec_id", "vec", skip_self=True)


@register(
    "j5_knn_vote",
    f"""{KNN}, v AS (SELECT id, label, count(*) AS votes, min(distance) AS near FROM n GROUP BY id, label)
        SELECT id, label AS predicted, votes FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, near) AS k FROM v) WHERE k = 1""",
)
def _(spark, folder):
    rows = fx.table(spark, folder, "embeddings").withColumnRenamed("embedding", "vec")
    return neighbours.knn_vote(neighbours.knn(rows, rows, 5, "vec_id", "vec", skip_self=True), rows, "vec_id", "label")
