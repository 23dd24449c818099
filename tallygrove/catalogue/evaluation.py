"""Ranking (W4-W8) and evaluation (E) of the scored view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrove.catalogue.registry import SCORED, STRATIFIED, register
from tallygrove.operators import evaluation as ev
from tallygrove.operators import ranking
from tallygrove.plans.fixtures import line_regression, scored, scored_split

POINTS = f"""
  WITH s AS ({SCORED}), g AS (SELECT p AS threshold, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM s GROUP BY p),
  t AS (SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(n - pos) AS BIGINT) AS negatives FROM g),
  c AS (SELECT threshold, n, pos, CAST(sum(n) OVER w AS BIGINT) AS run_n, CAST(sum(pos) OVER w AS BIGINT) AS tp,
               CAST(sum(n - pos) OVER w AS BIGINT) AS fp, positives, negatives
        FROM g, t WINDOW w AS (ORDER BY threshold DESC))"""

# the same view with heavy ties
TIED = f"SELECT id, label, round(p, 2) AS p FROM ({SCORED})"


def _tied(spark, folder):
    return scored(spark, folder).withColumn("p", F.round("p", 2))


@register(
    "w4_global_cumsum",
    f"""SELECT id, row_number() OVER w AS row_no, CAST(sum(label) OVER w AS BIGINT) AS run_label FROM ({TIED})
        WINDOW w AS (ORDER BY p, id ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, folder):
    return ranking.running_rows(_tied(spark, folder), "p", "id", ["label"]).select("id", "row_no", "run_label")


GAINS = f"""
  WITH r AS (SELECT label, p, row_number() OVER (ORDER BY p DESC, id) AS rn, count(*) OVER () AS n FROM ({SCORED})),
  b AS (SELECT CAST(greatest(1, ceil((rn - 1) * 10.0 / (n - 1))) AS INTEGER) AS decile, label, p FROM r),
  g AS (SELECT decile, count(*) AS n, CAST(sum(label) AS BIGINT) AS bads, avg(p) AS avg_p FROM b GROUP BY decile),
  c AS (SELECT *, CAST(sum(n) OVER w AS BIGINT) AS cum_n, CAST(sum(bads) OVER w AS BIGINT) AS cum_bads,
               sum(n) OVER () AS all_n, sum(bads) OVER () AS all_bads FROM g WINDOW w AS (ORDER BY decile))
  SELECT decile, n, bads, bads / n AS bad_rate, avg_p, (bads / n) / (all_bads / all_n) AS lift, cum_n, cum_bads,
         cum_bads / cum_n AS cum_bad_rate, cum_bads / all_bads AS capture FROM c"""
GAINS_COLS = "decile n bads bad_rate~ avg_p~ lift~ cum_n cum_bads cum_bad_rate~ capture~"


@register("w5_gains_table", GAINS, GAINS_COLS)
def _(spark, folder):
    return ranking.gains_table(scored(spark, folder))


@register(
    "w6_safest_first_table",
    f"""WITH r AS (SELECT label, p, row_number() OVER (ORDER BY p, id) - 1 AS rn, count(*) OVER () AS n FROM ({SCORED})),
        b AS (SELECT CAST(least((rn * 10) // n, 9) + 1 AS INTEGER) AS decile, label, p FROM r)
        SELECT decile, count(*) AS n, avg(p) AS avg_p, avg(label) AS bad_rate,
               avg(label) / ((SELECT avg(label) FROM r) + 1e-12) AS lift FROM b GROUP BY decile""",
    "decile n avg_p~ bad_rate~ lift~",
)
def _(spark, folder):
    return ranking.safest_first_table(scored(spark, folder))


@register(
    "w7_topk_capture",
    f"""WITH r AS (SELECT label, row_number() OVER (ORDER BY p DESC, id) AS rn, count(*) OVER () AS n,
                         sum(label) OVER () AS positives FROM ({SCORED})),
        k AS (SELECT unnest([0.01, 0.05, 0.10, 0.20])::DOUBLE AS fraction),
        m AS (SELECT fraction, CAST(greatest(1, round_even(fraction * n, 0)) AS BIGINT) AS m
              FROM k, (SELECT count(*) AS n FROM r))
        SELECT fraction, m, CAST(sum(label) AS BIGINT) AS captured, sum(label) / min(positives) AS capture_rate,
               sum(label) / m AS bad_rate FROM r, m WHERE rn <= m GROUP BY fraction, m""",
    "fraction~ m captured capture_rate~ bad_rate~",
)
def _(spark, folder):
    return ranking.topk_capture(scored(spark, folder))


CONFUSION = """SELECT CAST(count(*) FILTER (p < 0.5 AND label = 0) AS BIGINT) AS tn,
  CAST(count(*) FILTER (p >= 0.5 AND label = 0) AS BIGINT) AS fp, CAST(count(*) FILTER (p < 0.5 AND label = 1) AS BIGINT) AS fn,
  CAST(count(*) FILTER (p >= 0.5 AND label = 1) AS BIGINT) AS tp"""


@register("e1_confusion", f"{CONFUSION} FROM ({SCORED})")
def _(spark, folder):
    return ev.confusion(scored(spark, folder), 0.5)


@register(
    "e1_confusion_shares",
    f"""WITH c AS ({CONFUSION} FROM ({SCORED}))
        SELECT 0 AS actual, 0 AS predicted, tn AS n, tn / (tn + fp + 1e-12) AS share FROM c
        UNION ALL SELECT 0, 1, fp, fp / (tn + fp + 1e-12) FROM c UNION ALL SELECT 1, 0, fn, fn / (fn + tp + 1e-12) FROM c
        UNION ALL SELECT 1, 1, tp, tp / (fn + tp + 1e-12) FROM c""",
    "actual predicted n share~",
)
def _(spark, folder):
    return ev.confusion_shares(scored(spark, folder), 0.5)


@register(
    "e2_binary_metrics",
    f"""WITH s AS ({STRATIFIED}),
        g AS (SELECT split, p, count(*) AS n, sum(label) AS pos FROM s GROUP BY split, p),
        c AS (SELECT *, sum(n) OVER w AS run_n, sum(pos) OVER w AS run_pos,
                     sum(pos) OVER (PARTITION BY split) AS positives, sum(n - pos) OVER (PARTITION BY split) AS negatives
              FROM g WINDOW w AS (PARTITION BY split ORDER BY p DESC)),
        k AS (SELECT split, sum((n - pos) * (run_pos - pos / 2.0)) / (min(positives) * min(negatives)) AS auc,
                     sum(pos * (run_pos / run_n)) / min(positives) AS average_precision,
                     greatest(max(run_pos / positives - (run_n - run_pos) / negatives), 0.0) AS ks FROM c GROUP BY split),
        f AS (SELECT split, count(*) AS n, avg(label) AS positive_rate,
                     -avg(CASE WHEN label = 1 THEN ln(greatest(least(p, 1 - 1e-12), 1e-12))
                               ELSE ln(1 - greatest(least(p, 1 - 1e-12), 1e-12)) END) AS log_loss,
                     avg((p - label) * (p - label)) AS brier,
                     CAST(count(*) FILTER (p >= 0.5 AND label = 1) AS BIGINT) AS tp,
                     CAST(count(*) FILTER (p >= 0.5 AND label = 0) AS BIGINT) AS fp,
                     CAST(count(*) FILTER (p < 0.5 AND label = 0) AS BIGINT) AS tn,
                     CAST(count(*) FILTER (p < 0.5 AND label = 1) AS BIGINT) AS fn FROM s GROUP BY split),
        x AS (SELECT *, tp / (tp + fp + 1e-12) AS precision, tp / (tp + fn + 1e-12) AS recall FROM f JOIN k USING (split))
        SELECT split, n, positive_rate, auc, average_precision, log_loss, brier, ks, tp, fp, tn, fn,
               (tp + tn) / (n + 1e-12) AS accuracy, precision, recall,
               2 * precision * recall / (precision + recall + 1e-12) AS f1 FROM x""",
    "split n positive_rate~ auc~ average_precision~ log_loss~ brier~ ks~ tp fp tn fn accuracy~ precision~ recall~ f1~",
)
def _(spark, folder):
    return ev.binary_metrics(scored_split(spark, folder), 0.5)


@register(
    "e3_classification_report",
    f"""WITH c AS ({CONFUSION} FROM ({SCORED})),
        v AS (SELECT tn, fp, fn, tp, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1,
                     tn + fp AS s0, fn + tp AS s1 FROM c),
        f AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1, s0 + s1 AS s, (tn + tp) / (s0 + s1) AS acc FROM v)
        SELECT '0' AS "class", p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
        UNION ALL SELECT '1', p1, r1, f1, s1 FROM f UNION ALL SELECT 'accuracy', acc, acc, acc, s FROM f
        UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s FROM f
        UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / s, (r0 * s0 + r1 * s1) / s, (f0 * s0 + f1 * s1) / s, s FROM f""",
    "class precision~ recall~ f1~ support",
    digits=4,
)
def _(spark, folder):
    return ev.classification_report(scored(spark, folder), 0.5)


@register(
    "e4_roc_points", f"{POINTS} SELECT threshold, fp / negatives AS fpr, tp / positives AS tpr FROM c", "threshold~ fpr~ tpr~"
)
def _(spark, folder):
    return ev.roc_points(scored(spark, folder))


AUC = "sum((n - pos) * (tp - pos / 2.0)) / (min(positives) * CAST(min(negatives) AS DOUBLE))"


@register("e4_auc", f"{POINTS} SELECT {AUC} AS auc, 2 * {AUC} - 1 AS gini FROM c", "auc~ gini~")
def _(spark, folder):
    return ev.auc(scored(spark, folder))


@register(
    "e5_pr_points", f"{POINTS} SELECT threshold, tp / run_n AS precision, tp / positives AS recall FROM c", "threshold~ precision~ recall~"
)
def _(spark, folder):
    return ev.pr_points(scored(spark, folder))


@register(
    "e5_average_precision",
    f"{POINTS} SELECT sum(pos * (tp / run_n)) / min(positives) AS average_precision FROM c",
    "average_precision~",
)
def _(spark, folder):
    return ev.average_precision(scored(spark, folder))


@register(
    "e6_log_loss",
    f"SELECT -avg(CASE WHEN label = 1 THEN ln(greatest(p, 1e-12)) ELSE ln(1 - least(p, 1 - 1e-12)) END) AS log_loss FROM ({SCORED})",
    "log_loss~",
)
def _(spark, folder):
    return ev.log_loss(scored(spark, folder))


@register("e7_brier", f"SELECT avg((p - label) * (p - label)) AS brier FROM ({SCORED})", "brier~")
def _(spark, folder):
    return ev.brier(scored(spark, folder))


@register(
    "e8_ks_roc",
    f"""{POINTS} SELECT tp / positives - fp / negatives AS ks, least(greatest(threshold, 0.0), 1.0) AS ks_threshold
        FROM c ORDER BY tp / positives - fp / negatives DESC, threshold DESC LIMIT 1""",
    "ks~ ks_threshold~",
)
def _(spark, folder):
    return ev.ks_roc(scored(spark, folder))


KS_CDF = f"""
  WITH g AS (SELECT p AS score, count(*) AS n, sum(label) AS pos FROM ({TIED}) GROUP BY p),
  k AS (SELECT score, sum(pos) OVER w / sum(pos) OVER () AS cdf_bad, sum(n - pos) OVER w / sum(n - pos) OVER () AS cdf_good
        FROM g WINDOW w AS (ORDER BY score))
  SELECT score, cdf_bad, cdf_good, abs(cdf_bad - cdf_good) AS gap FROM k"""


@register("e9_ks_cdf_curve", KS_CDF, "score~ cdf_bad~ cdf_good~ gap~")
def _(spark, folder):
    return ev.ks_cdf_curve(_tied(spark, folder))


@register(
    "e9_ks_cdf", f"SELECT gap AS ks, score AS ks_score FROM ({KS_CDF}) ORDER BY gap DESC, score LIMIT 1", "ks~ ks_score~"
)
def _(spark, folder):
    return ev.ks_cdf(_tied(spark, folder))


def _edges(source: str) -> str:
    return "SELECT DISTINCT unnest([" + ", ".join(f"quantile_cont(p, {i / 10})" for i in range(1, 10)) + f"]) AS e FROM {source}"


BINNED = f"""
  WITH s AS ({SCORED}), q AS ({_edges('s')}), l AS (SELECT list(e) AS es FROM q),
  b AS (SELECT s.*, CAST(1 + len(list_filter(es, lambda e: e < p)) AS INTEGER) AS bin FROM s, l)"""


@register(
    "e10_ece",
    f"""{BINNED}, t AS (SELECT count(*) AS n, avg(p) AS conf, avg(label) AS acc FROM b GROUP BY bin)
        SELECT sum(n * abs(acc - conf)) / sum(n) AS ece FROM t""",
    "ece~",
)
def _(spark, folder):
    return ev.ece(scored(spark, folder))


@register(
    "e10_ece_uniform",
    f"""WITH t AS (SELECT count(*) AS n, avg(p) AS conf, avg(label) AS acc FROM ({SCORED}) WHERE p > 0 AND p <= 1
                   GROUP BY ceil(p * 10)) SELECT sum(n * abs(acc - conf)) / (SELECT count(*) FROM orders) AS ece FROM t""",
    "ece~",
)
def _(spark, folder):
    return ev.ece(scored(spark, folder), strategy="uniform")


@register(
    "e11_calibration_table",
    f"{BINNED} SELECT bin, count(*) AS n, avg(p) AS mean_p, avg(label) AS observed FROM b GROUP BY bin",
    "bin n mean_p~ observed~",
)
def _(spark, folder):
    return ev.calibration_table(scored(spark, folder))


PSI = f"""
  WITH s AS ({STRATIFIED}), q AS ({_edges("(SELECT p FROM s WHERE split = 'train')")}), l AS (SELECT list(e) AS es FROM q),
  b AS (SELECT split, CAST(1 + len(list_filter(es, lambda e: e < p)) AS INTEGER) AS bin FROM s, l WHERE split IN ('train', 'test')),
  n AS (SELECT count(*) FILTER (split = 'train') AS ne, count(*) FILTER (split = 'test') AS na FROM b),
  h AS (SELECT bin, count(*) FILTER (split = 'train') / min(ne) + 1e-12 AS e, count(*) FILTER (split = 'test') / min(na) + 1e-12 AS a
        FROM b, n GROUP BY bin)
  SELECT bin, e AS expected_share, a AS actual_share, (a - e) * ln(a / e) AS term FROM h"""


@register("e12_psi_table", PSI, "bin expected_share~ actual_share~ term~")
def _(spark, folder):
    return ev.psi_table(scored_split(spark, folder), "split", "train", "test")


@register(
    "e12_psi",
    f"""SELECT sum(term) AS psi, CASE WHEN sum(term) < 0.10 THEN 'stable' WHEN sum(term) <= 0.25 THEN 'watch' ELSE 'drift' END AS reading
        FROM ({PSI})""",
    "psi~ reading",
)
def _(spark, folder):
    return ev.psi(scored_split(spark, folder), "split", "train", "test")


CAP = f"""
  SELECT id, row_number() OVER w / count(*) OVER () AS x, sum(label) OVER w / sum(label) OVER () AS y
  FROM ({TIED}) WINDOW w AS (ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING)"""


@register("e13_cap_curve", CAP, "id x~ y~")
def _(spark, folder):
    return ev.cap_curve(_tied(spark, folder))


@register(
    "e13_accuracy_ratio",
    f"""WITH c AS (SELECT x, y, lag(x) OVER (ORDER BY x) AS px, lag(y) OVER (ORDER BY x) AS py FROM ({CAP})),
        a AS (SELECT sum((x - px) * (y + py) / 2) AS area FROM c), b AS (SELECT avg(label) AS base FROM ({SCORED}))
        SELECT area AS cap_area, (area - 0.5) / (0.5 - base / 2 + 1e-12) AS accuracy_ratio FROM a, b""",
    "cap_area~ accuracy_ratio~",
)
def _(spark, folder):
    return ev.accuracy_ratio(_tied(spark, folder))


@register(
    "e13_perfect_cap",
    f"""SELECT i / 299.0::DOUBLE AS x, least(i / 299.0::DOUBLE / (base + 1e-12), 1.0) AS y
        FROM (SELECT avg(label) AS base FROM ({SCORED})), (SELECT unnest(range(300)) AS i)""",
    "x~ y~",
)
def _(spark, folder):
    return ev.perfect_cap(scored(spark, folder))


F1 = f"""
  WITH s AS ({SCORED}), t AS (SELECT unnest(range(1, 100)) / 100.0::DOUBLE AS threshold),
  c AS (SELECT threshold, count(*) FILTER (p >= threshold) AS flagged, count(*) FILTER (p >= threshold AND label = 1) AS tp,
               sum(label) AS positives FROM s, t GROUP BY threshold),
  r AS (SELECT threshold, tp / (flagged + 1e-12) AS pr, tp / (positives + 1e-12) AS rc FROM c)
  SELECT threshold, 2 * pr * rc / (pr + rc + 1e-12) AS f1 FROM r"""


@register("e14_f1_by_threshold", F1, "threshold~ f1~")
def _(spark, folder):
    return ev.f1_by_threshold(scored(spark, folder))


@register(
    "e14_choose_threshold",
    f"""{POINTS}, f AS ({F1})
        SELECT 'fixed' AS mode, CAST(0.35 AS DOUBLE) AS threshold UNION ALL SELECT 'cost', 1.0 / 6.0
        UNION ALL SELECT 'reject_rate', quantile_cont(p, 0.8) FROM s
        UNION ALL (SELECT 'f1', threshold FROM f ORDER BY round(f1, 12) DESC, threshold LIMIT 1)
        UNION ALL (SELECT 'ks', threshold FROM c ORDER BY abs(tp / positives - fp / negatives) DESC, threshold DESC LIMIT 1)""",
    "mode threshold~",
)
def _(spark, folder):
    df = scored(spark, folder)
    asked = [("fixed", {"value": 0.35}), ("cost", {"fp_cost": 1.0, "fn_cost": 5.0}), ("reject_rate", {"value": 0.2}), ("f1", {}), ("ks", {})]
    rows = [(mode, ev.choose_threshold(df, mode, **more)) for mode, more in asked]
    return spark.createDataFrame(rows, "mode string, threshold double")


@register(
    "e15_regression_metrics",
    """WITH l AS (SELECT l_extendedprice / 1000 AS y, l_quantity * 1.5 AS g FROM lineitem)
       SELECT avg(abs(y - g)) AS mae, 1 - sum((y - g) * (y - g)) / (var_pop(y) * count(*)) AS r2 FROM l""",
    "mae~ r2~",
)
def _(spark, folder):
    df = line_regression(spark, folder).select("y", (F.col("q") * 75).alias("g"))
    return ev.regression_metrics(df, "y", "g")


@register("e16_accuracy", f"SELECT avg(CAST((p >= 0.5) = (label = 1) AS INTEGER)) AS accuracy FROM ({SCORED})", "accuracy~")
def _(spark, folder):
    return ev.accuracy(scored(spark, folder).select("label", (F.col("p") >= 0.5).cast("int").alias("said")), "said")


@register("e17_decisions", f"SELECT id, p, CAST(p >= 0.5 AS INTEGER) AS reject FROM ({SCORED})", "id p~ reject")
def _(spark, folder):
    return ev.decisions(scored(spark, folder), 0.5)


@register("e18_cumulative_capture", f"SELECT decile, capture FROM ({GAINS})", "decile capture~")
def _(spark, folder):
    return ev.cumulative_capture(ranking.gains_table(scored(spark, folder)))
