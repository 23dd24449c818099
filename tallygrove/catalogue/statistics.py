"""Statistics (A), panels (W1-W3, J2), splits and fitted preprocessing (F, J4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrove.catalogue.registry import PANEL, RETURNS, SCORED, STRATIFIED, hash_sql, register
from tallygrove.operators.cleaning import align_by_id
from tallygrove.operators.dictionary import CategoryDictionary
from tallygrove.operators import order_stats, panel, preprocessing as prep, splits, statistics as st
from tallygrove.plans.fixtures import price_panel, scored, scored_split, table
from tallygrove.session import shared_folder

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _line(spark, folder):
    return table(spark, folder, "lineitem")


def _stack(template: str, cols=COLS) -> str:
    """One SELECT per column, {c} standing for its name."""
    return " UNION ALL ".join(template.format(c=c) for c in cols)


def _pairs(value: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {value.format(a=a, b=b)} AS value FROM lineitem" for a in COLS for b in COLS
    )


@register("a1_label_distribution", f"SELECT label, count(*) AS n FROM ({SCORED}) GROUP BY label ORDER BY label")
def _(spark, folder):
    return st.label_distribution(scored(spark, folder))


@register(
    "a2_class_balance",
    f"""SELECT split, count(*) AS n, CAST(sum(label) AS BIGINT) AS ones, CAST(sum(1 - label) AS BIGINT) AS zeros,
        avg(label) AS positive_rate, count(DISTINCT label) AS labels FROM ({STRATIFIED}) GROUP BY split""",
    "split n ones zeros positive_rate~ labels",
)
def _(spark, folder):
    return st.class_balance(scored_split(spark, folder))


@register("a3_distinct_values", "SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1")
def _(spark, folder):
    return st.distinct_values(table(spark, folder, "customer"), "c_mktsegment")


@register(
    "a4_binary_like",
    """SELECT 'l_tax' AS "column", bool_and(l_tax IN (0, 1)) AS is_binary FROM lineitem
       UNION ALL SELECT 'returned', true UNION ALL SELECT 'l_linenumber', bool_and(l_linenumber IN (0, 1)) FROM lineitem
       UNION ALL SELECT 'declared', true""",
)
def _(spark, folder):
    returned = F.when(F.col("l_linenumber") != 3, (F.col("l_returnflag") == "R").cast("int"))
    df = _line(spark, folder).withColumns({"returned": returned, "declared": F.col("l_quantity")})
    return st.binary_like(df, ["l_tax", "returned", "l_linenumber", "declared"], ["declared"])


PROBS = [0.001, 0.25, 0.5, 0.75, 0.999]


@register(
    "a5_quantiles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS prob, quantile_cont({c}, {p}) AS value FROM lineitem"
        for c in COLS
        for p in PROBS
    ),
    "column prob~ value~",
)
def _(spark, folder):
    return order_stats.quantiles(_line(spark, folder), COLS, PROBS)


@register(
    "a6_moments",
    _stack(
        """SELECT '{c}' AS "column", count({c}) AS n, avg({c}) AS mean, var_pop({c}) AS var_pop, stddev_pop({c}) AS std_pop FROM lineitem"""
    ),
    "column n mean~ var_pop~ std_pop~",
    digits=4,
)
def _(spark, folder):
    return st.moments(_line(spark, folder), COLS)


@register("a7_covariance_matrix", _pairs("covar_samp({a}, {b})"), "col_a col_b value~", digits=4)
def _(spark, folder):
    return st.covariance_matrix(_line(spark, folder), COLS)


@register(
    "a8_correlation_matrix",
    _pairs("corr({a}, {b})")
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', 'constant', NULL" for c in COLS)
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT 'constant', '{c}', NULL" for c in [*COLS, "constant"]),
    "col_a col_b value~",
)
def _(spark, folder):
    return st.correlation_matrix(_line(spark, folder).withColumn("constant", F.lit(1.0)), [*COLS, "constant"])


@register(
    "a9_high_corr_pairs",
    """WITH f AS (SELECT l_quantity, l_extendedprice, l_quantity * 2 + l_tax AS twice, -l_quantity AS neg FROM lineitem),
       c AS (SELECT 'l_quantity' AS col_a, 'l_extendedprice' AS col_b, corr(l_quantity, l_extendedprice) AS value FROM f
       UNION ALL SELECT 'l_quantity', 'twice', corr(l_quantity, twice) FROM f
       UNION ALL SELECT 'l_quantity', 'neg', corr(l_quantity, neg) FROM f
       UNION ALL SELECT 'l_extendedprice', 'twice', corr(l_extendedprice, twice) FROM f
       UNION ALL SELECT 'l_extendedprice', 'neg', corr(l_extendedprice, neg) FROM f
       UNION ALL SELECT 'twice', 'neg', corr(twice, neg) FROM f)
       SELECT * FROM c WHERE abs(value) >= 0.75 ORDER BY value DESC LIMIT 50""",
    "col_a col_b value~",
)
def _(spark, folder):
    df = _line(spark, folder).select(
        "l_quantity", "l_extendedprice", (F.col("l_quantity") * 2 + F.col("l_tax")).alias("twice"), (-F.col("l_quantity")).alias("neg")
    )
    return st.high_corr_pairs(st.correlation_matrix(df, df.columns), df.columns)


@register(
    "a10_near_constant_columns",
    """SELECT 'constant' AS "column", CAST(1.0 AS DOUBLE) AS top_share UNION ALL
       SELECT 'rare', (SELECT max(n) / (SELECT count(*) FROM lineitem) FROM
         (SELECT count(*) AS n FROM lineitem GROUP BY (l_linenumber = 1 AND l_quantity = 1 AND l_discount = 0)))
       UNION ALL SELECT 'absent', CAST(1.0 AS DOUBLE)""",
    "column top_share~",
)
def _(spark, folder):
    rare = (F.col("l_linenumber") == 1) & (F.col("l_quantity") == 1) & (F.col("l_discount") == 0)
    df = _line(spark, folder).withColumns(
        {"constant": F.lit(3), "rare": rare.cast("int"), "absent": F.lit(None).cast("double")}
    )
    return st.near_constant_columns(df, [*COLS, "constant", "rare", "absent"], 0.999)


@register(
    "a11_describe",
    _stack(
        """SELECT '{c}' AS "column", count({c}) AS "count", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
        quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM lineitem"""
    ),
    "column count mean~ std~ min~ q25~ q50~ q75~ max~",
    digits=4,
)
def _(spark, folder):
    return st.describe(_line(spark, folder), COLS)


@register(
    "a11_info",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null, count(*) AS n_rows FROM customer"
        for c, t in [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")]
    ),
)
def _(spark, folder):
    return st.info(table(spark, folder, "customer"))


@register(
    "a12_missing_counts",
    """SELECT 'c_custkey' AS "column", CAST(0 AS BIGINT) AS missing UNION ALL
       SELECT 'c_acctbal', CAST(count(*) FILTER (c_acctbal <= 0) AS BIGINT) FROM customer""",
)
def _(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"))
    return st.missing_counts(df)


@register(
    "a13_scaling_check",
    " UNION ALL ".join(
        f"""SELECT 'mean' AS measure, '{c}' AS "column", abs(avg(({c} - 0.5) / 2)) AS off FROM lineitem
            UNION ALL SELECT 'std', '{c}', abs(stddev_pop(({c} - 0.5) / 2) - 1) FROM lineitem"""
        for c in COLS
    ),
    "measure column off~",
    digits=4,
)
def _(spark, folder):
    df = _line(spark, folder).select(*[((F.col(c) - 0.5) / 2).alias(c) for c in COLS])
    return st.scaling_check(df, COLS)


@register(
    "a13_scaling_summary",
    f"""SELECT avg(abs(m)) AS mean_abs_mean, avg(s) AS mean_std FROM ({_stack('SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM lineitem')})""",
    "mean_abs_mean~ mean_std~",
    digits=4,
)
def _(spark, folder):
    return st.scaling_summary(_line(spark, folder), COLS)


HISTOGRAM = """
  WITH s AS ({source}), r AS (SELECT {key} min(p) AS lo, (max(p) - min(p)) / 40 AS w FROM s {group}),
  b AS (SELECT {skey} CAST(least(floor((p - lo) / w), 39) AS INTEGER) AS bin, lo, w FROM s JOIN r ON {on})
  SELECT {key} bin, min(lo + bin * w) AS bin_start, count(*) AS n FROM b GROUP BY {key} bin"""


@register(
    "a14_histogram", HISTOGRAM.format(source=SCORED, key="", skey="", group="", on="true"), "bin bin_start~ n"
)
def _(spark, folder):
    return st.histogram(scored(spark, folder), "p")


@register(
    "a14_histogram_by_label",
    HISTOGRAM.format(source=SCORED, key="label, ", skey="s.label, ", group="GROUP BY label", on="s.label = r.label"),
    "label bin bin_start~ n",
)
def _(spark, folder):
    return st.histogram(scored(spark, folder), "p", by="label")


# ------------------------------------------------------------------ panels


@register("w1_pct_change", RETURNS, "month ticker ret~")
def _(spark, folder):
    return panel.pct_change(price_panel(spark, folder), "ticker", "month", "price")


@register(
    "w1_forward_fill",
    f"""SELECT month, ticker, coalesce(price, last_value(price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY month)) AS price
        FROM (SELECT month, ticker, CASE WHEN month(month) NOT IN (1, 2, 7) THEN price END AS price FROM ({PANEL}))""",
    "month ticker price~",
)
def _(spark, folder):
    gaps = F.when(~F.month("month").isin(1, 2, 7), F.col("price"))
    return panel.forward_fill(price_panel(spark, folder).withColumn("price", gaps), "ticker", "month", "price").select(
        "month", "ticker", "price"
    )


@register(
    "w2_tail_dates",
    f"SELECT * FROM ({PANEL}) WHERE month IN (SELECT DISTINCT month FROM ({PANEL}) ORDER BY month DESC LIMIT 40)",
    "month ticker price~",
)
def _(spark, folder):
    return panel.tail_dates(price_panel(spark, folder), "month", 40)


@register("w3_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def _(spark, folder):
    return st.head(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), 100, ["o_orderkey"])


ALIGNED = f"""SELECT * FROM ({RETURNS}) WHERE month IN (SELECT month FROM ({RETURNS}) GROUP BY month
  HAVING count(*) = (SELECT count(DISTINCT ticker) FROM ({RETURNS})))"""


@register("j2_date_align", ALIGNED, "month ticker ret~")
def _(spark, folder):
    returns = panel.pct_change(price_panel(spark, folder), "ticker", "month", "price")
    return panel.date_align(returns, "ticker", "month", "ret")


# ------------------------------------------------------------------ splits


def _ranked(cut: str) -> str:
    return f"""WITH s AS ({SCORED}), r AS (SELECT s.*, count(*) OVER () AS n,
        row_number() OVER (ORDER BY {hash_sql('id', 42)}, id) AS rn FROM s) SELECT id, {cut} AS split FROM r"""


@register("f1_split_random", _ranked("CASE WHEN rn <= ceil(0.1 * n) THEN 'test' ELSE 'train' END"))
def _(spark, folder):
    return splits.split_random(scored(spark, folder), 0.1, 42).select("id", "split")


@register(
    "f2_split_exact",
    _ranked("CASE WHEN rn <= 900 THEN 'train' WHEN rn <= 1208 THEN 'test' ELSE 'validation' END"),
)
def _(spark, folder):
    return splits.split_exact(scored(spark, folder), 900, 308, 42).select("id", "split")


@register("f3_split_stratified", STRATIFIED, "id label p~ split")
def _(spark, folder):
    return scored_split(spark, folder)


@register("f11_shuffle_rows", f"SELECT id, label, p FROM ({SCORED}) ORDER BY {hash_sql('id', 42)}, id", "id label p~")
def _(spark, folder):
    return splits.shuffle_rows(scored(spark, folder), 42)


# ------------------------------------------------------------------ fitted preprocessing

BOUNDS = f"""
  WITH s AS ({STRATIFIED}),
  b AS (SELECT quantile_cont(p, 0.01) AS lo, quantile_cont(p, 0.99) AS hi FROM s WHERE split = 'train')"""


@register("f4_winsorizer", f"{BOUNDS} SELECT id, split, least(greatest(p, lo), hi) AS p FROM s, b", "id split p~")
def _(spark, folder):
    df = scored_split(spark, folder)
    model = prep.Winsorizer(["p"], 0.01, 0.99).fit(df.where("split = 'train'"))
    return model.transform(df).select("id", "split", "p")


SCALE = f"""
  WITH s AS ({STRATIFIED}), b AS (SELECT avg(p) AS m, stddev_pop(p) AS sd FROM s WHERE split = 'train')"""


@register(
    "f5_standard_scale",
    f"{SCALE} SELECT id, split, (p - m) / sd AS p, CAST(0.0 AS DOUBLE) AS constant FROM s, b",
    "id split p~ constant~",
)
def _(spark, folder):
    df = scored_split(spark, folder).withColumn("constant", F.lit(4.0))
    model = prep.StandardScale(["p", "constant"]).fit(df.where("split = 'train'"))
    return model.transform(df).select("id", "split", "p", "constant")


@register("f6_standardize_train_only", f"{SCALE} SELECT id, split, (p - m) / (sd + 1e-12) AS p FROM s, b", "id split p~")
def _(spark, folder):
    df = scored_split(spark, folder)
    return prep.standardize_train_only(["p"]).fit(df.where("split = 'train'")).transform(df).select("id", "split", "p")


@register("j4_broadcast_stats", f"{SCALE} SELECT id, split, p - m AS off_mean FROM s, b", "id split off_mean~")
def _(spark, folder):
    df = scored_split(spark, folder)
    return prep.with_statistics(df, df.where("split = 'train'"), ["p"]).select(
        "id", "split", (F.col("p") - F.col("p_mean")).alias("off_mean")
    )


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _segment(spark, folder):
    """Customers with one segment missing, and the debtors as training rows (one segment unseen)."""
    df = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("seg"),
        "c_acctbal",
    )
    return df, df.where((F.col("c_acctbal") > 0) & (F.coalesce("seg", F.lit("")) != "MACHINERY"))


@register(
    "f7_one_hot",
    """SELECT c_custkey AS id, """
    + ", ".join(
        f"CAST({'c_mktsegment = ' + repr(s)} AS INTEGER) AS \"seg_{'nan' if s == 'BUILDING' else s}\""
        for s in SEGMENTS
        if s != "MACHINERY"
    )
    + " FROM customer",
)
def _(spark, folder):
    df, train = _segment(spark, folder)
    return prep.OneHot(["seg"]).fit(train).transform(df.select("id", "seg"))


@register(
    "f8_one_hot_fixed",
    "SELECT c_custkey AS id, "
    + ", ".join(f"CAST(c_mktsegment = '{s}' AS INTEGER) AS \"c_mktsegment_{s}\"" for s in SEGMENTS)
    + " FROM customer",
)
def _(spark, folder):
    df = table(spark, folder, "customer")
    seen = [r[0] for r in st.distinct_values(df, "c_mktsegment").collect()]  # a handful of categories
    return prep.one_hot_fixed({"c_mktsegment": seen}).transform(df.select(F.col("c_custkey").alias("id"), "c_mktsegment"))


# every line's part and supplier, some 100,000 of them at scale 0.1, and its order as a category of as many values as orders
CATEGORIES = """
  WITH s AS (SELECT l_orderkey AS id, l_linenumber AS line, CAST(l_orderkey AS VARCHAR) AS o, l_partkey || '/' || l_suppkey AS ps FROM lineitem),
  t AS (SELECT * FROM s WHERE id % 5 <> 0),
  a AS (SELECT o, row_number() OVER (ORDER BY o) - 1 AS slot FROM (SELECT DISTINCT o FROM t)),
  b AS (SELECT ps, row_number() OVER (ORDER BY ps) - 1 AS slot FROM (SELECT DISTINCT ps FROM t))
  SELECT id, line, CAST(a.slot AS INTEGER) AS o_slot, CAST(b.slot AS INTEGER) AS ps_slot
  FROM s LEFT JOIN a USING (o) LEFT JOIN b USING (ps)"""


@register("f7_dictionary", CATEGORIES, "id line o_slot ps_slot")
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").cast("string").alias("o"),
        F.concat_ws("/", "l_partkey", "l_suppkey").alias("ps"),
    )
    found = CategoryDictionary.fit(lines.where("id % 5 <> 0"), ["o", "ps"])
    return found.index(lines).drop("o", "ps")


@register(
    "f9_preprocess",
    f"""WITH s AS (SELECT t.id, t.label, t.split, o_totalprice AS price, substr(o_orderpriority, 1, 1) AS prio
                   FROM ({STRATIFIED}) t JOIN orders ON t.id = o_orderkey),
        b AS (SELECT quantile_cont(price, 0.001) AS lo, quantile_cont(price, 0.999) AS hi FROM s WHERE split = 'train'),
        c AS (SELECT s.*, least(greatest(price, lo), hi) AS x FROM s, b),
        m AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM c WHERE split = 'train')
        SELECT id, label, split, (x - m) / sd AS price, """
    + ", ".join(f"CAST(prio = '{i}' AS INTEGER) AS prio_{i}" for i in range(1, 6))
    + " FROM c, m",
    "id label split price~ prio_1 prio_2 prio_3 prio_4 prio_5",
)
def _(spark, folder):
    extra = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.substring("o_orderpriority", 1, 1).alias("prio"),
        F.lit(2.0).alias("constant"), F.lit("x").alias("term"),
    )
    shared_folder(spark)
    # every fit below reads the rows again: the join is written once
    df = align_by_id(scored_split(spark, folder).drop("p"), extra).checkpoint()
    return prep.Preprocess(["price", "constant"], ["prio"]).fit(df.where("split = 'train'")).transform(df)


@register(
    "f10_drop_near_constant",
    f"SELECT id, split, p FROM ({STRATIFIED})",
    "id split p~",
)
def _(spark, folder):
    df = scored_split(spark, folder).select("id", "split", "p", F.lit(1.0).alias("constant"), (F.col("p") < 0).cast("int").alias("never"))
    model = prep.DropNearConstant(["p", "constant", "never"]).fit(df.where("split = 'train'"))
    return model.transform(df)
