"""Sources, projections and scalar functions (S, P) and alignment (J1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrove.catalogue.registry import SCORED, register
from tallygrove.functions import scalars as fx
from tallygrove.operators import cleaning as ops
from tallygrove.operators.evaluation import decisions
from tallygrove.plans.fixtures import scored, table
from tallygrove.session import fresh_path
from tallygrove.sources import pages as pg
from tallygrove.sources import tables as src

TOKENS = {"5-LOW": "NA", "2-HIGH": "--"}
WITH_TOKENS = """CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '2-HIGH' THEN NULL ELSE o_orderpriority END"""
ROUND_TRIP = f"""SELECT o_orderkey, o_totalprice, {WITH_TOKENS} AS priority FROM orders"""
ROUND_TRIP_SCHEMA = "o_orderkey bigint, o_totalprice double, priority string"


def _orders_with_tokens(spark, folder):
    marked = F.when(F.col("o_orderpriority") == "5-LOW", "NA").when(F.col("o_orderpriority") == "2-HIGH", "--")
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", F.coalesce(marked, "o_orderpriority").alias("priority")
    )


@register("s1_read_csv", ROUND_TRIP)
def _(spark, folder):
    path = fresh_path(spark, "orders.csv")
    src.write_table(_orders_with_tokens(spark, folder), path, "csv")
    return src.read_table(spark, path, "csv", ROUND_TRIP_SCHEMA, ("NA", "--"))


@register("s2_read_json", ROUND_TRIP)
def _(spark, folder):
    path = fresh_path(spark, "orders") + ".json"
    src.write_table(_orders_with_tokens(spark, folder), path, "json")
    return src.read_table(spark, path, None, ROUND_TRIP_SCHEMA, ("NA", "--"))


@register("s3_read_parquet", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, folder):
    return src.read_table(spark, f"{folder}/customer.parquet")


@register("s4_null_if_token", ROUND_TRIP)
def _(spark, folder):
    return src.null_if_token(_orders_with_tokens(spark, folder), ["NA", "--"])


@register("s5_select_numeric", "SELECT p_partkey, p_size, p_retailprice FROM part")
def _(spark, folder):
    return src.select_numeric(table(spark, folder, "part"))


@register(
    "s6_split_xy",
    "SELECT CAST(1.0 AS DOUBLE) AS intercept, l_quantity, l_discount, l_tax, l_extendedprice AS target FROM lineitem",
)
def _(spark, folder):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return src.split_xy(table(spark, folder, "lineitem").select(*cols), "l_extendedprice")[0]


@register(
    "s7_matrix_from_table",
    """SELECT p_partkey AS row_idx, 0 AS col_idx, CAST(p_size AS DOUBLE) AS value FROM part
       UNION ALL SELECT p_partkey, 1, p_retailprice FROM part""",
)
def _(spark, folder):
    return src.matrix_from_table(table(spark, folder, "part"), "p_partkey")


# advertisements of every second page get a further class, every fifth an attribute that only ends in "class"
CLASSED = """replace(html, '<div class="ad">', CASE WHEN page_id % 5 = 0 THEN '<div data-class="ad">'
    WHEN page_id % 2 = 0 THEN '<div class="wide ad  top">' ELSE '<div class="ad">' END)"""


@register(
    "s8_extract_tag_text",
    f"""WITH d AS (SELECT page_id, regexp_extract_all({CLASSED}, '<div ([^>]*)>.*?</div>', 1, 's') AS heads,
                 regexp_extract_all({CLASSED}, '<div [^>]*>(.*?)</div>', 1, 's') AS raws FROM pages),
       u AS (SELECT page_id, generate_subscripts(raws, 1) AS k, unnest(heads) AS head, unnest(raws) AS raw FROM d WHERE len(raws) > 0),
       e AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS position, raw FROM u
             WHERE (head LIKE 'class=%' OR head LIKE '% class=%')
               AND list_contains(string_split_regex(regexp_extract(head, '(^| )class="([^"]*)"', 2), '\\s+'), 'ad'))
       SELECT page_id, CAST(position AS INTEGER) AS position,
              nullif(regexp_replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '^\\s+|\\s+$', '', 'g'), '') AS text,
              CASE WHEN regexp_replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '^\\s+|\\s+$', '', 'g') = '' THEN 'empty' ELSE 'ok' END AS status FROM e
       UNION ALL SELECT page_id, NULL, NULL, 'missing' FROM pages WHERE page_id NOT IN (SELECT page_id FROM e)""",
)
def _(spark, folder):
    pages = table(spark, folder, "pages").withColumn("html", F.expr(CLASSED))
    return pg.extract_tag_text(pages, "html", "div", "ad")


@register(
    "s8_first_link",
    """WITH f AS (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1, 's') AS hits FROM pages)
       SELECT page_id, nullif(hits[1], '') AS href,
              CASE WHEN len(hits) = 0 THEN 'missing' WHEN hits[1] = '' THEN 'empty' ELSE 'ok' END AS status FROM f""",
)
def _(spark, folder):
    return pg.first_link(table(spark, folder, "pages"), "html")


@register(
    "s9_write_table", f"SELECT id, p, CAST(p >= 0.5 AS INTEGER) AS reject FROM ({SCORED})", "id p~ reject"
)
def _(spark, folder):
    path = fresh_path(spark, "decisions.parquet")
    src.write_table(decisions(scored(spark, folder), 0.5), path)
    return src.read_table(spark, path, "parquet")


# ------------------------------------------------------------------ projections and scalars

KEY = "l_orderkey, l_linenumber"


def _line(spark, folder):
    return table(spark, folder, "lineitem")


def _line_with(spark, folder, **cols):
    return _line(spark, folder).select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in cols.items()])


def _missing_when(value, cond):
    return F.when(~cond, value)


@register("p1_project", f"SELECT {KEY}, l_quantity FROM lineitem")
def _(spark, folder):
    return ops.project(_line(spark, folder), ["l_orderkey", "l_linenumber", "l_quantity"])


@register(
    "p2_parse_percent",
    f"""SELECT {KEY}, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * 100 END AS pct FROM lineitem""",
    "l_orderkey l_linenumber pct~",
)
def _(spark, folder):
    text = F.concat(F.lit(" "), (F.col("l_discount") * 100).cast("string"), F.lit("% "))
    text = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(text)
    return _line_with(spark, folder, pct=fx.parse_percent(text))


@register("p3_to_number", f"SELECT {KEY}, l_extendedprice AS price FROM lineitem", "l_orderkey l_linenumber price~")
def _(spark, folder):
    return _line_with(spark, folder, price=fx.to_number(F.col("l_extendedprice").cast("string")))


def _months():
    return F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))


MONTHS_SQL = "CASE WHEN l_returnflag <> 'N' THEN l_quantity END"


@register("p4_missing_flag", f"SELECT {KEY}, CAST(l_returnflag <> 'N' AS INTEGER) AS ever FROM lineitem")
def _(spark, folder):
    return _line_with(spark, folder, ever=fx.missing_flag(_months()))


@register(
    "p5_fill_missing",
    f"""SELECT {KEY}, coalesce({MONTHS_SQL}, 999.0) AS months,
        CASE WHEN l_linenumber = 2 THEN '0' ELSE l_returnflag END AS flag FROM lineitem""",
    "l_orderkey l_linenumber months~ flag",
)
def _(spark, folder):
    flag = F.when(F.col("l_linenumber") != 2, F.col("l_returnflag"))
    return ops.fill_missing(_line_with(spark, folder, months=_months(), flag=flag), {"months": 999, "flag": "0"})


@register(
    "p5_fill_all_zero",
    f"""SELECT {KEY}, coalesce({MONTHS_SQL}, 0.0) AS months,
        CASE WHEN l_linenumber = 2 THEN '0' ELSE l_returnflag END AS flag FROM lineitem""",
    "l_orderkey l_linenumber months~ flag",
)
def _(spark, folder):
    flag = F.when(F.col("l_linenumber") != 2, F.col("l_returnflag"))
    return ops.fill_all_zero(_line_with(spark, folder, months=_months(), flag=flag))


@register(
    "p6_fill_median",
    f"""SELECT {KEY}, coalesce(CASE WHEN l_linenumber <> 3 THEN l_extendedprice END,
          (SELECT quantile_cont(CASE WHEN l_linenumber <> 3 THEN l_extendedprice END, 0.5) FROM lineitem)) AS price
        FROM lineitem""",
    "l_orderkey l_linenumber price~",
)
def _(spark, folder):
    price = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice"))
    return ops.fill_median(_line_with(spark, folder, price=price), "price")


@register(
    "p7_recency_flag",
    f"SELECT {KEY}, CAST(l_returnflag <> 'N' AND l_quantity <= 24 AS INTEGER) AS recent FROM lineitem",
)
def _(spark, folder):
    filled = F.coalesce(_months(), F.lit(999.0))
    return _line_with(spark, folder, recent=fx.recency_flag(filled, fx.missing_flag(_months()), 24))


@register(
    "p8_recency_score",
    f"SELECT {KEY}, CASE WHEN l_returnflag <> 'N' THEN 1.0 / (1.0 + l_quantity) ELSE 0.0 END AS score FROM lineitem",
    "l_orderkey l_linenumber score~",
)
def _(spark, folder):
    filled = F.coalesce(_months(), F.lit(999.0))
    return _line_with(spark, folder, score=fx.recency_score(filled, fx.missing_flag(_months())))


@register(
    "p9_drop_missing",
    f"SELECT {KEY}, l_quantity AS months, l_tax AS tax FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber <> 4",
)
def _(spark, folder):
    tax = F.when(F.col("l_linenumber") != 4, F.col("l_tax"))
    return ops.drop_missing(_line_with(spark, folder, months=_months(), tax=tax), ["months", "tax"])


@register(
    "p10_parse_month_year",
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS four,
              CAST(try_strptime('01-' || strftime(o_orderdate, '%b-%y'), '%d-%b-%y') AS DATE) AS two
       FROM orders WHERE o_orderpriority <> '5-LOW'""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    text = F.when(F.col("o_orderpriority") == "5-LOW", "unknown").otherwise(F.date_format("o_orderdate", "MMM-yyyy"))
    dated = orders.select(
        "o_orderkey",
        fx.parse_month_year(text).alias("four"),
        fx.parse_month_year(F.date_format("o_orderdate", "MMM-yy"), "MMM-yy").alias("two"),
    )
    return ops.drop_missing(dated, ["four"])


@register(
    "p11_year_gap",
    """SELECT o_orderkey, greatest(year(o_orderdate) - year(shipped), 0)::INTEGER AS back,
              greatest(year(shipped) - year(o_orderdate), 0)::INTEGER AS ahead
       FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def _(spark, folder):
    last = _line(spark, folder).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    both = table(spark, folder, "orders").join(last, "o_orderkey")
    return both.select(
        "o_orderkey",
        fx.year_gap("o_orderdate", "shipped").alias("back"),
        fx.year_gap("shipped", "o_orderdate").alias("ahead"),
    )


@register(
    "p12_label_from_classes",
    f"""SELECT {KEY}, CAST(coalesce(CASE WHEN l_linenumber <> 5 THEN l_returnflag END IN ('A', 'R'), false) AS INTEGER)
        AS label FROM lineitem""",
)
def _(spark, folder):
    status = F.when(F.col("l_linenumber") != 5, F.col("l_returnflag"))
    return _line_with(spark, folder, label=fx.label_from_classes(status, ["A", "R"]))


@register(
    "p13_ordinal_encode",
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 WHEN 'PROMO' THEN 3 END AS level FROM part""",
)
def _(spark, folder):
    mapping = {"ECONOMY": 1, "STANDARD": 2, "PROMO": 3}
    return table(spark, folder, "part").select("p_partkey", fx.ordinal_encode("p_type", mapping).alias("level"))


@register(
    "p14_add_columns",
    f"""SELECT {KEY}, coalesce({MONTHS_SQL} + l_tax, 0.0) AS total FROM lineitem""",
    "l_orderkey l_linenumber total~",
)
def _(spark, folder):
    both = _line_with(spark, folder, a=_months(), b=F.col("l_tax"))
    return ops.fill_missing(ops.drop_columns(ops.add_columns(both, "total", ["a", "b"]), ["a", "b"]), {"total": 0})


@register(
    "p15_signed_log",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) WHEN c_acctbal < 0 THEN -ln(-c_acctbal) ELSE 0.0 END AS v
       FROM customer""",
    "c_custkey v~",
)
def _(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", fx.signed_log("c_acctbal").alias("v"))


@register(
    "p16_floor_log",
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) ELSE 0.0 END AS v FROM customer",
    "c_custkey v~",
)
def _(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", fx.floor_log("c_acctbal").alias("v"))


@register(
    "p17_clip",
    """SELECT c_custkey, least(greatest(c_acctbal, 0.0), 5000.0) AS both_sides, greatest(c_acctbal, 0.0) AS low_side
       FROM customer""",
    "c_custkey both_sides~ low_side~",
)
def _(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey",
        fx.clip("c_acctbal", 0.0, 5000.0).alias("both_sides"),
        fx.clip("c_acctbal", lo=0.0).alias("low_side"),
    )


@register(
    "p18_polynomial_features",
    f"""SELECT {KEY}, CAST(1.0 AS DOUBLE) AS x0, l_quantity / 50 AS x1, (l_quantity / 50) * (l_quantity / 50) AS x2 FROM lineitem""",
    "l_orderkey l_linenumber x0~ x1~ x2~",
)
def _(spark, folder):
    return _line(spark, folder).select("l_orderkey", "l_linenumber", *fx.polynomial(F.col("l_quantity") / 50, 2))


@register("p19_drop_columns", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, folder):
    return ops.drop_columns(table(spark, folder, "customer"), ["c_name", "c_nationkey", "not_there"])


@register("p20_apply_threshold", f"SELECT id, CAST(p >= 0.4 AS INTEGER) AS flagged FROM ({SCORED})")
def _(spark, folder):
    return scored(spark, folder).select("id", fx.apply_threshold("p", 0.4).alias("flagged"))


@register("j1_align_by_id", f"SELECT id, label, p FROM ({SCORED})", "id label p~")
def _(spark, folder):
    df = scored(spark, folder)
    return ops.align_by_id(df.select("id", "label"), df.select("id", "p"))
