"""Periodic runs of all documents, a tenth of which is given a periodic end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm import runs
from tallygrove.llm.queries import table


def with_periods(docs: DataFrame) -> DataFrame:
    """The documents, those whose crc32 of the id ends in 0 with a periodic end; without id or words a text stays."""
    words = docs.select("doc_id", "text", F.expr("crc32(string(doc_id))").alias("h"))
    chosen = F.when(F.col("h") % 10 == 0, F.expr(r"regexp_extract_all(text, '([^\\x20\\x09-\\x0D]+)', 1)"))
    words = words.withColumn("w", chosen).withColumn("n", F.when(F.size("w") > 0, F.size("w")))
    words = words.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("g % n"))
    words = words.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    at = "int(if(i < a, i, a + (i - a) % p))"
    ended = F.expr(f"array_join(transform(sequence(0, n - 1), i -> get(w, {at})), ' ')")
    return words.select("doc_id", F.when(F.col("n").isNotNull(), ended).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.periodic_runs(with_periods(table(spark, folder, "documents")))
    longest = F.expr("array_sort(runs, (x, y) -> CASE WHEN x.length != y.length THEN int(sign(y.length - x.length)) WHEN x.start != y.start THEN int(sign(x.start - y.start)) ELSE int(sign(x.period - y.period)) END)")
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    top = F.get(longest, F.lit(0))
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
