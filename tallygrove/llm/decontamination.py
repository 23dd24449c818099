"""Benchmark passages in documents, found and removed with DataFrame functions only.

A document is probed with short word runs at a fixed stride: every window of the benchmark contains one of them. Runs
that occur in the benchmark (a broadcast hash set) name places, the windows around those places are compared word for
word, and only what is equal counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.graph import stored

#: what separates words: everything in ASCII but digits and letters
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



@dataclass(frozen=True)
class Rule:
    """Windows of ``window`` words; contaminated where ``share`` times the words hit reach the document's words."""

    window: int = 13
    share: int = 20
    probe: int = 6  # words of a probe
    broadcast_rows: int = 2_000_000  # up to so many windows are broadcast; beyond, both sides are shuffled


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), SEPARATOR), lambda w: w != "")


def _joined(array: Column, start: Column, size: int) -> Column:
    """``size`` words from a place counted from 0, as one string."""
    return F.array_join(F.slice(array, start + 1, size), " ")


def _windows(benchmark: DataFrame, rule: Rule) -> DataFrame:
    """``item``, ``size`` (words of its windows), ``w`` (the item's words)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), words(F.col("text").cast("string")).alias("w"))
    items = items.filter(F.col("item").isNotNull() & (F.size("w") > 0))
    return items.withColumn("size", F.least(F.size("w"), F.lit(rule.window)))


def _places(last: Column, step: int) -> Column:
    """0, step, 2 * step .. up to ``last``; none if it is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))


def _runs(array: str, size: int) -> Column:
    """All runs of ``size`` words, each as one string."""
    return F.transform(_places(F.size(array) - size, 1), lambda i: _joined(F.col(array), i, size))


def _probes(probe: int, step: int, size: int) -> Column:
    """Every ``step`` words: the hash of the run that starts there, and the words of all windows that hold the run."""

    def around(i: Column) -> Column:
        start = F.greatest(i - (step - 1), F.lit(0))
        return F.struct(
            F.xxhash64(_joined(F.col("w"), i, probe)).alias("key"),
            start.alias("start"),
            F.slice(F.col("w"), start + 1, i + size - start).alias("near"),
        )

    return F.transform(_places(F.size("w") - probe, step), around)


def hits(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id``, ``mark`` (a hash of the text), ``p``, ``e``, ``item``: words p to e (exclusive) equal a window of the item.

    Rows may repeat.
    """
    items = _windows(benchmark, rule)
    sizes = items.groupBy("size").agg(F.sum(F.size("w") - F.col("size") + 1).alias("n")).collect()  # at most ``window`` rows
    small = sum(r.n for r in sizes) <= rule.broadcast_rows
    held = F.broadcast if small else (lambda df: df)
    text = F.col("text").cast("string")
    split = docs.filter(text.isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), words(text).alias("w"))
    found = None
    for size in sorted(r["size"] for r in sizes):
        probe = min(rule.probe, size)
        step = size - probe + 1  # each window holds a probe that starts at a multiple of it
        own = items.filter(F.col("size") == size)
        probes = own.select(F.explode(_runs("w", probe)).alias("key")).select(F.xxhash64("key").alias("key")).distinct()
        windows = own.select("item", F.explode(_runs("w", size)).alias("window")).distinct()
        each = split.select("doc_id", "mark", F.explode(_probes(probe, step, size)).alias("x"))
        each = each.select("doc_id", "mark", "x.key", "x.start", "x.near").join(held(probes), "key", "left_semi")
        each = each.select("doc_id", "mark", "start", F.posexplode(_runs("near", size)).alias("at", "window"))
        each = each.join(held(windows), "window").select(
            "doc_id", "mark", (F.col("start") + F.col("at")).alias("p"), (F.col("start") + F.col("at") + size).alias("e"), "item"
        )
        found = each if found is None else found.unionAll(each)
    if found is None:
        found = split.limit(0).select("doc_id", "mark", F.lit(0).alias("p"), F.lit(0).alias("e"), F.lit(0).cast("long").alias("item"))
    return found


def _union_length(spans: Column) -> Column:
    """Words in the union of sorted (p, e) spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    return F.aggregate(
        spans,
        zero,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["p"], acc["reach"]))).alias("n"), F.greatest(acc["reach"], x["e"]).alias("reach")
        ),
        lambda acc: acc["n"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id``, ``mark``, ``n_words``, ``n_hit``, ``items`` (sorted as strings), ``spans``, ``contaminated`` of every row.

    Equal rows of one id have equal results. A null or empty text has no words and is clean. Benchmark items without an id,
    a text or a word are not looked for; an item of fewer words than a window is one window. Other columns are not read.
    """
    c = F.col
    text = c("text").cast("string")
    rows = docs.select(
        c("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")
    )
    by = hits(docs, benchmark, rule).groupBy(c("doc_id").alias("id"), c("mark").alias("own"))
    by = by.agg(F.sort_array(F.collect_set(F.struct("p", "e"))).alias("spans"), F.collect_set("item").alias("items"))
    both = rows.join(by, c("doc_id").eqNullSafe(c("id")) & (c("mark") == c("own")), "left")
    return both.select(
        "doc_id",
        "mark",
        "n_words",
        F.coalesce(_union_length(c("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.array_sort(F.transform("items", lambda x: x.cast("string"))), F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<p:int,e:int>>")).alias("spans"),
    ).withColumn("contaminated", (c("n_hit") > 0) & (rule.share * c("n_hit") >= c("n_words")))


def remove_documents(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents that are not contaminated, with all their columns and whole texts."""
    bad = contamination(docs, benchmark, rule).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    bad = stored(bad, "contaminated")  # its size is then known: Spark broadcasts it where it is small
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_mark"))
    return docs.join(bad, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """All documents; words inside windows of the benchmark, and what separates them from the next word, are cut out."""
    c = F.col
    text = c("text").cast("string")
    by = contamination(docs, benchmark, rule).filter("n_hit > 0").select(c("doc_id").alias("_id"), c("mark").alias("_mark"), c("spans").alias("_spans"))
    by = by.dropDuplicates(["_id", "_mark"])
    same = c("doc_id").cast("long").eqNullSafe(c("_id")) & (F.xxhash64(text) == c("_mark"))
    own, between = F.filter(F.split(text, SEPARATOR), lambda w: w != ""), F.split(text, WORD)
    inside = lambda i: F.exists(c("_spans"), lambda s: (s["p"] <= i) & (i < s["e"]))
    kept = F.transform(own, lambda w, i: F.when(inside(i), F.lit("")).otherwise(F.concat(w, F.get(between, i + 1))))
    cut = F.concat(F.get(between, F.lit(0)), F.array_join(kept, ""))
    joined = docs.join(by, same, "left")
    return joined.select(*[F.when(c("_spans").isNull(), c("text")).otherwise(cut).alias(x) if x == "text" else docs[x] for x in docs.columns])
