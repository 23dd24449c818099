"""Category columns of any number of values: a dictionary table, joined by value, and sparse vectors.

The values of all columns are counted in one exploded aggregate, sorted by range, and numbered within each range; a value's
slot is its number plus the sizes of the ranges before, so no task orders a whole column. The dictionary is a table in the
shared folder: neither the plan nor the driver grows with the number of values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.operators.preprocessing import MISSING
from tallygrove.session import fresh_path

BROADCAST_VALUES = 200_000  # dictionaries up to this many values go to every task; larger ones are joined by a shuffle
LONGEST = 200  # bytes of a value on average up to which that holds


def _text(column: str):
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(MISSING))


@dataclass(frozen=True)
class CategoryDictionary:
    """``column`` (its place among ``cols``), ``value``, ``slot`` (its rank in the column, from 0), ``n`` rows of the fit."""

    cols: Sequence[str]
    table: DataFrame
    sizes: Sequence[int]
    small: bool

    @staticmethod
    def fit(train: DataFrame, cols: Sequence[str]) -> CategoryDictionary:
        """The values of the training rows, null being ``MISSING``, in ascending order of their bytes. Three jobs for all columns."""
        spark = train.sparkSession
        pairs = F.array(*[F.struct(F.lit(i).alias("column"), _text(c).alias("value")) for i, c in enumerate(cols)])
        counts = train.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))
        ranged = counts.repartitionByRange("column", "value").sortWithinPartitions("column", "value")
        ranged = ranged.withColumn("_id", F.monotonically_increasing_id())
        part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
        path = fresh_path(spark, "dictionary")
        ranged.select("column", "value", "n", part.alias("part"), place.alias("place")).write.parquet(path)
        rows = spark.read.parquet(path)
        ranges = rows.groupBy("column", "part").agg(F.count(F.lit(1)).alias("k"), F.min("place").alias("first"), F.sum(F.octet_length("value")).alias("bytes"))
        found = sorted(ranges.collect())  # a row for each range of each column: no more than the shuffle's partitions and the columns
        sizes, before, total = [0] * len(cols), [], 0
        for column, part_, k, first, size in found:
            before.append((column, part_, sizes[column] - first))
            sizes[column] += k
            total += size
        starts = spark.createDataFrame(before, "column int, part long, base long")
        table = rows.join(F.broadcast(starts), ["column", "part"]).select("column", "value", (F.col("base") + F.col("place")).cast("int").alias("slot"), "n")
        values = sum(sizes)
        return CategoryDictionary(list(cols), table, sizes, values <= BROADCAST_VALUES and total <= LONGEST * max(1, values))

    def of(self, column: str) -> DataFrame:
        return self.table.where(F.col("column") == self.cols.index(column)).select("value", "slot")

    def index(self, df: DataFrame, suffix: str = "_slot") -> DataFrame:
        """Add ``<column>_slot``: the slot of each column's value, null where the dictionary hasn't got it."""
        for c in self.cols:
            own = self.of(c).select(F.col("value").alias("_value"), F.col("slot").alias(f"{c}{suffix}"))
            df = df.join(F.broadcast(own) if self.small else own, _text(c) == F.col("_value"), "left").drop("_value")
        return df

    def encode(self, df: DataFrame, numeric: Sequence[str] = (), out: str = "features") -> DataFrame:
        """A sparse vector of the numbers and one slot for each category; unknown values give zeros. The source columns stay."""
        slots = [f"_{i}_slot" for i in range(len(self.cols))]
        rows = self.index(df, "_found")
        for c, slot, size in zip(self.cols, slots, self.sizes):
            # one slot more, that of unknown values, which has no place in the vector
            rows = rows.withColumn(slot, F.coalesce(F.col(f"`{c}_found`"), F.lit(size)).cast("double")).drop(f"{c}_found")
            rows = rows.withMetadata(slot, {"ml_attr": {"type": "nominal", "num_vals": size + 1}})
        hot = [f"_{i}_hot" for i in range(len(self.cols))]
        encoder = OneHotEncoder(inputCols=slots, outputCols=hot, dropLast=True, handleInvalid="error")
        rows = encoder.fit(rows).transform(rows)
        return VectorAssembler(inputCols=[*numeric, *hot], outputCol=out).transform(rows).drop(*slots, *hot)


def near_constant_values(dictionary: CategoryDictionary, rows: int, threshold: float = 0.9995) -> DataFrame:
    """``column``, ``value``, ``share`` of the 0/1 columns that are constant beyond the threshold, read off the counts."""
    share = F.col("n") / F.lit(float(max(1, rows)))
    names = F.element_at(F.array(*[F.lit(c) for c in dictionary.cols]), F.col("column") + 1)
    rare = F.greatest(share, F.lit(1.0) - share)
    return dictionary.table.where(rare > threshold).select(names.alias("column"), "value", share.alias("share"))
