"""Preprocessing fitted on the training rows only.

``fit`` returns a small plain-Python state; ``transform`` turns it into literals of a projection,
so applying it costs no join and works on any split, or on a stream.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.functions.scalars import clip
from tallygrove.operators.order_stats import exact_quantiles
from tallygrove.operators.statistics import binary_like, moments, near_constant_columns

MISSING = "nan"  # category name of a null


def continuous_columns(train: DataFrame, cols: Sequence[str], declared: Sequence[str] = ()) -> list[str]:
    """Columns that are not 0/1: the ones to clip and scale."""
    flags = {r["column"]: r["is_binary"] for r in binary_like(train, cols, declared).collect()}
    return [c for c in cols if not flags[c]]


@dataclass(frozen=True)
class WinsorizerModel:
    bounds: Mapping[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: clip(c, lo, hi) for c, (lo, hi) in self.bounds.items()})


@dataclass(frozen=True)
class Winsorizer:
    cols: Sequence[str]
    low: float = 0.001
    high: float = 0.999

    def fit(self, train: DataFrame, **limits: int) -> WinsorizerModel:
        found = exact_quantiles(train, {c: F.col(c) for c in self.cols}, [self.low, self.high], **limits)
        return WinsorizerModel({c: (v[0], v[1]) for c, v in found.items() if v[0] is not None})


@dataclass(frozen=True)
class ScaleModel:
    stats: Mapping[str, tuple[float, float]]
    eps: float = 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (mean, std) in self.stats.items():
            divisor = std + self.eps if self.eps else (std or 1.0)
            out[c] = (F.col(c) - F.lit(mean)) / F.lit(divisor)
        return df.withColumns(out)


@dataclass(frozen=True)
class StandardScale:
    """(x - mean) / population std; a constant column becomes 0. With ``eps`` the divisor is
    std + eps instead."""

    cols: Sequence[str]
    eps: float = 0.0

    def fit(self, train: DataFrame) -> ScaleModel:
        rows = moments(train, self.cols).collect()  # one row per column
        return ScaleModel({r["column"]: (r["mean"], r["std_pop"]) for r in rows}, self.eps)


def with_statistics(df: DataFrame, train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<c>_mean`` and ``<c>_std`` learnt on ``train``. They are two numbers per column, so they
    go in as literals: no join is needed to bring fitted values to another split."""
    stats = StandardScale(cols).fit(train).stats
    return df.withColumns(
        {f"{c}_{k}": F.lit(v) for c, pair in stats.items() for k, v in zip(("mean", "std"), pair)}
    )


def standardize_train_only(cols: Sequence[str], eps: float = 1e-12) -> StandardScale:
    return StandardScale(cols, eps)


@dataclass(frozen=True)
class OneHotModel:
    categories: Mapping[str, Sequence[str]]
    unknown: str  # ignore | error

    def names(self) -> list[str]:
        return [f"{c}_{v}" for c, values in self.categories.items() for v in values]

    def transform(self, df: DataFrame, keep_source: bool = False) -> DataFrame:
        """0/1 columns ``col_value``, one per known category."""
        out = {}
        for c, values in self.categories.items():
            text = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
            if self.unknown == "error":
                bad = F.raise_error(F.concat(F.lit(f"unknown {c}: "), text)).cast("string")
                text = F.when(text.isin(list(values)), text).otherwise(bad)
            for v in values:
                out[f"{c}_{v}"] = (text == F.lit(v)).cast("int")
        wide = df.withColumns(out)
        return wide if keep_source else wide.drop(*self.categories)

    def stages(self) -> list:
        """The same encoding as sparse vectors: exactly one slot per category, zeros if unknown."""
        out = []
        for c, values in self.categories.items():
            handle = "keep" if self.unknown == "ignore" else "error"
            out += [
                StringIndexerModel.from_labels(list(values), c, f"{c}_index", handle),
                OneHotEncoder(
                    inputCol=f"{c}_index",
                    outputCol=f"{c}_hot",
                    dropLast=self.unknown == "ignore",
                    handleInvalid="error",
                ),
            ]
        return out


@dataclass(frozen=True)
class OneHot:
    """Categories of the training rows in sorted order, null being one; unknown values give zeros.

    One job for all columns. Each value becomes a column, so there is a limit; ``CategoryDictionary`` has none.
    """

    cols: Sequence[str]
    max_categories: int = 10_000

    def fit(self, train: DataFrame) -> OneHotModel:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("v")) for i, c in enumerate(self.cols)])
        values = train.select(F.explode(pairs).alias("p")).select("p.*").distinct() if self.cols else None
        rows = values.limit(self.max_categories * len(self.cols) + 1).collect() if self.cols else []
        found = {c: sorted(r.v for r in rows if r.i == i) for i, c in enumerate(self.cols)}
        for c, v in found.items():
            if len(v) > self.max_categories or len(rows) > self.max_categories * len(self.cols):
                raise ValueError(f"'{c}' has more than {self.max_categories} values: not a category for dense columns, encode it by a CategoryDictionary")
        return OneHotModel(found, "ignore")


def one_hot_fixed(categories: Mapping[str, Sequence[str]]) -> OneHotModel:
    """Categories given beforehand, say from the whole table; an unknown value is an error."""
    return OneHotModel({c: list(v) for c, v in categories.items()}, "error")


@dataclass(frozen=True)
class DropModel:
    dropped: Sequence[str]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped)


@dataclass(frozen=True)
class DropNearConstant:
    cols: Sequence[str]
    threshold: float = 0.9995

    def fit(self, train: DataFrame) -> DropModel:
        rows = near_constant_columns(train, self.cols, self.threshold).collect()
        return DropModel(sorted(r["column"] for r in rows))


@dataclass(frozen=True)
class PreprocessModel:
    winsorize: WinsorizerModel
    scale: ScaleModel
    one_hot: OneHotModel
    drop: DropModel
    features: Sequence[str]
    keep: Sequence[str]

    def transform(self, df: DataFrame) -> DataFrame:
        """``keep`` columns and the features; everything else is dropped."""
        wide = self.one_hot.transform(self.scale.transform(self.winsorize.transform(df)))
        return self.drop.transform(wide).select(*[f"`{c}`" for c in [*self.keep, *self.features]])


@dataclass(frozen=True)
class Preprocess:
    """Clip, scale, one-hot, drop near-constant columns: all learnt on ``train``.

    Every split gets the same columns because one projection makes them.
    """

    numeric: Sequence[str]
    categorical: Sequence[str]
    declared_binary: Sequence[str] = ()
    keep: Sequence[str] = ("id", "label", "split")

    def fit(self, train: DataFrame) -> PreprocessModel:
        cont = continuous_columns(train, self.numeric, self.declared_binary)
        wins = Winsorizer(cont).fit(train)
        clipped = wins.transform(train)
        scale = StandardScale(cont).fit(clipped)
        hot = OneHot(self.categorical).fit(train)
        names = [*self.numeric, *hot.names()]
        drop = DropNearConstant(names).fit(hot.transform(scale.transform(clipped)))
        features = [c for c in names if c not in set(drop.dropped)]
        return PreprocessModel(wins, scale, hot, drop, features, self.keep)


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("id", "label"), out: str = "features") -> DataFrame:
    """Feature columns -> one vector column carrying their names as attributes."""
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df).select(*keep, out)


def column_transformer(scaled: Sequence[str], hot: OneHotModel, out: str = "features") -> Pipeline:
    """ML stages for a one-hot block and pass-through columns, for large category sets."""
    stages = hot.stages()
    inputs = [*scaled, *[f"{c}_hot" for c in hot.categories]]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol=out)])

