"""Reading and writing tables, and the shapes the operators take."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.operators.ranking import running_points

FORMATS = ("csv", "json", "parquet")


def format_of(path: str) -> str:
    """Format by file extension, case-sensitive."""
    ending = path.rstrip("/").rsplit(".", 1)[-1]
    if ending not in FORMATS:
        raise ValueError(f"unsupported extension '{ending}': use one of {', '.join(FORMATS)}")
    return ending


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    null_tokens: Sequence[str] = ("NA",),
    json_array: bool = False,
) -> DataFrame:
    """CSV (header row), JSON (one object per line, or one array) or Parquet.

    Text formats need a schema: inferring one costs a pass and may differ from file to file. Spark
    takes a single null text per read, the other tokens are replaced afterwards.
    """
    fmt = fmt or format_of(path)
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format '{fmt}'")
    if fmt == "parquet":
        return spark.read.parquet(path)
    if schema is None:
        raise ValueError(f"{fmt} needs an explicit schema")
    if fmt == "json":
        df = spark.read.schema(schema).option("multiLine", json_array).json(path)
    else:
        reader = spark.read.schema(schema).option("header", True)
        if null_tokens:
            reader = reader.option("nullValue", null_tokens[0])
        df = reader.csv(path)
    return null_if_token(df, null_tokens)


def null_if_token(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Every text cell equal to one of the tokens becomes null."""
    if not tokens:
        return df
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(
        *[
            F.when(~F.col(f"`{c}`").isin(list(tokens)), F.col(f"`{c}`")).alias(c) if c in text else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[f"`{c}`" for c in numeric_columns(df)])


def split_xy(df: DataFrame, target: str, intercept: bool = True) -> tuple[DataFrame, list[str]]:
    """Target column last and named ``target``; every other column is a feature, led by a constant 1."""
    features = [c for c in df.columns if c != target]
    ones = [F.lit(1.0).alias("intercept")] if intercept else []
    out = df.select(*ones, *[F.col(f"`{c}`").cast("double").alias(c) for c in features], F.col(target).alias("target"))
    return out, (["intercept"] if intercept else []) + features


def with_positions(df: DataFrame, key: str, name: str = "row_idx") -> DataFrame:
    """0-based position of each distinct numeric key, as a matrix row number."""
    ranked = running_points(df.select(key).distinct().withColumn("_one", F.lit(1)), key, ["_one"])
    return df.join(ranked.select(key, (F.col("run__one") - 1).alias(name)), key)


def matrix_from_table(df: DataFrame, row: str) -> DataFrame:
    """Cells ``(row_idx, col_idx, value)``. Text columns go first, then columns are numbered from 0."""
    cols = [c for c in numeric_columns(df) if c != row]
    cells = [F.struct(F.lit(i).alias("col_idx"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(cols)]
    return df.select(F.col(row).alias("row_idx"), F.explode(F.array(*cells)).alias("c")).select("row_idx", "c.*")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
