"""CSV with four decimals, INF for an infinite profit factor and blanks for null; one JSON payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def formatted(df: DataFrame) -> DataFrame:
    """All doubles as text: four decimals, INF, or blank."""
    text = lambda c: F.when(F.col(c).isNull(), "").when(F.abs(F.col(c)) == float("inf"), "INF").otherwise(F.format_string("%.4f", F.col(c)))
    return df.select(*[text(c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    formatted(df).write.mode("overwrite").option("header", True).csv(path)


def merge_same_header(first: DataFrame, *others: DataFrame | None) -> DataFrame:
    """All rows of tables with just the same columns in the same order; a missing table or one without columns is passed by."""
    first, *others = [df for df in (first, *others) if df is not None and df.columns]
    for df in others:
        if df.columns != first.columns:
            raise ValueError(f"headers differ: {df.columns} and {first.columns}")
        first = first.unionByName(df)
    return first


def payload(df: DataFrame) -> DataFrame:
    """One JSON text a row; numbers that are not finite become 9999."""
    finite = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 9999.0).otherwise(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    return df.select(F.to_json(F.struct(*finite)).alias("value"))
