"""Text of plans that Spark SQL and DuckDB both read.

A plan is a chain of named steps (common table expressions). The engine runs the chain with spark.sql over
DataFrames; the oracle puts the adapters' SQL in front and runs the same chain, or its own, in DuckDB.
Only day arithmetic differs and is written as days_between(later, earlier).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BY_BAR = "PARTITION BY ticker ORDER BY trade_date"


def last(n: int, back: int = 0) -> str:
    """The frame of the last n bars that ends ``back`` bars ago."""
    end = "CURRENT ROW" if back == 0 else f"{back} PRECEDING"
    return f"OVER ({BY_BAR} ROWS BETWEEN {n - 1 + back} PRECEDING AND {end})"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({BY_BAR})"


def full(n: int, x: str) -> str:
    """Undefined until n bars exist."""
    return f"CASE WHEN rn >= {n} THEN {x} END"


def ratio(a: str, b: str) -> str:
    """a / b, undefined unless b is positive."""
    return f"(({a}) / CASE WHEN ({b}) > 0 THEN ({b}) END)"


def change(a: str, b: str) -> str:
    return f"(({ratio(a, b)} - 1) * 100)"


def r(x: str, digits: int = 6) -> str:
    """Rounded, without negative zero: sums differ in their last bits between engines."""
    return f"(round({x}, {digits}) + 0e0)"


def chain(steps: list[tuple[str, str]], final: str, recursive: bool = False) -> str:
    with_ = "WITH RECURSIVE " if recursive else "WITH "
    return with_ + ",\n".join(f"{name} AS ({text})" for name, text in steps) + "\n" + final


def in_duckdb(text: str) -> str:
    return re.sub(r"days_between\(([^,()]+),\s*([^,()]+)\)", r"date_diff('day', \2, \1)", text)


def in_spark(text: str) -> str:
    return re.sub(r"days_between\(([^,()]+),\s*([^,()]+)\)", r"datediff(\1, \2)", text)


def run(spark: SparkSession, steps: list[tuple[str, str]], final: str, **tables: DataFrame) -> DataFrame:
    """Run a chain over DataFrames, which go in as steps of their own."""
    sources = [(name, f"SELECT * FROM {{{name}}}") for name in tables]
    return spark.sql(in_spark(chain(sources + steps, final)), **tables)
