"""Loads that replace what they bring anew, upserts, and texts for people."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlework.sinks.text import formatted


def replace_by_key(df: DataFrame, path: str, key: str) -> None:
    """Write ``df`` partitioned by ``key``; partitions it has are replaced, all others stay."""
    df.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upserted(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Both, of a key that is in both the new row; of several new rows of a key the one that sorts last."""
    columns = [c for c in old.columns if c not in key]
    order = Window.partitionBy(*key).orderBy(F.desc("__new"), *[F.desc_nulls_last(c) for c in columns])
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("__new", F.lit(1)))
    return both.withColumn("__i", F.row_number().over(order)).where("__i = 1").select(*old.columns)


def stale(spark: SparkSession, path: str, today: dt.date | None = None) -> bool:
    """Whether a load is due: no metadata there, no sync noted, or the last one before today."""
    from candlework.sources.reports import _exists

    if not _exists(spark, path):
        return True
    last = spark.read.parquet(path).agg(F.max("last_sync").cast("date")).first()[0]
    return last is None or last < (today or dt.date.today())


def markdown(df: DataFrame, title: str, most: int = 100) -> str:
    """A heading and a table of the first ``most`` rows, in the frame's order."""
    rows = formatted(df.limit(most)).collect()
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def console(df: DataFrame, most: int = 10) -> str:
    """The first ``most`` rows, columns padded; numbers to the right."""
    rows = [["" if x is None else str(x) for x in r] for r in formatted(df.limit(most)).collect()]
    width = [max(len(c), *(len(r[i]) for r in rows)) if rows else len(c) for i, c in enumerate(df.columns)]
    right = [kind in ("double", "bigint", "int") for _, kind in df.dtypes]
    show = lambda cells: "  ".join(x.rjust(w) if at else x.ljust(w) for x, w, at in zip(cells, width, right, strict=True)).rstrip()
    return "\n".join([show(df.columns), "  ".join("-" * w for w in width), *map(show, rows)]) + "\n"
